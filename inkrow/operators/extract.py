"""Fields of resident cards and driving licences from their recognised lines, one row per image and field, as decide.accepted takes them.

The lines of an image are few, so they meet once, as one array per image (layout.pages), and page.py reads them in Arrow batches, image by image: one shuffle for all fields. Only addresses,
which need dictionaries, go on to joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkrow.functions import text
from inkrow.functions.likeness import Names
from inkrow.operators import address, layout, page
from inkrow.sources.tables import stored

STRINGS, BOXES = "array<string>", "array<array<struct<x:double,y:double>>>"
DERIVED = "map<string,string>"
FIELD = f"struct<field:string,value:string,confidence:double,valid:boolean,verified:boolean,warnings:{STRINGS},boxes:{BOXES},derived:{DERIVED}>"
#: Least likeness of an issuer to the police office that it stands for.
SNAP = 0.75


def parted(pages: DataFrame) -> DataFrame:
    """The pages of layout.pages with the characters in a column of their own, letters, an array for each line."""
    return pages.withColumns({"letters": F.transform("lines", lambda x: x["chars"]), "lines": F.transform("lines", lambda x: x.dropFields("chars"))})


class Snap:
    """The name of a closed list that a text without spaces stands for, as classify.snap_to_list; each distinct text is looked for once."""

    def __init__(self, names: list[str]):
        self.names, self.held = Names(names), {n: n for n in names}
        self.known = frozenset(names).__contains__

    def __call__(self, bare: str) -> str | None:
        if bare not in self.held:
            if len(self.held) > 100_000:
                self.held = {n: n for n in self.names.names}
            self.held[bare] = self.names.nearest([bare], SNAP)[0]
        return self.held[bare]


def _cut(column: pa.Array) -> Callable[[int, int], list]:
    """What gives the values of a column from one place to another. A batch has many times the values that reading it asks for, so that only those become objects."""
    if column.null_count or not pa.types.is_primitive(column.type):
        return lambda a, b: column.slice(a, b - a).to_pylist()
    held = column.to_numpy(zero_copy_only=False)
    return lambda a, b: held[a:b].tolist()


def _cut_lists(column: pa.ListArray, values: Callable[[int, int], list]) -> Callable[[int, int], list]:
    """_cut for lists whose values are cut by values; None where there is none."""
    at, null = column.offsets.to_numpy(), column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None

    def cut(a: int, b: int) -> list:
        places = at[a : b + 1].tolist()
        held, first = values(places[0], places[-1]), places[0]
        return [None if null is not None and null[a + i] else held[places[i] - first : places[i + 1] - first] for i in range(b - a)]

    return cut


def _cut_boxes(column: pa.ListArray) -> Callable[[int, int], list]:
    x, y = map(_cut, column.values.flatten())
    return _cut_lists(column, lambda a, b: list(zip(x(a, b), y(a, b), strict=True)))


def _read_pages(lines: pa.ListArray, letters: pa.ListArray, title: pa.Array, today: pa.Array, again: pa.StructArray) -> Iterator[page.Page]:
    own, signs = lines.values, letters.values.values
    parts = [_cut(own.field(n)) for n in ("place", "idx", "text", "score")] + [_cut_boxes(own.field("box"))] + [_cut(own.field(n)) for n in ("x0", "x1", "y0", "y1", "h", "cy")]
    said, scores, across = _cut(signs.field("text")), _cut(signs.field("score")), _cut_lists(signs.field("box"), _cut(signs.field("box").values.flatten()[0]))
    ends, none = letters.values.offsets.to_pylist(), letters.values.is_null().to_pylist()
    at, first = lines.offsets.to_pylist(), letters.offsets.to_pylist()
    for i, (t, day, second) in enumerate(zip(title.to_pylist(), today.to_pylist(), again.to_pylist(), strict=True)):

        def chars_of(place: int, start: int = first[i] - 1) -> page.Chars | None:
            if none[start + place]:
                return None
            a, b = ends[start + place], ends[start + place + 1]

            def between(i: int, j: int) -> list | None:
                xs = across(a + i, a + j)
                return None if None in xs else [x for own in xs for x in own]

            return page.Chars(said(a, b), scores(a, b), between)

        held = [page.Line(*x, [x[0]]) for x in zip(*(cut(at[i], at[i + 1]) for cut in parts), strict=True)]
        yield page.Page(held, chars_of, t, day, second and (second["text"], second["score"]))


def _offsets(lists: list) -> pa.Array:
    out = [0]
    for x in lists:
        out.append(out[-1] + len(x or ()))
    return pa.array(out, pa.int32())


def _strings(lists: list[list[str]]) -> pa.Array:
    return pa.ListArray.from_arrays(_offsets(lists), pa.array([s for x in lists for s in x], pa.string()))


def _drawn(lists: list[list]) -> pa.Array:
    boxes = [b for x in lists for b in x]
    points = [p for b in boxes for p in b or ()]
    xy = pa.StructArray.from_arrays([pa.array([p[k] for p in points], pa.float64()) for k in (0, 1)], ["x", "y"])
    return pa.ListArray.from_arrays(_offsets(lists), pa.ListArray.from_arrays(_offsets(boxes), xy, mask=pa.array([b is None for b in boxes], pa.bool_())))


def _packed(rows: list[tuple[list[page.Found], page.Address | None]]) -> pa.StructArray:
    """The fields and addresses of pages as one array."""
    found = [f for fields, _ in rows for f in fields]
    of = lambda name, kind: pa.array([getattr(f, name) for f in found], kind)
    told = [f.derived for f in found]
    derived = pa.MapArray.from_arrays(_offsets(told), pa.array([k for d in told for k in d], pa.string()), pa.array([v for d in told for v in d.values()], pa.string()))
    fields = {"field": of("field", pa.string()), "value": of("value", pa.string()), "confidence": of("confidence", pa.float64()), "valid": of("valid", pa.bool_()), "verified": of("verified", pa.bool_()), "warnings": _strings([f.warnings for f in found]), "boxes": _drawn([f.boxes for f in found]), "derived": derived}
    own = pa.ListArray.from_arrays(_offsets([f for f, _ in rows]), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
    none = page.Address([], None, [])
    held = [a or none for _, a in rows]
    places = {"texts": _strings([a.texts for a in held]), "score": pa.array([a.score for a in held], pa.float64()), "boxes": _drawn([a.boxes for a in held])}
    addresses = pa.StructArray.from_arrays(list(places.values()), list(places), mask=pa.array([a is None for _, a in rows], pa.bool_()))
    return pa.StructArray.from_arrays([own, addresses], ["found", "address"])


def _pages(lines: DataFrame, titles: DataFrame) -> DataFrame:
    return parted(layout.pages(lines)).join(titles.select("image", F.col("idx").alias("title")), "image", "left")


def _read(own: DataFrame, today: Column, again: DataFrame | None, kind: str) -> DataFrame:
    """image, found (fields, but for those of the address) and address (texts of its rows, score and boxes) of each image, as page.resident or page.license reads it. own are image, lines, letters (as of parted) and title."""
    snap = Snap(text.POLICE_ISSUERS)
    reads = page.resident if kind == "resident" else lambda own: page.license(own, snap)

    @F.arrow_udf(f"struct<found:array<{FIELD}>,address:struct<texts:{STRINGS},score:double,boxes:{BOXES}>>")
    def read(lines: pa.Array, letters: pa.Array, title: pa.Array, today: pa.Array, again: pa.Array) -> pa.Array:
        return _packed([reads(p) for p in _read_pages(lines, letters, title, today, again)])

    second = F.lit(None).cast("struct<text:string,score:double>")
    if again is not None:
        own, second = own.join(again.select("image", F.struct("text", "score").alias("again")), "image", "left"), F.col("again")
    return own.withColumn("read", read("lines", "letters", "title", today, second)).select("image", "read.found", "read.address")


def field(name: str, value: Column, confidence: Column, valid: Column, boxes: Column, warnings: list[Column] = []) -> Column:  # noqa: B006
    flags = F.array_compact(F.array(*warnings)) if warnings else F.array().cast(STRINGS)
    return F.struct(F.lit(name).alias("field"), value.alias("value"), confidence.cast("double").alias("confidence"), F.coalesce(valid, F.lit(False)).alias("valid"), F.lit(False).alias("verified"), flags.alias("warnings"), boxes.alias("boxes"), F.create_map().cast(DERIVED).alias("derived"))


def _replaced(lines: Column, changed: Column) -> Column:
    """The lines with each change made in the first line that has the old word."""

    def step(done: Column, change: Column) -> Column:
        at = F.array_position(F.transform(done, lambda t: F.array_contains(F.split(t, " "), change["old"])), True)

        def mend(t: Column) -> Column:
            words = F.split(t, " ")
            place = F.array_position(words, change["old"])
            return F.array_join(F.transform(words, lambda w, i: F.when(i + 1 == place, change["new"]).otherwise(w)), " ")

        return F.transform(done, lambda t, i: F.when(i + 1 == at, mend(t)).otherwise(t))

    return F.aggregate(changed, lines, step)


def _address_fields(value: Column, changed: Column, valid: Column) -> list[Column]:
    a = F.col("address")
    flags = [F.when(F.size(changed) > 0, "REPAIRED:address")]
    return [field("address", F.when(a.isNotNull(), value), a["score"], valid, a["boxes"], flags), field("address_lines", F.array_join(_replaced(a["texts"], changed), "|"), a["score"], valid, a["boxes"])]


def _found(pages: DataFrame, fields: Column) -> DataFrame:
    return pages.select("image", F.inline(F.filter(fields, lambda f: f["value"].isNotNull())))


def read_pages(kind: str, pages: DataFrame, today: Column, again: DataFrame | None = None) -> DataFrame:
    """What is found on pages of a kind (resident or license), written out for rows(): pages are image, lines and letters (as of parted) and title. What is done with it doesn't read the pages again."""
    own = _read(pages, today, again, kind)
    return stored(own.select("image", "found", "address", F.array_join("address.texts", " ").alias("__address")), "pages")


def rows(own: DataFrame, dictionary: dict[str, DataFrame] | None) -> DataFrame:
    """A row a field found by read_pages, and of its addresses, set right by the dictionary's provinces, districts and words, or as they are without one."""
    if dictionary is None:
        none = F.array().cast("array<struct<old:string,new:string>>")
        return _found(own, F.concat("found", F.array(*_address_fields(F.col("__address"), none, text.address_is_valid("__address")))))
    fixed = address.correct(own, dictionary["provinces"], dictionary["districts"], dictionary.get("words"), "__address")
    return stored(_found(fixed, F.concat("found", F.array(*_address_fields(F.col("corrected"), F.col("changed"), F.col("valid"))))), "fields")


def resident_fields(lines: DataFrame, titles: DataFrame, today: Column, dictionary: dict[str, DataFrame] | None = None, again: DataFrame | None = None) -> DataFrame:
    """image, field (rrn, name, name_hanja, address, address_lines, issue_date, issuer), value, confidence, valid, verified, warnings, boxes and derived of the fields found.

    lines are image, idx, text, score, box and chars (may be null); lists in value are joined by a bar. titles (image, idx) names the title line of images that have one. Lines are set
    upright by their image's angle first; boxes keep their places. The name is the lowest line with Hangul above the number, below the title and
    left of the number's right edge; the date of issue the first below the number, from the year in which its holder turns 16; the address is between them. An image without a number has no fields.
    dictionary holds provinces, districts and words as address.correct takes them; without it addresses stay as read. again (image, text, score) are second readings of the crops of names that something is attached to.
    """
    return rows(read_pages("resident", _pages(lines, titles), today, again), dictionary)


def license_fields(lines: DataFrame, titles: DataFrame, today: Column, dictionary: dict[str, DataFrame] | None = None, again: DataFrame | None = None) -> DataFrame:
    """image, field, value, confidence, valid, verified, warnings, boxes and derived of the fields found on licences: rrn, license_number, license_region, license_types (joined by a
    bar), name, address, address_lines, aptitude_period (start~end), issue_date, issuer (of the closed list of police offices), serial_code and conditions (joined by a bar).

    Places are relative to the registration number: without it only the number, region and kinds of the licence are read. Arguments are as for resident_fields.
    """
    return rows(read_pages("license", _pages(lines, titles), today, again), dictionary)


def numbers(lines: DataFrame, today: Column) -> DataFrame:
    """image with the registration number's row of the fields, for images that have one."""
    titles = lines.select("image", "idx").limit(0)
    own = stored(_read(_pages(lines, titles), today, None, "resident"), "pages")
    return _found(own, F.col("found")).where("field = 'rrn'")


def merged_warnings(fields: DataFrame) -> DataFrame:
    """image and warnings: those of its fields, each once, in the fields' order of the alphabet."""
    held = fields.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("field", "warnings"))).alias("w"))
    return held.select("image", F.array_distinct(F.flatten(F.transform("w", lambda x: x["warnings"]))).alias("warnings"))

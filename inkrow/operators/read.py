"""One run from recognised lines to results: type of document, fields, further attempts, the best of them, and its record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkrow.operators import classify, decide, extract, layout, picture
from inkrow.operators.layout import first
from inkrow.sources.tables import growing, stored

#: Attempts by name, with the degrees that the picture is turned.
ROTATIONS = {"original": 0, "contrast": 0, "rot90": 90, "rot270": 270, "rot180": 180}


def looks(lines: DataFrame, titles: DataFrame) -> DataFrame:
    """image, n_lines, title_low and vertical from lines and titles (image, title: the idx of its title line, may be null), as of page_looks."""
    # how a page looks needs no characters
    return page_looks(layout.pages(lines.withColumn("chars", F.lit(None).cast("array<string>"))).join(titles.select("image", "title"), "image", "left"))


def page_looks(pages: DataFrame) -> DataFrame:
    """image, n_lines, title_low and vertical from pages (image, title, and lines as of layout.pages), and document_type if they have it; without lines the three are null.

    title_low: of three lines or more, the title's middle is below that at half of the sorted ones. vertical: over half of the lines of three characters or more are over one and a half times as high as wide.
    """
    middles = F.array_sort(F.transform("lines", lambda x: x["cy"]))
    title = first(F.filter("lines", lambda x: x["idx"] == F.col("title")))
    half = F.try_element_at(middles, (F.floor(F.size("lines") / 2) + 1).cast("int"))
    long_ = F.filter("lines", lambda x: F.length(x["text"]) >= 3)
    tall = F.filter(long_, lambda x: x["h"] > 1.5 * (x["x1"] - x["x0"]))
    any_ = lambda c: F.when(F.size("lines") > 0, c)
    return pages.select("image", *[c for c in pages.columns if c == "document_type"], any_(F.size("lines")).alias("n_lines"), any_(F.coalesce((F.size("lines") >= 3) & (title["cy"] > half), F.lit(False))).alias("title_low"), any_((F.size(long_) > 0) & (2 * F.size(tall) > F.size(long_))).alias("vertical"))


def fields(pages: DataFrame, today: Column, dictionary: dict[str, DataFrame] | None = None, again: DataFrame | None = None) -> DataFrame:
    """The fields of pages (image, document_type, title, lines and letters) by the extractor of each image's document_type. Images of no known type have none."""
    found = [extract.read_pages(kind, pages.where(F.col("document_type") == name), today, again) for name, kind in (("RESIDENT_CARD", "resident"), ("DRIVER_LICENSE", "license"))]
    # addresses of both kinds are set right together
    return extract.rows(found[0].unionByName(found[1]), dictionary)


@dataclass
class Attempts:
    """What was read of all attempts: texts (image and the boxes of its lines) and fields (their image is a struct of the image, as of, and the pass), and of each image the best attempt: of, pass, passes, document_type, n_lines."""

    texts: DataFrame
    fields: DataFrame
    best: DataFrame


def attempted(lines: DataFrame, today: Column, dictionary: dict[str, DataFrame] | None = None, strict: bool = False, again: DataFrame | None = None) -> Attempts:
    """Reads lines of all attempts (image, pass, idx, text, score, box, chars), pass being one of ROTATIONS, and chooses the best attempt of each image.

    The first attempt is the original; how it looks gives the order of the others, of which those without lines in the table are left out. Attempts stop at the first that is OK; the best is that of the
    better status, then of more accepted fields, then of higher mean confidence, then of a known type, then the earlier. strict makes numbers whose check digit disagrees invalid before attempts are
    compared. again (image, pass, text, score) are second readings of names, as extract.with_name takes them.
    """
    keyed = lambda df: df.withColumn("image", F.struct(F.col("image").alias("of"), F.col("pass").alias("pass"))).drop("pass")
    # the lines of an image meet once, for its type, its looks and its fields
    held = classify.typed(classify.scored(keyed(lines)), [layout.held(), F.collect_list("box").alias("texts")])
    pages = stored(extract.parted(layout.arranged(held)), "read-pages")
    found = fields(pages, today, dictionary, None if again is None else keyed(again))
    found = decide.strict_checksum(found) if strict else found
    ranked = page_looks(pages).join(growing(decide.ranks(found, pages)), "image", "left").select(F.col("image.of").alias("of"), F.col("image.pass").alias("pass"), "document_type", "n_lines", "title_low", "vertical", "status", "n_accepted", "mean_confidence")
    opening = ranked.where(F.col("pass") == "original").select("of", decide.attempt_order(F.col("vertical"), F.col("document_type") == "UNKNOWN", F.col("title_low")).alias("others"))
    # an image whose original has no line is looked at as one of unknown type
    default = decide.attempt_order(F.lit(False), F.lit(True), F.lit(False))
    placed = ranked.join(opening, "of", "left").withColumn("position", F.when(F.col("pass") == "original", 0).otherwise(F.array_position(F.coalesce("others", default), F.col("pass"))))
    best = decide.best_attempts(placed.withColumn("known", F.col("document_type") != "UNKNOWN"), "of", "position", "known").select("of", "pass", "passes", "document_type", "n_lines")
    return Attempts(pages.select("image", "texts"), found, stored(best, "read-best"))


def turn_of(attempt: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in ROTATIONS.items() for x in pair])[attempt]


def results(attempts: Attempts, images: DataFrame, mask: bool = False) -> DataFrame:
    """One result a row of images (image, decoded, width, height and scale of the upright picture; a null scale is 1), as decide.assemble gives it, with pass and passes: the attempt that it is from, and how many were made.

    Images may have no line. Boxes are turned back into the upright, unscaled picture. Each image has one row in images.
    """
    own = images.join(attempts.best, F.col("image") == F.col("of"), "left").drop("of")
    size = own.select("image", "pass", "width", "height", F.coalesce("scale", F.lit(1.0)).alias("scale")).dropDuplicates(["image"])
    found = attempts.fields
    chosen = found.select(F.col("image.of").alias("image"), F.col("image.pass").alias("pass"), *[c for c in found.columns if c != "image"]).join(size, ["image", "pass"])
    back = F.transform("boxes", lambda b: F.when(b.isNotNull(), layout.turned_back(b, turn_of(F.col("pass")), F.col("width"), F.col("height"), F.col("scale"))))
    chosen = chosen.withColumn("boxes", back).drop("pass", "width", "height", "scale")
    out = decide.assemble(chosen, own.select("image", "document_type", "n_lines", "decoded"), mask)
    return out.join(attempts.best.select(F.col("of").alias("image"), "pass", "passes"), "image", "left")


def checks(attempts: Attempts, images: DataFrame, signals: DataFrame) -> DataFrame:
    """image with ratio, method, face, reasons, inconclusive and suspicious (decide.document_checks) of the images of known types, on the picture as the best attempt turned it.

    images are image, width and height of the picture before it was turned; signals are image, outline, faces, detector, colour and clipped, found on the turned picture, null where they weren't looked for.
    """
    of, name = F.col("image.of").alias("image"), F.col("image.pass").alias("pass")
    known = attempts.best.where(F.col("document_type").isin(*decide.SPECS)).select(F.col("of").alias("image"), "pass", "document_type")
    number = attempts.fields.where("field = 'rrn'").select(of, name, first(F.col("boxes")).alias("rrn_box"))
    texts = attempts.texts.select(of, name, "texts")
    own = known.join(images.select("image", "width", "height"), "image").join(signals, "image", "left").join(number, ["image", "pass"], "left").join(texts, ["image", "pass"], "left")
    lying = turn_of(F.col("pass")).isin(90, 270)
    ratio = picture.card_ratio(F.col("outline"), F.when(lying, F.col("height")).otherwise(F.col("width")), F.when(lying, F.col("width")).otherwise(F.col("height")), F.col("texts"))
    own = own.withColumn("c", ratio).withColumns({"ratio": F.col("c.ratio"), "method": F.col("c.method")})
    return decide.document_checks(own).select("image", "ratio", "method", "face", "reasons", "inconclusive", "suspicious")

"""Spatial operators on recognised lines (image, idx, text, score, box: array of four points x, y)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkrow.functions.text import let

def bounds(lines: DataFrame, box: str = "box") -> DataFrame:
    """lines with x0, x1, y0, y1, h and cy of the box."""
    xs, ys = (F.transform(box, _part(k)) for k in "xy")
    out = lines.withColumns({"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)})
    return out.withColumns({"h": F.col("y1") - F.col("y0"), "cy": (F.col("y0") + F.col("y1")) / 2})


def _part(name: str):
    return lambda p: p[name]


def text_angle(lines: DataFrame) -> DataFrame:
    """image and angle in radians: the median slope of the top edges of lines of three characters or more that are over twice as wide as high; 0 without any."""
    edge = lambda a, b: F.hypot(F.col("box.x")[b] - F.col("box.x")[a], F.col("box.y")[b] - F.col("box.y")[a])
    fits = (F.length(F.trim("text")) >= 3) & (edge(0, 1) > 2 * edge(0, 3))
    slope = F.atan2(F.col("box.y")[1] - F.col("box.y")[0], F.col("box.x")[1] - F.col("box.x")[0])
    return lines.groupBy("image").agg(F.coalesce(F.median(F.when(fits, slope)), F.lit(0.0)).alias("angle"))


def reading_order(lines: DataFrame) -> DataFrame:
    """lines (with bounds) with place, from 1, by y0, x0 and idx."""
    return lines.withColumn("place", F.row_number().over(Window.partitionBy("image").orderBy("y0", "x0", "idx")))


def is_below(a: str, b: str) -> Column:
    return F.col(f"{a}.cy") > F.col(f"{b}.cy") + 0.5 * F.least(f"{a}.h", f"{b}.h")


def same_row(a: str, b: str) -> Column:
    return F.abs(F.col(f"{a}.cy") - F.col(f"{b}.cy")) <= 0.5 * F.least(f"{a}.h", f"{b}.h")


def rows(lines: DataFrame, joined: tuple[str, ...] = ()) -> DataFrame:
    """image, row (from 0), idxs in order of x0, text, score, and the box x0, x1, y0, y1 of each row of lines (with bounds); the arrays named in joined are strung together.

    Lines are taken by cy; one joins the last row if it is in the same row as any of its members, else it opens another. An image's lines are
    few, so that they are folded as one array.
    """
    item = F.struct("cy", "idx", "x0", "x1", "y0", "y1", "h", "text", "score", *joined)
    held = lines.groupBy("image").agg(F.array_sort(F.collect_list(item)).alias("items"))
    of = f"array<array<{lines.select(item.alias('s')).schema['s'].dataType.simpleString()}>>"

    def step(done: Column, line: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = F.exists(last, lambda m: F.abs(m["cy"] - line["cy"]) <= 0.5 * F.least(m["h"], line["h"]))
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last, F.array(line))))
        return F.when((F.size(done) > 0) & F.coalesce(joins, F.lit(False)), grown).otherwise(F.concat(done, F.array(F.array(line))))

    folded = held.select("image", F.posexplode(F.aggregate("items", F.array().cast(of), step)).alias("row", "members"))
    ordered = F.array_sort("members", lambda a, b: F.when(a["x0"] < b["x0"], -1).when(a["x0"] > b["x0"], 1).otherwise(0))
    out = folded.withColumn("members", ordered)
    get = lambda k: F.transform("members", _part(k))
    return out.select("image", "row", get("idx").alias("idxs"), F.array_join(get("text"), " ").alias("text"), F.array_min(get("score")).alias("score"), F.array_min(get("x0")).alias("x0"), F.array_max(get("x1")).alias("x1"), F.array_min(get("y0")).alias("y0"), F.array_max(get("y1")).alias("y1"), *[F.flatten(get(c)).alias(c) for c in joined])


def page_shape(lines: DataFrame) -> DataFrame:
    """image, middle (the cy at half of the sorted ones) and vertical: whether over half of the lines of three characters or more are over one and a half times as high as wide."""
    long_ = F.length(F.trim("text")) >= 3
    tall = F.count_if(long_ & (F.col("h") > 1.5 * (F.col("x1") - F.col("x0"))))
    centres = F.array_sort(F.collect_list("cy"))
    return lines.groupBy("image").agg(F.element_at(centres, (F.floor(F.size(centres) / 2) + 1).cast("int")).alias("middle"), (2 * tall > F.count_if(long_)).alias("vertical"))


def turned_back(box: Column, rotation: Column, width: Column, height: Column, scale: Column) -> Column:
    """A box found on a picture turned clockwise by 0, 90, 180 or 270 degrees, in the coordinates of the upright picture of that width and height before it was scaled; rounded to a tenth."""

    def back(p: Column) -> Column:
        x = F.when(rotation == 90, p["y"]).when(rotation == 180, width - 1 - p["x"]).when(rotation == 270, width - 1 - p["y"]).otherwise(p["x"])
        y = F.when(rotation == 90, height - 1 - p["x"]).when(rotation == 180, height - 1 - p["y"]).when(rotation == 270, p["x"]).otherwise(p["y"])
        return F.struct(F.round(x / scale, 1).alias("x"), F.round(y / scale, 1).alias("y"))

    return F.transform(box, back)


def first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def is_low(low: Column, high: Column) -> Column:
    """Whether a line is below another by more than half of the lesser height."""
    return low["cy"] > high["cy"] + 0.5 * F.least(low["h"], high["h"])


def same_line(a: Column, b: Column) -> Column:
    return F.abs(a["cy"] - b["cy"]) <= 0.5 * F.least(a["h"], b["h"])


def none_of(lines: Column) -> Column:
    """An empty array of the lines' type."""
    return F.slice(lines, 1, 0)


def items(lines: Column, *by: str) -> Column:
    """The lines in order of the named numbers."""
    keyed = F.transform(lines, lambda x: F.struct(*[x[b].alias(f"k{i}") for i, b in enumerate(by)], x.alias("line")))
    return F.transform(F.array_sort(keyed), lambda k: k["line"])


def lowest(lines: Column, by: str) -> Column:
    """The line with the most of the named number, the first of equals; null without lines."""
    best = lambda own: let(F.array_max(F.transform(own, lambda x: x[by])), lambda most: first(F.filter(own, lambda x: x[by] == most)))
    return let(lines, best)


def pages(lines: DataFrame, least_degrees: float = 1.0) -> DataFrame:
    """image and lines: the lines of an image as one array in reading order, of (place, idx, text, score, box, chars, x0, x1, y0, y1, h, cy).

    Blank lines go. Bounds are those of the box turned back by the median angle of the lines' top edges, if that is a degree or more; box stays as it was.
    """
    return arranged(lines.where(F.trim("text") != "").groupBy("image").agg(held()), least_degrees)


def held() -> Column:
    """The lines of an image that aren't blank, as arranged() takes them."""
    return F.collect_list(F.when(F.trim("text") != "", F.struct("idx", "text", "score", "box", "chars"))).alias("held")


def arranged(held: DataFrame, least_degrees: float = 1.0) -> DataFrame:
    """held (image, held and other columns) with the lines of pages() in place of held."""
    others = [c for c in held.columns if c != "held"]
    side = lambda b, i, j: F.hypot(b[j]["x"] - b[i]["x"], b[j]["y"] - b[i]["y"])
    flat = F.filter("held", lambda x: (F.length(F.trim(x["text"])) >= 3) & (side(x["box"], 0, 1) > 2 * side(x["box"], 0, 3)))
    slopes = F.array_sort(F.transform(flat, lambda x: F.atan2(x["box"][1]["y"] - x["box"][0]["y"], x["box"][1]["x"] - x["box"][0]["x"])))
    held = held.withColumn("slopes", slopes)
    middle = lambda k: F.try_element_at("slopes", (F.floor((F.size("slopes") + k) / 2)).cast("int"))
    angle = F.when(F.size("slopes") > 0, (F.try_element_at("slopes", F.greatest(F.floor((F.size("slopes") + 1) / 2), F.lit(1)).cast("int")) + middle(2)) / 2).otherwise(0.0)
    held = held.withColumn("turn", F.when(F.abs(angle) >= math.radians(least_degrees), -angle).otherwise(0.0))
    turn = F.col("turn")

    def bounded(x: Column) -> Column:
        xs = F.when(turn == 0, x["box"]["x"]).otherwise(F.transform(x["box"], lambda p: p["x"] * F.cos(turn) - p["y"] * F.sin(turn)))
        ys = F.when(turn == 0, x["box"]["y"]).otherwise(F.transform(x["box"], lambda p: p["x"] * F.sin(turn) + p["y"] * F.cos(turn)))
        return let(F.struct(xs.alias("x"), ys.alias("y")), lambda b: F.struct(F.array_min(b["y"]).alias("y0"), F.array_min(b["x"]).alias("x0"), x["idx"].alias("idx"), F.array_max(b["x"]).alias("x1"), F.array_max(b["y"]).alias("y1"), x.alias("own")))

    def whole(b: Column, i: Column) -> Column:
        own = b["own"]
        return F.struct((i + 1).alias("place"), b["idx"].alias("idx"), own["text"].alias("text"), own["score"].alias("score"), own["box"].alias("box"), own["chars"].alias("chars"), *[b[c].alias(c) for c in ("x0", "x1", "y0", "y1")], (b["y1"] - b["y0"]).alias("h"), ((b["y0"] + b["y1"]) / 2).alias("cy"))

    return held.withColumn("sorted", F.array_sort(F.transform("held", bounded))).select(*others, F.transform("sorted", whole).alias("lines"))


def rows_of(lines: Column) -> Column:
    """Rows of lines (arrays in order of x0) from the top: by cy, a line joins the last row if it is in the same row as any of its members, else it opens another."""

    def step(done: Column, line: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = F.coalesce(F.exists(last, lambda m: same_line(m, line)), F.lit(False))
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, F.array(line))))
        return F.when(joins, grown).otherwise(F.concat(done, F.array(F.array(line))))

    folded = let(lines, lambda own: F.aggregate(items(own, "cy", "place"), F.slice(F.array(own), 1, 0), step))
    return F.transform(folded, lambda r: items(r, "x0", "place"))


def texts(row: Column, each=None) -> Column:
    """The texts of a row's lines, joined by spaces."""
    return F.array_join(F.transform(row, lambda x: each(x["text"]) if each else x["text"]), " ")


def merged(row: Column) -> Column:
    """A row as one line: texts joined, the least score, the box around all, characters strung together where every line has them."""
    low = lambda c: F.array_min(F.transform(row, lambda x: x[c]))
    high = lambda c: F.array_max(F.transform(row, lambda x: x[c]))
    chars = F.flatten(F.transform(row, lambda x: x["chars"]))
    return F.struct(low("place").alias("place"), row[0]["idx"].alias("idx"), texts(row).alias("text"), low("score").alias("score"), union_box(row).alias("box"), chars.alias("chars"), low("x0").alias("x0"), high("x1").alias("x1"), low("y0").alias("y0"), high("y1").alias("y1"), (high("y1") - low("y0")).alias("h"), ((low("y0") + high("y1")) / 2).alias("cy"))


def quad(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    point = lambda x, y: F.struct(F.round(x, 1).alias("x"), F.round(y, 1).alias("y"))
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def union_box(lines: Column) -> Column:
    """The upright box around the boxes of the lines, rounded to a tenth; null without lines."""
    part = lambda points, k: F.transform(points, _part(k))
    around = lambda p: F.when(F.size(p) > 0, quad(F.array_min(part(p, "x")), F.array_min(part(p, "y")), F.array_max(part(p, "x")), F.array_max(part(p, "y"))))
    return let(F.flatten(F.transform(lines, lambda x: x["box"])), around)


def chars_box(box: Column, chars: Column) -> Column:
    """The box of some characters of a line: their range across, the line's height; the line's box without characters or where they have no boxes."""
    xs = F.transform(F.flatten(F.transform(chars, lambda c: c["box"])), _part("x"))
    ys = F.transform(box, _part("y"))
    return F.when(F.size(xs) > 0, quad(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))).otherwise(box)


def leading_chars(chars: Column, fits) -> Column:
    """The characters before the first whose text doesn't fit."""
    stop = F.array_position(F.transform(chars, lambda c: fits(c["text"])), False).cast("int")
    return F.when(stop > 0, F.slice(chars, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(chars)


def trailing_chars_after(chars: Column, stops) -> Column:
    """The characters after the last whose text stops."""
    last = F.array_max(F.transform(chars, lambda c, i: F.when(stops(c["text"]), i + 1).otherwise(0)))
    return F.slice(chars, F.coalesce(last, F.lit(0)) + 1, F.greatest(F.size(chars), F.lit(0)))

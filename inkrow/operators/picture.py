"""Signals of a picture: the card's ratio from its outline, and the colours of its background from a table of pixels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkrow.functions.text import let

#: Least share of the picture's width that texts span where the picture is taken for the card; how far face boxes are widened, up, down and to each side, by their height and width.
LEAST_SPAN, FACE_UP, FACE_DOWN, FACE_SIDE = 0.6, 0.9, 1.3, 0.8
#: Most saturation of a background's pixel, least pixels, the level of burnt-out ones, and the scale of the colourfulness.
SATURATION, LEAST_PIXELS, BURNT, SCALE, DARKEST = 110, 1000, 250, 200.0, 40.0


def ordered_corners(outline: Column) -> Column:
    """Four points from the upper left one clockwise: those of the least sum of x and y, the least y - x, the most sum, the most y - x; the first of equals."""
    total, slope = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])

    def extreme(points: Column, by, sign: int) -> Column:
        values = F.transform(points, lambda p: sign * by(p))
        return F.element_at(points, F.array_position(values, F.array_min(values)).cast("int"))

    return let(outline, lambda o: F.array(extreme(o, total, 1), extreme(o, slope, 1), extreme(o, total, -1), extreme(o, slope, -1)))


def card_ratio(outline: Column, width: Column, height: Column, boxes: Column) -> Column:
    """(ratio, method): long over short side of a card's outline (four points, any order), each the mean of opposite sides: method contour; null ratio for one without extent.

    Without an outline the card fills the picture: the picture's ratio, method frame; null where the boxes of its texts (null or empty: none known) span less than LEAST_SPAN of the width.
    """
    side = lambda c, i, j: F.hypot(c[j]["x"] - c[i]["x"], c[j]["y"] - c[i]["y"])
    across = lambda c: F.struct(((side(c, 0, 1) + side(c, 3, 2)) / 2).alias("w"), ((side(c, 1, 2) + side(c, 0, 3)) / 2).alias("h"))
    ratio = lambda s: F.when(F.least(s["w"], s["h"]) > 0, F.greatest(s["w"], s["h"]) / F.least(s["w"], s["h"]))
    xs = F.transform(F.flatten(boxes), lambda p: p["x"])
    narrow = F.coalesce(F.array_max(xs) - F.array_min(xs) < LEAST_SPAN * width, F.lit(False))
    frame = F.struct(F.when(~narrow, F.try_divide(F.greatest(width, height).cast("double"), F.least(width, height).cast("double"))).alias("ratio"), F.lit("frame").alias("method"))
    return F.when(outline.isNotNull(), F.struct(let(ordered_corners(outline), lambda c: let(across(c), ratio)).alias("ratio"), F.lit("contour").alias("method"))).otherwise(frame)


def around(points: list | None) -> list | None:
    """The corners of the convex hull of points (with x and y), in order around it; None for fewer than three points."""

    def half(own: list) -> list:
        out: list = []
        for p in own:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    if points is None or len(points) < 3:
        return None
    own = sorted({(p["x"], p["y"]) for p in points})
    return [{"x": x, "y": y} for x, y in (half(own) + half(own[::-1]) if len(own) > 1 else own)]


def hull(points: Column | str) -> Column:
    """The convex hull of each array of points, its corners in order around it; null for fewer than three points."""

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def of(held: pd.Series) -> pd.Series:
        return held.map(around)

    return of(points)


def inside(polygon: Column, x: Column, y: Column) -> Column:
    """Whether a point is in a convex polygon or on its border; corners may go round either way."""
    def turns(own: Column) -> Column:
        following = F.concat(F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), F.slice(own, 1, 1))
        return F.zip_with(own, following, lambda p, q: (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"]))

    return let(let(polygon, turns), lambda t: F.forall(t, lambda c: c >= 0) | F.forall(t, lambda c: c <= 0))


def whole(polygon: Column) -> Column:
    """A polygon's corners cut to whole pixels."""
    return F.transform(polygon, lambda p: F.struct(p["x"].cast("long").cast("double").alias("x"), p["y"].cast("long").cast("double").alias("y")))


def background(pixels: DataFrame, images: DataFrame, least: int = LEAST_PIXELS) -> DataFrame:
    """image, colour, brightness and clipped of every row of images: pixels are (image, x, y, r, g, b), images are (image, boxes, outline, faces), a row each.

    Pixels count that are in the convex hull of all corners of the boxes of texts (texts are on the card), and in the card's outline if there is one, but in no box, no
    face's surroundings (faces: x0, y0, x1, y1; a photograph is around them), and aren't saturated (seals are; the print of the background isn't). colour is their colourfulness in proportion to their brightness,
    clipped the share of those burnt out. All are null with fewer than least pixels, or fewer than three corners. Null arrays are empty.

    A picture has few boxes, so they go with its pixels as arrays; pixels are tested one by one and added up before they are shuffled.
    """
    shapes = images.select("image", "outline", F.transform("boxes", whole).alias("boxes"), hull(F.flatten("boxes")).alias("hull"), "faces")
    shapes = shapes.withColumn("hull", whole(F.col("hull")))
    x, y = F.col("x"), F.col("y")
    cut = lambda c: F.greatest(c.cast("long"), F.lit(0))
    h, w = (lambda f: f["y1"] - f["y0"]), (lambda f: f["x1"] - f["x0"])
    near = lambda f: (y >= cut(f["y0"] - FACE_UP * h(f))) & (y < (f["y1"] + FACE_DOWN * h(f)).cast("long")) & (x >= cut(f["x0"] - FACE_SIDE * w(f))) & (x < (f["x1"] + FACE_SIDE * w(f)).cast("long"))
    top, low = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    saturation = F.when(top > 0, F.round((top - low) * 255.0 / top)).otherwise(0)
    none = lambda c: ~F.coalesce(c, F.lit(False))
    fits = inside(F.col("hull"), x, y) & (F.col("outline").isNull() | inside(whole(F.col("outline")), x, y)) & none(F.exists("boxes", lambda b: inside(b, x, y))) & none(F.exists("faces", near)) & (saturation <= SATURATION)
    kept = pixels.join(shapes.where("hull IS NOT NULL"), "image").where(fits)
    rg, yb = F.col("r") - F.col("g"), 0.5 * (F.col("r") + F.col("g")) - F.col("b")
    sums = kept.groupBy("image").agg(
        F.count("*").alias("n"), F.hypot(F.stddev_pop(rg), F.stddev_pop(yb)).alias("spread"), F.hypot(F.avg(rg), F.avg(yb)).alias("shift"),
        (F.avg(F.col("r") + F.col("g") + F.col("b")) / 3).alias("brightness"), F.avg((low >= BURNT).cast("int")).alias("clipped"),
    )
    sums = sums.where(F.col("n") >= least)
    colour = (F.col("spread") + 0.3 * F.col("shift")) * SCALE / F.greatest("brightness", F.lit(DARKEST))
    return images.select("image").join(sums.select("image", colour.alias("colour"), "brightness", "clipped"), "image", "left")

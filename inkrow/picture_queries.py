"""Queries on outlines and pixels made of the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkrow.operators import decide, picture
from inkrow.sources.tables import table


def _point(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def card_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines made of line items, their corners in four orders, with the ratio and what is thought of it; every fifth line has none, so that the picture's frame stands for it."""
    part, supplier, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    x, y, w, h = part % 50, supplier % 40, (part % 13) * 40 + 300, F.when(part % 29 == 0, 0).otherwise((supplier % 11) * 10 + 250)
    corners = [_point(x, y), _point(x + w, y + line), _point(x + w - line, y + h), _point(x + line, y + h - 2)]
    outline = F.when(part % 29 == 0, F.array(*[_point(x, y)] * 4)).otherwise(F.element_at(F.array(*[F.array(*corners[k:], *corners[:k]) for k in range(4)]), (part % 4 + 1).cast("int")))
    boxes = F.when(line > 1, F.array(F.array(_point(x, y), _point(x + 10, y), _point(x + 10, y + 10), _point(x, y + 10)), F.array(_point(part % 1000, y), _point(part % 1000 + 5, y))))
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", picture.card_ratio(F.when(part % 5 > 0, outline), F.lit(1000), F.lit(620), boxes).alias("c"))
    rows = own.select("l_orderkey", "l_linenumber", F.col("c.ratio").alias("ratio"), F.col("c.method").alias("method"))
    box, faces = F.lit(None).cast("array<struct<x:double,y:double>>"), F.lit(None).cast("array<struct<x0:double,y0:double,x1:double,y1:double,score:double>>")
    checked = decide.document_checks(rows.withColumns({"document_type": F.lit("RESIDENT_CARD"), "rrn_box": box, "faces": faces, "detector": F.lit(False), "colour": F.lit(None).cast("double"), "clipped": F.lit(None).cast("double")}))
    return checked.select("l_orderkey", "l_linenumber", F.round("ratio", 6).alias("ratio"), "method", F.array_join("reasons", "|").alias("reasons"), F.array_join("inconclusive", "|").alias("inconclusive"))


def backgrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures made of suppliers, their pixels of line items: three boxes of texts, a face on every third, an outline on every second."""
    key = F.col("s_suppkey")
    quad = lambda x, y, w, h: F.array(_point(x, y), _point(x + w, y), _point(x + w, y + h), _point(x, y + h))
    boxes = F.when(key % 10 > 0, F.array(quad(key % 7 + 5, key % 5 + 4, F.lit(20), F.lit(6)), quad(key % 11 + 60, key % 9 + 10, F.lit(25), F.lit(5)), quad(key % 13 + 20, F.lit(80) - key % 3, F.lit(40), F.lit(8))))
    outline = F.when(key % 2 == 0, F.array(_point(F.lit(10), F.lit(0)), _point(F.lit(100), F.lit(5)), _point(F.lit(90), F.lit(95)), _point(F.lit(0), F.lit(90))))
    faces = F.when(key % 3 == 0, F.array(F.struct(F.lit(50.0).alias("x0"), F.lit(40.0).alias("y0"), F.lit(56.0).alias("x1"), F.lit(48.0).alias("y1"))))
    images = table(spark, sf_dir, "supplier").select(key.alias("image"), boxes.alias("boxes"), outline.alias("outline"), faces.alias("faces"))
    order, part = F.col("l_orderkey"), F.col("l_partkey")
    shade = lambda k: ((order * 7 + part * k) % 90 + 165).cast("int")
    pixels = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("image"), (order % 100).alias("x"), (part * 7 % 100).alias("y"), F.when(part % 23 == 0, 255).otherwise(shade(3)).alias("r"), F.when(part % 23 == 0, 254).otherwise(shade(5)).alias("g"), F.when(part % 23 == 0, 250).when(part % 31 == 0, 20).otherwise(shade(11)).alias("b"))
    out = picture.background(pixels, images, least=40)
    return out.select("image", *[F.round(c, 6).alias(c) for c in ("colour", "brightness", "clipped")])


QUERIES = {f.__name__: f for f in (card_ratios, backgrounds)}
SQL = {
    "card_ratios": """WITH v AS (
        SELECT l_orderkey, l_linenumber, l_partkey AS p, CAST(l_partkey % 13 * 40 + 300 AS DOUBLE) AS w, CAST(l_suppkey % 11 * 10 + 250 AS DOUBLE) AS h, CAST(l_linenumber AS DOUBLE) AS n,
          greatest(l_partkey % 50 + 10, l_partkey % 1000 + 5) - least(l_partkey % 50, l_partkey % 1000) AS span FROM lineitem),
      s AS (SELECT *, (sqrt(w * w + n * n) + sqrt((w - 2 * n) * (w - 2 * n) + 4)) / 2 AS a, (sqrt(n * n + (h - n) * (h - n)) + sqrt(n * n + (h - 2) * (h - 2))) / 2 AS b FROM v),
      r AS (SELECT *, CASE WHEN p % 5 > 0 THEN 'contour' ELSE 'frame' END AS method, CASE WHEN p % 5 = 0 THEN CASE WHEN l_linenumber = 1 OR span >= 600 THEN 1000 / 620.0 END WHEN p % 29 > 0 THEN greatest(a, b) / least(a, b) END AS ratio FROM s)
      SELECT l_orderkey, l_linenumber, round(ratio, 6) AS ratio, method, CASE WHEN method = 'contour' AND abs(ratio / (85.6 / 54.0) - 1) > 0.1 THEN 'CARD_ASPECT' ELSE '' END AS reasons,
        CASE WHEN method = 'frame' AND ratio IS NOT NULL THEN 'CARD_EDGES_NOT_VISIBLE' ELSE '' END AS inconclusive FROM r""",
    "backgrounds": """WITH q AS (
        SELECT s_suppkey AS k, unnest([{'x': s_suppkey % 7 + 5, 'y': s_suppkey % 5 + 4, 'w': 20, 'h': 6}, {'x': s_suppkey % 11 + 60, 'y': s_suppkey % 9 + 10, 'w': 25, 'h': 5}, {'x': s_suppkey % 13 + 20, 'y': 80 - s_suppkey % 3, 'w': 40, 'h': 8}]) AS b
        FROM supplier WHERE s_suppkey % 10 > 0),
      c AS (SELECT DISTINCT k, b.x + b.w * i AS x, b.y + b.h * j AS y FROM q, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS s(i, j)),
      e AS (
        SELECT a.k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM c a JOIN c b ON a.k = b.k AND (a.x <> b.x OR a.y <> b.y) JOIN c o ON o.k = a.k
        GROUP BY ALL HAVING min((b.x - a.x) * (o.y - a.y) - (b.y - a.y) * (o.x - a.x)) >= 0),
      p AS (
        SELECT row_number() OVER () AS id, l_suppkey AS k, l_orderkey % 100 AS x, l_partkey * 7 % 100 AS y, CASE WHEN l_partkey % 23 = 0 THEN 255 ELSE (l_orderkey * 7 + l_partkey * 3) % 90 + 165 END AS r,
          CASE WHEN l_partkey % 23 = 0 THEN 254 ELSE (l_orderkey * 7 + l_partkey * 5) % 90 + 165 END AS g, CASE WHEN l_partkey % 23 = 0 THEN 250 WHEN l_partkey % 31 = 0 THEN 20 ELSE (l_orderkey * 7 + l_partkey * 11) % 90 + 165 END AS b FROM lineitem),
      i AS (SELECT p.id, any_value(p.k) AS k, any_value(x) AS x, any_value(y) AS y, any_value(r) AS r, any_value(g) AS g, any_value(b) AS b FROM p JOIN e ON p.k = e.k GROUP BY p.id HAVING min((bx - ax) * (y - ay) - (by_ - ay) * (x - ax)) >= 0),
      f AS (
        SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.k = i.k AND i.x BETWEEN q.b.x AND q.b.x + q.b.w AND i.y BETWEEN q.b.y AND q.b.y + q.b.h)
          AND (k % 2 > 0 OR (90 * y - 5 * (x - 10) >= 0 AND -10 * (y - 5) - 90 * (x - 100) >= 0 AND -90 * (y - 95) + 5 * (x - 90) >= 0 AND 10 * (y - 90) + 90 * x >= 0))
          AND NOT (k % 3 = 0 AND y >= 32 AND y < 58 AND x >= 45 AND x < 60) AND round((greatest(r, g, b) - least(r, g, b)) * 255.0 / greatest(r, g, b)) <= 110),
      a AS (
        SELECT k, sqrt(var_pop(r - g) + var_pop(0.5 * (r + g) - b)) AS spread, sqrt(avg(r - g) * avg(r - g) + avg(0.5 * (r + g) - b) * avg(0.5 * (r + g) - b)) AS shift, avg(r + g + b) / 3 AS brightness, avg(CASE WHEN least(r, g, b) >= 250 THEN 1 ELSE 0 END) AS clipped
        FROM f GROUP BY k HAVING count(*) >= 40)
      SELECT s_suppkey AS image, round((spread + 0.3 * shift) * 200 / greatest(brightness, 40), 6) AS colour, round(brightness, 6) AS brightness, round(clipped, 6) AS clipped FROM supplier LEFT JOIN a ON k = s_suppkey""",
}

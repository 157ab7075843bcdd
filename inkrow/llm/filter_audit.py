"""Audit of how filters interact: Walsh-Hadamard parity sums, inverted to counts of every mask of failures."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkrow.llm._common import stored

#: The filters by letter, in the order of their bits in a mask, and the conditions of a failure.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 2, "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LABELS = ("every", "good", "toxic")
MASKS = 1 << len(FILTERS)


def text_failures(text: Column) -> Column:
    """Mask of the filters that a text fails by itself (A to D); null is the empty text.

    A: under 200 words; B: distinct words are under half of the words; C: capitals A-Z are over 2 % of the characters; D: it has one of # $ % & * |.
    Words are runs of anything but ASCII white space.
    """
    own = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(own, r"[\x20\x09-\x0D]+"), "")
    # a hundred times the characters of a very long text is more than an int holds
    n, distinct, chars = (x.cast("long") for x in (F.size(words), F.size(F.array_distinct(words)), F.length(own)))
    capitals = chars - F.length(F.translate(own, CAPITALS, ""))
    fails = [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * chars, own.rlike(SIGNS)]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """A row a row of docs: part (null: empty), mask of the filters that it fails, good (a label has quality 1) and toxic (a label has toxic 1).

    Filter E is failed by a text of which a smaller id has an identical one, in any part. Rows that repeat an id and its text don't fail on account of each other; a
    null id is larger than all others. Labels that repeat an id count together; ids without labels, and null ids, are neither good nor toxic.
    """
    # equal texts meet by digest, as texts they travel nowhere
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    own = stored(docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), digest.alias("digest"), text_failures(F.col(text)).alias("own")), "audit-texts")
    # by digest and id, not by digest alone: a text that a third of all rows share has many ids
    lows = own.groupBy("digest").agg(F.min("id").alias("low")).select(F.col("digest").alias("of"), "low", F.lit(True).alias("first"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    both = own.join(lows, (F.col("digest") == F.col("of")) & F.col("id").eqNullSafe(F.col("low")), "left")
    both = both.select("id", "part", (F.col("own") + F.when(F.col("first"), 0).otherwise(1 << 4)).alias("mask"))
    marked = both.join(marks, "id", "left")
    return marked.select("part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def parity(mask: Column, of: int | Column) -> Column:
    """1 where mask and of share an even number of bits, else -1."""
    of = F.lit(of) if isinstance(of, int) else of
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(of)) % 2)


def parity_sums(rows: DataFrame) -> DataFrame:
    """part with, for each of LABELS, the array of 32 sums: at place w + 1 that of parity(mask, w) over the part's rows of that label. Linear in the rows, so that Spark adds them up before the shuffle."""
    of = {"every": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    sums = [F.sum(F.when(of[name], parity(F.col("mask"), w)).otherwise(0)).cast("long").alias(f"{name}{w}") for name in LABELS for w in range(MASKS)]
    wide = rows.groupBy("part").agg(*sums)
    return wide.select("part", *[F.array(*[F.col(f"{name}{w}") for w in range(MASKS)]).alias(name) for name in LABELS])


def cells(sums: Column) -> Column:
    """The counts of rows of each mask, at place mask + 1: the transform is its own inverse but for the factor 32, so that division is exact."""
    every = F.sequence(F.lit(0), F.lit(MASKS - 1))
    one = lambda m: F.aggregate(F.zip_with(sums, every, lambda s, w: s * parity(w, m)), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(every, lambda m: (one(m) / MASKS).cast("long"))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Per part, filter_order (each of the 120) and step (1 to 5): kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Filters are applied in that order; the step's filter removes the rows that fail it and none before it (removed), while those it fails too but that are gone already are redundant.
    unique_fails are rows that fail this filter only; good_lost and toxic_lost are the labelled ones among removed. shapley is the filter's removed summed over all orders: of the
    k filters that a row fails each comes first in 120 / k of the orders. Every part has 600 rows; an empty table has no part. All counts follow from 32 parity sums a
    part and label, so that the documents are read once, whatever the number of orders. Failures are those of failures().
    """
    counted = parity_sums(failures(docs, labels, key, text, part)).select("part", *[cells(F.col(name)).alias(name) for name in LABELS])
    orders = F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])
    bits = F.transform(F.split("filter_order", ""), lambda c: F.call_function("shiftleft", F.lit(1), F.position(c, F.lit(FILTERS)) - 1))
    steps = counted.withColumn("filter_order", F.explode(orders)).withColumn("bits", bits).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    before = F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, x: a + x)
    steps = steps.withColumns({"own": F.element_at("bits", F.col("step")), "before": before})
    places = F.sequence(F.lit(0), F.lit(MASKS - 1))
    fails, gone = (lambda m: m.bitwiseAND(F.col("own")) != 0), (lambda m: m.bitwiseAND(F.col("before")) != 0)
    total = lambda name, weight: F.aggregate(F.zip_with(F.col(name), places, lambda n, m: n * weight(m)), F.lit(0).cast("long"), lambda a, x: a + x)
    when = lambda test: lambda m: F.when(test(m), 1).otherwise(0)
    removed = when(lambda m: fails(m) & ~gone(m))
    first = lambda m: F.when(fails(m), F.lit(120) / F.bit_count(m)).otherwise(0).cast("long")
    return steps.select(
        "part", "filter_order", "step",
        total("every", when(lambda m: m.bitwiseAND(F.col("own") + F.col("before")) == 0)).alias("kept"),
        total("every", removed).alias("removed"),
        total("every", when(lambda m: fails(m) & gone(m))).alias("redundant"),
        total("every", when(lambda m: m == F.col("own"))).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("every", first).alias("shapley"),
    )

"""Benchmark decontamination: a prefix-filtered join of word shingles, verified over item-sized windows. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkrow.llm._common import free, stored

#: Words of a window, and of the shingles that are its tokens.
WINDOW, SHINGLE = 10, 3
#: Windows up to so many, with so many bytes of words, are broadcast; beyond either, Spark shuffles both sides.
MOST_BROADCAST, MOST_BYTES = 200_000, 32 << 20
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str | Column) -> Column:
    """Words of digits, letters a-z (A-Z lower-cased) and all characters beyond ASCII; null has none."""
    lowered = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def windows(benchmark: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """Distinct windows (item, words) of size consecutive words; an item of fewer, but not none, is one window."""
    own = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), words(text).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return own.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("words")).distinct()


def shingles(size: int, of: str = "words") -> Column:
    """All runs of size words as structs of positions k0, k1, ..."""
    n = F.size(of) - size + 1
    parts = [F.slice(of, F.lit(k + 1), F.greatest(n, F.lit(0))).alias(f"k{k}") for k in range(size)]
    return F.arrays_zip(*parts)


def keys(size: int) -> list[str]:
    return [f"k{k}" for k in range(size)]


def occurrences(docs: DataFrame, wins: DataFrame, size: int, broadcast: bool) -> DataFrame:
    """(id columns, start, n, item) of every occurrence of the windows whose shingles have size words.

    Prefix filter: a window is contained only if all its shingles are, so its rarest shingle is prefix enough. Rarity is
    the count of the shingle in all of docs. Joined on that shingle, a document must have as many words before and after it as
    the window has, and then the same words.
    """
    small = F.broadcast if broadcast else lambda x: x
    on = keys(size)
    marked = wins.withColumn("win", F.xxhash64("words")).select("words", F.posexplode(shingles(size)).alias("at", "s")).select("words", "at", *[F.col(f"s.k{k}").alias(f"k{k}") for k in range(size)]).distinct()
    in_docs = docs.select(F.explode(shingles(size)).alias("s")).select(*[F.col(f"s.k{k}").alias(f"k{k}") for k in range(size)])
    counted = in_docs.join(small(marked.select(*on).distinct()), on, "left_semi").groupBy(*on).agg(F.count("*").alias("df"))
    # a shingle that isn't in docs counts as the rarest; its window then has no candidate
    ranked = marked.join(counted, on, "left").fillna(0, ["df"]).withColumn("r", F.row_number().over(Window.partitionBy("words").orderBy("df", "at", *on)))
    prefix = ranked.where("r = 1 AND df > 0").select("at", *on, F.col("words").alias("window"))
    prefix = stored(prefix, "decontaminate-prefix")
    # beyond a broadcast the words don't go through the shuffle with each of their shingles: candidates fetch them afterwards
    held = ["id", "text_key", *(["words"] if broadcast else [F.size("words").alias("n_words")])]
    placed = docs.select(*held, F.posexplode(shingles(size)).alias("pos", "s"))
    placed = placed.select(*[c for c in placed.columns if c != "s"], *[F.col(f"s.k{k}").alias(f"k{k}") for k in range(size)])
    start, n = F.col("pos") - F.col("at"), F.size("window")
    fits = (start >= 0) & (start + n <= (F.size("words") if broadcast else F.col("n_words")))
    found = placed.join(small(prefix), on).where(fits).withColumn("start", start)
    if not broadcast:
        found = stored(found.select("id", "text_key", "start", "window").distinct(), "decontaminate-candidates").alias("f")
        own = docs.join(found.select("text_key").distinct(), "text_key", "left_semi").select("text_key", "words").dropDuplicates(["text_key"]).alias("d")
        found = found.join(own, "text_key").select("f.id", "text_key", "start", "window", "words")
    found = found.where(F.slice("words", F.col("start") + 1, n) == F.col("window"))
    return found.select("id", "text_key", "start", n.alias("n"), "window")


def overlap(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs (key and text only) with n_words, n_hit, n_items, items_sha256 and contaminated.

    A word is hit if it is inside any occurrence of any window; items are those with occurring windows, their ids as
    strings. Every input row gives a row, repeated rows and null keys too. Null or empty text has no words; items
    without words have no window, a null item id reads as the empty string, items that repeat an id count as one.
    """
    return hits(docs, benchmark, key, text, item, item_text, window).drop("text_key")


def hits(docs: DataFrame, benchmark: DataFrame, key: str, text: str, item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """overlap() with text_key, the digest of each row's text."""
    # equal rows get equal results, so that they are one document until the end
    own = docs.select(F.col(key).alias("id"), F.md5(F.coalesce(text, F.lit(""))).alias("text_key"), words(text).alias("words"))
    wins = stored(windows(benchmark, item, item_text, window), "decontaminate-windows")
    held = F.sum(F.octet_length(F.array_join("words", " ")).cast("long"))
    by_size = {r["size"]: (r["n"], r["held"]) for r in wins.groupBy(F.least(F.size("words"), F.lit(SHINGLE)).alias("size")).agg(F.count("*").alias("n"), held.alias("held")).collect()}
    parts = []
    for size, (n, n_bytes) in sorted(by_size.items()):
        of_size = F.size("words") >= SHINGLE if size == SHINGLE else F.size("words") == size
        parts.append(occurrences(own, wins.where(of_size).select("words").distinct(), size, n <= MOST_BROADCAST and n_bytes <= MOST_BYTES))
    base = own.select("id", "text_key", F.size("words").cast("long").alias("n_words"))
    if parts:
        found = reduce(DataFrame.unionByName, parts).distinct()
        found = stored(found, "decontaminate-found")
        by_start = found.groupBy("id", "text_key", "start").agg(F.max("n").alias("n"))
        ordered = Window.partitionBy("id", "text_key").orderBy("start")
        before = F.coalesce(F.max(F.col("start") + F.col("n")).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hit = by_start.withColumn("new", F.greatest(F.col("start") + F.col("n") - F.greatest("start", before), F.lit(0))).groupBy("id", "text_key").agg(F.sum("new").alias("n_hit"))
        named = found.select("id", "text_key", "window").distinct().join(wins.select("item", F.col("words").alias("window")), "window")
        items = named.groupBy("id", "text_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
        for side in (hit, items):
            side = side.withColumnsRenamed({"id": "id_", "text_key": "text_key_"})
            base = base.join(side, F.col("id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("text_key_")), "left").drop("id_", "text_key_")
    else:
        base = base.withColumns({"n_hit": F.lit(0), "items": F.array().cast("array<string>")})
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long"))
    return base.select(F.col("id").alias(key), "text_key", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that contain a window of benchmark; null keys and texts stay unless hit, and so do other texts of a hit row's key."""
    bad, said = free("__bad", docs.columns), free("__text", docs.columns)
    found = hits(docs, benchmark, key, text).where("contaminated").select(F.col(key).alias(bad), F.col("text_key").alias(said)).distinct()
    return docs.join(found, F.col(key).eqNullSafe(F.col(bad)) & (F.md5(F.coalesce(text, F.lit(""))) == F.col(said)), "left_anti")

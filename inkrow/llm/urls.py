"""URL filters: a cascade of Bloom filters that is exact over the corpus's keys."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from inkrow.llm._common import mix64, stored

#: The rules (verdict, host, path) of the production list.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
BITS_A_KEY, HASHES = 8, 5
#: Listed keys of a shard: the cascade of each shard of the key space is built and asked by itself.
SHARD_KEYS = 4_000_000
#: Filters up to so many bytes together are broadcast; more of them meet the keys of their shard in groups of about GROUP_ROWS keys.
MOST_BYTES, GROUP_ROWS = 64 << 20, 500_000
#: Rules up to so many are broadcast with their verdicts.
MOST_RULES = 100_000
#: Every level hashes anew, so that two keys part sooner or later unless all 128 bits of their hashes agree.
MOST_LEVELS = 64


def split_url(urls: DataFrame, url: str = "url") -> DataFrame:
    """urls with host and path. Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end. Null or no ://: both empty."""
    after = F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(after, "(?s)[?#].*", ""))
    host = F.substring_index(rest, "/", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = rest.substr(F.length(host) + 1, F.length(rest))
    return urls.withColumns({"host": F.coalesce(lowered, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def hashed(keys: DataFrame, shards: int = 1, key: str = "key") -> DataFrame:
    """keys with two 64-bit hashes of the key and the number of its shard."""
    own = keys.withColumns({"h1": F.xxhash64(F.lit(1), key), "h2": F.xxhash64(F.lit(2), key)})
    return own.withColumn("shard", F.pmod(F.shiftright("h2", 20), F.lit(shards)).cast("int"))


def places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Bits [hash, key] of a level's filter of so many bits."""
    own = mix64(h1.astype(np.int64).view(np.uint64) + np.uint64(level))
    step = mix64(h2.astype(np.int64).view(np.uint64) + np.uint64(level)) | np.uint64(1)
    return np.stack([(own + np.uint64(i) * step) % np.uint64(bits) for i in range(HASHES)]).astype(np.int64)


def passes(bits: np.ndarray, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    at = places(h1, h2, level, len(bits) * 8)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def listed_by(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether the first of a shard's levels that a key fails is an even one; passing all is the side of the last."""
    out, open_ = np.zeros(len(h1), bool), np.ones(len(h1), bool)
    for i, bits in enumerate(levels):
        out[open_] = i % 2 == 1
        open_[open_] = passes(bits, i, h1[open_], h2[open_])
    out[open_] = len(levels) % 2 == 1
    return out


@dataclass
class Cascade:
    """Filters (level, shard, bits) of all levels, a row each. A shard without a row at some level has no later one."""

    filters: DataFrame
    shards: int
    levels: int
    bytes: int


def filters_of(keys: DataFrame, level: int) -> DataFrame:
    """Bloom filters (level, shard, bits) of keys (h1, h2, shard), one a shard.

    Tasks give the 64-bit words that they set, joined by OR before and after the shuffle; a shard's filter is put together from
    its words, at most SHARD_KEYS * BITS_A_KEY bits on the listed side.
    """
    sizes = F.greatest(F.lit(64), (F.ceil(F.col("n") * BITS_A_KEY / 64) * 64)).cast("long")
    wide = keys.groupBy("shard").agg(F.count("*").alias("n")).select("shard", sizes.alias("bits"))
    sized = keys.select("shard", "h1", "h2").join(F.broadcast(wide), "shard")  # a row a shard, and a shard stands for millions of keys

    def words(batches):
        for batch in batches:
            shard, h1, h2, bits = (batch.column(c).to_numpy() for c in ("shard", "h1", "h2", "bits"))
            for k in np.unique(shard):
                use = shard == k
                at = np.unique(places(h1[use], h2[use], level, int(bits[use][0])))
                word, first = np.unique(at >> 6, return_index=True)
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), k, np.int32)), pa.array(word), pa.array(value), pa.array(np.full(len(word), bits[use][0]))], ["shard", "at", "word", "bits"])

    def whole(group: pa.Table) -> pa.Table:
        out = np.zeros(group["bits"][0].as_py() // 64, np.int64)
        out[group["at"].to_numpy()] = group["word"].to_numpy()
        return pa.table([pa.array([level], pa.int32()), pa.array([group["shard"][0].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["level", "shard", "bits"])

    set_ = sized.mapInArrow(words, "shard int, at long, word long, bits long").groupBy("shard", "at").agg(F.bit_or("word").alias("word"), F.max("bits").alias("bits"))
    return stored(set_.groupBy("shard").applyInArrow(whole, "level int, shard int, bits binary"), "cascade-level")


def ask(keys: DataFrame, filters: DataFrame, total_bytes: int, shards: int, test, name: str) -> DataFrame:
    """keys (with h1, h2 and shard) with the boolean column name: test(filters of its shard as pairs (level, bits), h1, h2).

    Filters that are small together are broadcast. Others meet the keys of their shard: those are dealt by shard and by the task that they come
    from, so that no group holds more than about GROUP_ROWS keys, also where one key holds a third of all rows.
    """
    if total_bytes <= MOST_BYTES:
        by_shard: dict[int, list] = {}
        for r in filters.orderBy("level").collect():  # MOST_BYTES at most
            by_shard.setdefault(r["shard"], []).append((r["level"], np.frombuffer(r["bits"], np.uint8)))
        shared = keys.sparkSession.sparkContext.broadcast(by_shard)

        @pandas_udf("boolean")
        def answer(h1: pd.Series, h2: pd.Series, shard: pd.Series) -> pd.Series:
            a, b, own = h1.to_numpy(), h2.to_numpy(), shard.to_numpy()
            out = np.zeros(len(a), bool)
            for k in np.unique(own):
                use = own == k
                out[use] = test(shared.value.get(int(k), []), a[use], b[use])
            return pd.Series(out)

        return keys.withColumn(name, answer("h1", "h2", "shard"))
    salts = max(1, math.ceil(keys.count() / (shards * GROUP_ROWS)))
    dealt = keys.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(salts)).cast("int"))
    copies = filters.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    kept = [f for f in keys.schema.fields if f.name != name]
    schema = T.StructType([*kept, T.StructField(name, T.BooleanType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        levels = sorted(zip(right["level"].to_pylist(), right["bits"].to_pylist(), strict=True))
        hit = test([(i, np.frombuffer(b, np.uint8)) for i, b in levels], left["h1"].to_numpy(), left["h2"].to_numpy())
        return left.select([f.name for f in kept]).append_column(name, pa.array(hit, pa.bool_()))

    return dealt.groupBy("shard", "__salt").cogroup(copies.groupBy("shard", "__salt")).applyInArrow(run, schema)


def build(listed: DataFrame, universe: DataFrame, shard_keys: int = SHARD_KEYS) -> Cascade:
    """Cascade for the column key of listed within that of universe.

    Level 1 holds the listed keys, level 2 the other keys of the universe that pass level 1, level 3 the listed ones that
    pass level 2, and so on until none passes. A key's first level that it fails then tells its side without
    error, for every key of the universe; keys in neither set may get either answer. Null keys are left out.
    The key space is cut into shards of about shard_keys listed keys by hash, so that a list of any size has its cascade; only
    filters that are small together reach the driver, never keys. Two keys whose 128 bits of hash agree can't be told apart: that fails.
    """
    spark = listed.sparkSession
    own = stored(listed.select("key").where("key IS NOT NULL").distinct(), "cascade-listed")
    n = own.count()
    shards = max(1, math.ceil(n / shard_keys))
    none = spark.createDataFrame([], "level int, shard int, bits binary")
    if not n:
        return Cascade(none, shards, 0, 0)
    own = hashed(own, shards)
    levels = [filters_of(own, 0)]
    sizes = [n * BITS_A_KEY // 8 + 64 * shards]
    one = lambda level: lambda held, h1, h2: passes(dict(held)[level], level, h1, h2) if level in dict(held) else np.zeros(len(h1), bool)
    through = lambda keys, level: ask(keys, levels[level], sizes[level], shards, one(level), "through").where("through").drop("through")
    others = through(hashed(universe.select("key").where("key IS NOT NULL"), shards), 0).distinct().join(own.select("key"), "key", "left_anti")
    sides = [own, stored(others, "cascade-others")]
    while n := sides[1].count():
        if len(levels) == MOST_LEVELS:
            raise ValueError(f"{n} keys have the same 128-bit hash as keys of the other side")
        levels.append(filters_of(sides[1], len(levels)))
        sizes.append(n * BITS_A_KEY // 8 + 64 * shards)
        sides = [sides[1], stored(through(sides[0], len(levels) - 1), "cascade-left")]
    filters = levels[0]
    for level in levels[1:]:
        filters = filters.unionByName(level)
    return Cascade(filters, shards, len(levels), sum(sizes))


def side(held: list, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return listed_by([bits for _, bits in held], h1, h2)


def members(keys: DataFrame, cascade: Cascade) -> DataFrame:
    """keys with listed: whether the column key is in the cascade's list. Null keys aren't listed; columns h1, h2 and shard are replaced and go."""
    asked = ask(hashed(keys.drop("listed", "h1", "h2", "shard"), cascade.shards), cascade.filters, cascade.bytes, cascade.shards, side, "listed")
    return asked.withColumn("listed", F.col("key").isNotNull() & F.col("listed")).drop("h1", "h2", "shard")


def with_keys(pages: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """pages (with host and path) with the array candidates, longest first: for each of shapes (labels of a host, characters of a path) the host's last labels with the path's start, as far as there are so many.
    """
    labels = F.split("host", "\\.")
    out = []
    for depth, length in shapes:
        host = F.array_join(F.slice(labels, F.greatest(F.size(labels) - depth + 1, F.lit(1)), depth), ".")
        key = F.struct((F.length(host) + length).alias("n"), F.length(host).alias("h"), F.concat(host, F.substring("path", 1, length)).alias("key"))
        out.append(F.when((F.size(labels) >= depth) & (F.length("path") >= length) & (F.col("host") != ""), key))
    keys = F.transform(F.sort_array(F.array_compact(F.array(*out)), asc=False), lambda k: k["key"]) if out else F.array().cast("array<string>")
    return pages.withColumn("candidates", keys)


def first_listed(pages: DataFrame, cascade: Cascade) -> DataFrame:
    """pages with rule, the first of their candidates that the cascade lists, null if none.

    Filters that are small together are broadcast and asked for a page's candidates at once. Others meet the candidates, a row each, by shard; the least place of a listed one comes back by the row's number.
    """
    if cascade.bytes <= MOST_BYTES:
        by_shard: dict[int, list] = {}
        for r in cascade.filters.orderBy("shard", "level").collect():  # MOST_BYTES at most
            by_shard.setdefault(r["shard"], []).append(np.frombuffer(r["bits"], np.uint8))
        shared = pages.sparkSession.sparkContext.broadcast(by_shard)
        shards = cascade.shards

        @pandas_udf("int")
        def place(h1: pd.Series, h2: pd.Series) -> pd.Series:
            a, b = (np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in h)]) for h in (h1, h2))
            row, own, listed = np.repeat(np.arange(len(h1)), [len(x) for x in h1]), (b >> 20) % shards, np.zeros(len(a), bool)
            for k in np.unique(own):
                use = own == k
                listed[use] = listed_by(shared.value.get(int(k), []), a[use], b[use])
            hit, starts, out = np.flatnonzero(listed), np.searchsorted(row, np.arange(len(h1))), np.zeros(len(h1), np.int32)
            some, first = np.unique(row[hit], return_index=True)
            out[some] = hit[first] - starts[some] + 1
            return pd.Series(out)

        at = place(*(F.expr(f"transform(candidates, k -> xxhash64({i}, k))") for i in (1, 2)))
        return pages.withColumn("at", at).withColumn("rule", F.when(F.col("at") > 0, F.try_element_at("candidates", F.greatest("at", F.lit(1))))).drop("at")
    rows = stored(pages.withColumn("row", F.monotonically_increasing_id()), "urls-pages")
    asked = members(rows.select("row", F.posexplode("candidates").alias("at", "key")), cascade).where("listed")
    best = asked.groupBy("row").agg(F.min_by("key", "at").alias("rule"))
    return rows.join(best, "row", "left").drop("row")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, key: str = "page_id", url: str = "url", default: str = "allow", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """key, host, path, rule and verdict of every page; rules are (verdict, host, path), as a list or, of any number, a DataFrame with these columns and place, their order.

    A rule fits its host and the hosts below it if the path starts with its path; the longest rule (then the one with the longer host)
    wins; of rules with equal keys the first counts. Whether a candidate key is listed is asked of the cascade built over all candidate keys of all pages, shard by shard. Where no
    rule fits, rule is null and verdict is default, since the cascade lists nothing of that url. All rows stay,
    repeated ones too; a null key stays null. Only the shapes of the rules, how many labels and how long a path they have, come to the driver.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(*r, i) for i, r in enumerate(rules)], "verdict string, host string, path string, place int")
    own = rules.where("host IS NOT NULL AND path IS NOT NULL")
    shapes = sorted({(r["depth"], r["length"]) for r in own.select(F.size(F.split("host", "\\.")).alias("depth"), F.length("path").alias("length")).distinct().collect()}, reverse=True)
    listed = stored(own.groupBy(F.concat("host", "path").alias("key")).agg(F.min_by("verdict", "place").alias("verdict")), "urls-rules")
    split = with_keys(split_url(pages.select(key, url), url), shapes)
    cascade = build(listed.select("key"), split.select(F.explode("candidates").alias("key")).distinct(), shard_keys)
    marked = first_listed(split, cascade).select(key, "host", "path", "rule")
    told = listed.withColumnRenamed("key", "rule")
    told = F.broadcast(told) if listed.count() <= MOST_RULES else told
    return marked.join(told, "rule", "left").select(key, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))

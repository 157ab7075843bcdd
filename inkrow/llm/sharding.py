"""Shards of near-equal bytes: sampled splitters cut the key space into ranges, overfull ranges are subdivided, and ranges fill the shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from inkrow.llm._common import hash_of, stored

SHARDS, LAW = 24, "bytes"
#: Ranges that a shard's bytes are cut into, and sampled keys a range.
PIECES, SAMPLED = 64, 16
#: Rows of a range at most, so that one task can number them; smaller tables have ranges of an eighth of a shard's rows.
MOST_ROWS = 1_000_000
#: How far a shard may exceed the mean before groups of equal texts in it are subdivided.
SLACK = 0.02
#: Bytes that a row has besides its text.
ROW_BYTES = 8


def keyed(docs: DataFrame, group: Column, tie: Column, size: Column, keep: list[str]) -> DataFrame:
    """The columns keep of docs with size and place, the key of the order: a digest of the group, then one of the tie and the row's number, which parts rows that repeat. Stored, so that the numbers stay."""
    own = docs.withColumns({"__size": size.cast("long"), "__group": F.md5(F.coalesce(group.cast("string"), F.lit("")).cast("binary")), "__row": F.monotonically_increasing_id()})
    place = F.concat("__group", F.lit("/"), F.lpad(F.hex(F.xxhash64(tie)), 16, "0"), F.lpad(F.hex("__row"), 16, "0"))
    return stored(own.select(*keep, F.col("__size"), place.alias("__place")), "shard-keys")


def with_range(rows: DataFrame, cuts: list[str]) -> DataFrame:
    """rows with __range: how many cuts are at or before their place."""
    shared = rows.sparkSession.sparkContext.broadcast(np.array(cuts, object))

    @pandas_udf("int")
    def find(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, place.to_numpy(object), side="right").astype(np.int32)) if len(shared.value) else pd.Series(np.zeros(len(place), np.int32))

    return rows.withColumn("__range", find("__place"))


def group_of(place: str) -> str:
    return place.partition("/")[0]


def new_cuts(sample: list[tuple[str, float]], low: str, high: str) -> list[str]:
    """Places where a range from low to high is cut, given sampled (place, weight) in order: about one a unit of weight.

    Between groups where the range has several; a group of a unit or more is parted from its neighbours. A range of one group is cut inside it. There is one cut at least, if low and high differ.
    """
    whole = group_of(low) != group_of(high)
    out, at, held = set(), 0.0, {}
    for place, weight in sample:
        if int(at + weight) > int(at):
            out.add(group_of(place) if whole else place)
        at += weight
        held[group_of(place)] = held.get(group_of(place), 0.0) + weight
    if whole:
        out |= {c for g, w in held.items() if w >= 1 for c in (g, g + "~")}
    fits = sorted(c for c in out if low < c <= high)
    return fits or ([group_of(low) + "~"] if whole else [high] if low != high else [])


def ranges(rows: DataFrame, shards: int) -> tuple[list[str], pd.DataFrame]:
    """(cuts, ranges): the splitters, and number, bytes, rows, shard and first slot of each range that isn't empty.

    Keys are sampled in proportion to their rows' load, the share of a range that a row takes by bytes and by count, and the sample's quantiles are the first
    cuts. The exact size of each range then tells which are overfull: those are sampled by themselves and cut again, until each holds about two shares at most, or one
    group of up to a shard and MOST_ROWS rows, or a single row. Where the shards that they give exceed the mean by more than SLACK, the largest group of each such shard is cut too. Only samples and one row a range come to the driver; ranges are as many as shards * (PIECES + 8) or rows / MOST_ROWS allow, whatever the keys.
    """
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("__size"), F.lit(0))).first()
    if not n:
        return [], pd.DataFrame({"__range": [], "bytes": [], "rows": []})
    most_bytes, most_rows = total / (shards * PIECES), max(1.0, min(MOST_ROWS / 2, n / (shards * 8)))
    load = F.col("__size") / most_bytes + 1 / most_rows
    chance = hash_of("__place").cast("double") / 2.0**63 < SAMPLED * load
    weight = F.greatest(load, F.lit(1 / SAMPLED)).alias("weight")
    cuts: list[str] = []
    open_, found = [0], None
    while True:
        own = with_range(rows, cuts)
        if found is not None:
            held = own.groupBy("__range").agg(F.sum("__size").alias("bytes"), F.count("*").alias("rows"), F.min("__place").alias("low"), F.max("__place").alias("high")).toPandas()
            one = held["low"].map(group_of) == held["high"].map(group_of)
            whole = one & (held["bytes"] <= total / shards) & (held["rows"] <= min(MOST_ROWS, max(1, n / shards)))
            divisible = held[((held["bytes"] > 2 * most_bytes) | (held["rows"] > 2 * most_rows)) & (held["low"] != held["high"])]
            over = divisible[~whole[divisible.index]]
            if over.empty:
                table = dealt(held, shards)
                full = table.groupby("shard")["bytes"].transform("sum")
                large = table[(full > (1 + SLACK) * total / shards) & table["__range"].isin(divisible["__range"])]
                over = large.loc[large.groupby("shard")["bytes"].idxmax()]
            if over.empty:
                return cuts, table
            found, open_ = {k: (low, high) for k, low, high in over[["__range", "low", "high"]].itertuples(index=False)}, over["__range"].tolist()
        else:
            found = {0: tuple(rows.agg(F.min("__place"), F.max("__place")).first())}
        # the ranges to cut are as few as ranges, the sample is SAMPLED times the load of what they hold
        picked = own.where(F.col("__range").isin(open_) & chance).select("__range", "__place", weight).toPandas().sort_values("__place")
        groups = dict(iter(picked.groupby("__range")))
        fresh = [c for k, (low, high) in found.items() for c in new_cuts(list(groups[k][["__place", "weight"]].itertuples(index=False, name=None)) if k in groups else [], low, high)]
        cuts = sorted({*cuts, *fresh})


def dealt(held: pd.DataFrame, shards: int) -> pd.DataFrame:
    """held (ranges with bytes and rows) with the shard of each range and the slot of its first row.

    Ranges of over two shares go first, the largest one into the emptiest shard each; the others follow in order of their keys, filling one shard after the other up to a common level, so that a shard's small ranges neighbour each other.
    """
    own = held.sort_values("__range").reset_index(drop=True)
    size, shard, full = own["bytes"].to_numpy(float), np.zeros(len(own), int), np.zeros(shards)
    large = size > 2 * size.sum() / (shards * PIECES)
    for i in sorted(np.flatnonzero(large), key=lambda i: (-size[i], i)):
        shard[i] = full.argmin()
        full[shard[i]] += size[i]
    rest = size[~large].sum()
    order = np.sort(full)
    level = max(((rest + order[:k].sum()) / k for k in range(1, shards + 1) if k == shards or (rest + order[:k].sum()) / k <= order[k]), default=0.0)
    room = np.cumsum(np.maximum(level - full, 0))
    middle = np.cumsum(size[~large]) - size[~large] / 2
    shard[~large] = np.minimum(np.searchsorted(room, middle, side="right"), shards - 1)
    own["shard"] = shard
    own["first"] = own.groupby("shard")["rows"].cumsum() - own["rows"]
    return own


def split(rows: DataFrame, shards: int) -> DataFrame:
    """rows of keyed() with shard and slot, gapless from 0 in each shard."""
    cuts, table = ranges(rows, shards)
    spark = rows.sparkSession
    if table.empty:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    places = spark.createDataFrame(table[["__range", "shard", "first"]].astype({"__range": "int32", "shard": "int32", "first": "int64"}), "__range int, shard int, first long")
    own = with_range(rows, cuts).join(F.broadcast(places), "__range")  # a row a range
    # a window's rows are those of a range, which are bounded
    slot = F.col("first") + F.expr("row_number() OVER (PARTITION BY __range ORDER BY __place)") - 1
    return own.withColumn("slot", slot.cast("long")).drop("__range", "first")


def sizes(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard of every row of docs.

    The law is `bytes`: the shards' bytes are nearly equal. Rows stand in order of their text's digest, so that equal texts are neighbours; a group of equal texts is kept in
    one shard unless it holds over a shard's bytes or rows, or over MOST_ROWS rows, or the shards can't be equal otherwise: then it is subdivided by the digest of its keys. A single row of more than a shard's bytes has a shard that exceeds the others.
    A null text has no bytes and counts as equal to the empty one; null and repeated keys and rows are rows like others. grown_shard is null, since a further shard moves all boundaries. An empty table gives no row.
    """
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    slim = docs.select(F.col(key).alias("__key"), sizes(text).alias("__bytes"), crc.alias("__crc"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    own = split(keyed(slim, F.col("__text"), F.col("__key"), F.col("__bytes"), ["__key", "__crc"]), shards)
    return own.select(F.col("__key").alias(key), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> str:
    """docs written to path as Parquet, a folder a shard, rows in order of their slots; returns the name of the folders' column: shard, with underscores in front where docs has such a column.

    Shards and slots are those of assign(); all columns of docs stay as they are.
    """
    name, slot = "shard", "slot"
    while name in docs.columns or slot in docs.columns:
        name, slot = f"_{name}", f"_{slot}"
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    own = split(keyed(packed, F.col(f"__doc.`{text}`"), F.col(f"__doc.`{key}`"), F.coalesce(F.octet_length(f"__doc.`{text}`"), F.lit(0)) + ROW_BYTES, ["__doc"]), shards)
    parts = own.select("__doc.*", F.col("shard").alias(name), F.col("slot").alias(slot))
    # a shard's rows in runs of MOST_ROWS slots, so that no task writes a whole shard
    run = F.floor(F.col(slot) / MOST_ROWS)
    parts.repartition(name, run).sortWithinPartitions(name, slot).write.partitionBy(name).parquet(path)
    return name

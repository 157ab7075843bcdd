"""Document fingerprints: improbable byte windows in chained Bloom filters, compared by normalised overlap."""

from __future__ import annotations

import base64
import hashlib
import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkrow.llm._common import mix64, partitions, slices

#: Bytes of a window. Bits of a filter, bits a feature sets, features a filter takes.
SPAN, BITS, HASHES, FEATURES = 16, 2048, 5, 160
#: A window is a feature if it is the rarest of at least POPULAR of the runs of NEAR windows that hold it; runs may stick out of the text at both ends.
#: NEAR is at most SPAN, a power of two.
NEAR, POPULAR = 16, 4
#: Entropy of windows (bits a byte) of ordinary prose, and its spread: the further from it, the rarer. Windows under LEAST have too little in them.
USUAL, SPREAD, LEAST = 2.87, 0.25, 1.0
CLASSES = 16
#: Bytes of texts that are ranked at once; a longer text is ranked stretch by stretch, with the same result.
PIECE = 1 << 20
PRIME = np.uint64(0x100000001B3)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of PRIME and of its inverse modulo 2**64, n at least."""
    if len(POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(PRIME), -1, 1 << 64))
        for i, base in enumerate((PRIME, inverse)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            POWERS[i] = np.multiply.accumulate(x)
    return POWERS[0], POWERS[1]


LOGS = (np.arange(SPAN + 1) * np.log2(np.maximum(np.arange(SPAN + 1), 1)) / SPAN).astype(np.float32)


def ranks(data: np.ndarray) -> np.ndarray:
    """Place of the window at every byte but the last SPAN - 1: the rarer its entropy, the less; equal ones are placed by their hash."""
    pow_, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pow_[: len(data)], out=total[1:])
    hashed = mix64((total[SPAN:] - total[:-SPAN]) * inverse[: len(data) - SPAN + 1])
    entropy = np.full(len(hashed), np.log2(SPAN), np.float32)
    kinds, upto = data & np.uint8(CLASSES - 1), np.zeros(len(data) + 1, np.int32)
    for k in range(CLASSES):
        np.cumsum(kinds == k, dtype=np.int32, out=upto[1:])
        entropy -= LOGS[upto[SPAN:] - upto[:-SPAN]]
    rank = np.where(entropy < LEAST, 0, np.abs(entropy - np.float32(USUAL)) * np.float32(1000 / SPREAD))
    return (np.uint64(65535) - np.minimum(rank, 65535).astype(np.uint64)) << np.uint64(48) | hashed >> np.uint64(16)


def piece_features(pieces: list[np.ndarray]) -> list[np.ndarray]:
    """Features of each piece in order of appearance.

    Every byte starts a window, so every window is ranked; a piece of fewer than SPAN bytes is one window, filled up with zeros. Of each run of
    NEAR windows the rarest is counted, and those that are counted POPULAR times become features: the rarest of a piece always is one.
    """
    pieces = [p if len(p) >= SPAN else np.concatenate([p, np.zeros(SPAN - len(p), np.uint8)]) for p in pieces]
    sizes = np.array([len(p) for p in pieces])
    data, ends = np.concatenate(pieces), np.cumsum(sizes)
    # the SPAN - 1 bytes at a piece's end start no window of it, so that no run holds windows of two pieces
    place = np.full(len(data) + 2 * (NEAR - 1), NONE, np.uint64)
    place[NEAR - 1 : NEAR + len(data) - SPAN] = ranks(data)
    for end in ends[:-1]:
        place[NEAR - 1 + end - SPAN + 1 : NEAR - 1 + end] = NONE
    step = 1
    while step < NEAR:  # the least of each run
        place, step = np.minimum(place[:-step], place[step:]), 2 * step
    changes = np.concatenate([[True], place[1:] != place[:-1]])
    changes[ends[:-1]] = True  # also where a piece ends as the next begins
    first = np.flatnonzero(changes)
    length = np.diff(np.concatenate([first, [len(place)]]))
    use = (length >= POPULAR) & (place[first] != NONE)
    chosen, at = place[first[use]], first[use]  # where a window's first run ends: at the window or after it, inside its piece
    cuts = np.searchsorted(at, ends - sizes)
    chosen = mix64(chosen)
    return [chosen[a:b] for a, b in zip(cuts, [*cuts[1:], len(chosen)], strict=True)]


def long_features(data: np.ndarray, size: int) -> list[np.ndarray]:
    """Features of a text of over SPAN bytes as piece_features gives them, worked out for size runs of windows at once.

    A feature counts where its first run is; the runs before and after a stretch, and all windows that they hold, are looked at with it.
    """
    windows, out = len(data) - SPAN + 1, []
    for a in range(0, windows + NEAR - 1, size):
        low, high = a - 1, min(a + size, windows + NEAR - 1) + NEAR  # runs that are looked at; run r holds the windows from r - NEAR + 1 to r
        place = np.full(high - low + NEAR - 1, NONE, np.uint64)
        first, end = max(0, low - NEAR + 1), min(windows, high)
        place[first - (low - NEAR + 1) : end - (low - NEAR + 1)] = ranks(data[first : end + SPAN - 1])
        step = 1
        while step < NEAR:
            place, step = np.minimum(place[:-step], place[step:]), 2 * step
        begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        length = np.diff(np.concatenate([begin, [len(place)]]))
        here = (begin + low >= a) & (begin + low < a + size)
        out.append(mix64(place[begin[here & (length >= POPULAR) & (place[begin] != NONE)]]))
    return out


def features(raws: list[bytes]) -> list[np.ndarray]:
    """64-bit features of each text in order of appearance, each once; an empty text has none."""
    out: list[list[np.ndarray]] = [[] for _ in raws]
    held, owners, size = [], [], 0

    def done() -> None:
        for i, own in zip(owners, piece_features(held), strict=True):
            out[i].append(own)
        held.clear()
        owners.clear()

    for i, raw in enumerate(raws):
        data = np.frombuffer(raw, np.uint8)
        if len(data) > PIECE:
            out[i] = long_features(data, PIECE)
        elif len(data):
            if held and size + len(data) > PIECE:
                done()
                size = 0
            held.append(data)
            owners.append(i)
            size += len(data)
    if held:
        done()
    once = lambda own: own[np.sort(np.unique(own, return_index=True)[1])]
    return [once(np.concatenate([np.zeros(0, np.uint64), *parts])) for parts in out]


def digests(raws: list[bytes]) -> list[np.ndarray]:
    """Of each text a chain of filters [filter, byte] of FEATURES features each, in order."""
    out = []
    for own in features(raws):
        chain = np.zeros((-(-len(own) // FEATURES), BITS), bool)
        row = np.arange(len(own)) // FEATURES
        for i in range(HASHES):
            chain[row, ((own >> np.uint64(11 * i)) & np.uint64(BITS - 1)).astype(np.int64)] = True
        out.append(np.packbits(chain, axis=1))
    return out


def digest(raw: bytes) -> np.ndarray:
    return digests([raw])[0]


def encode(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BITS // 8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1. Each filter of the shorter chain counts with its best partner in the longer: bits in common beyond those that chance gives, as a share of
    those that are possible. Both empty: 1; one empty: 0."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    x, y = np.unpackbits(a, axis=1).astype(np.float32), np.unpackbits(b, axis=1).astype(np.float32)
    n, m = x.sum(axis=1)[:, None], y.sum(axis=1)[None, :]
    chance, most = n * m / BITS, np.minimum(n, m)
    score = (x @ y.T - chance) / np.maximum(most - chance, 1e-6)
    score = np.where(most <= chance, 0, np.clip(score, 0, 1))
    return float(score.max(axis=1).mean())


def with_next(docs: DataFrame, key: str, text: str, rows_a_bucket: int = 4000, few_buckets: int = 4096) -> DataFrame:
    """docs (key, text) in buckets by ascending key, then hash of the text, each followed by a copy of the first row of the bucket after it (head = 1).

    Texts are dealt once. The buckets' edges are quantiles of a sample of the keys (the sample decides the balance alone); they are data that is broadcast: a bucket has
    rows_a_bucket rows, or more where there would be over few_buckets of them: then there are as many as the square root of the rows. A bucket streams through its task. A key that takes several quantiles, null among them, has as many buckets, by hash.
    """
    own = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    n = own.count()
    cuts = min(max(few_buckets, math.isqrt(n)), max(1, -(-n // rows_a_bucket)))
    wanted = 32 * cuts  # keys of the sample, at the driver
    keys = own.select("key") if n <= wanted else own.select("key").sample(wanted / n, 9)
    got = [r["key"] for r in keys.collect()] if cuts > 1 else []
    known = sorted(k for k in got if k is not None)
    none = max(1, round(cuts * (len(got) - len(known)) / max(1, len(got))))
    edges = [known[len(known) * i // cuts] for i in range(1, cuts)] if known else []
    times = Counter(edges)
    edges = sorted(times)
    room = [x for e in edges for x in (1, times[e])] + [1]  # below the first edge, at it, between it and the next, ...
    start = none + np.concatenate([[0], np.cumsum(room)])
    shared = own.sparkSession.sparkContext.broadcast((edges, np.array(room), start, none))

    @F.pandas_udf("int")
    def bucket_of(keys: pd.Series, hashes: pd.Series) -> pd.Series:
        edges, room, start, none = shared.value
        part = (hashes.to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)) / 2.0**64
        missing = keys.isna().to_numpy()
        out = np.minimum((part * none).astype(np.int64), none - 1)
        if not missing.all():
            some = keys[~missing]
            values = some.to_numpy(dtype=object) if edges and isinstance(edges[0], str) else some.to_numpy()
            marks = np.array(edges, dtype=values.dtype) if edges else values[:0]
            left, right = (np.searchsorted(marks, values, side) for side in ("left", "right"))
            slot = left + right  # even between edges, odd at one
            out[~missing] = start[slot] + np.minimum((part[~missing] * room[slot]).astype(np.int64), room[slot] - 1)
        return pd.Series(out.astype(np.int32))

    own = own.withColumn("bucket", bucket_of("key", "hash"))
    heads = own.groupBy("bucket").agg(F.min(F.struct(F.col("key").isNotNull().alias("set"), "key", "hash")).alias("m")).select("bucket", "m.key", "m.hash").orderBy("bucket").collect()  # one a bucket
    if not heads:
        return own.withColumns({"head": F.lit(0), "goes": F.col("bucket")})
    numbers = [h["bucket"] for h in heads]
    before = {b: numbers[i - 1] for i, b in enumerate(numbers)}  # the first follows the last
    to = own.sparkSession.createDataFrame([(h["bucket"], h["key"], h["hash"], before[h["bucket"]]) for h in heads], f"bucket int, key {own.schema['key'].dataType.simpleString()}, hash long, goes int")
    same = (F.col("o.bucket") == F.col("t.bucket")) & F.col("o.key").eqNullSafe(F.col("t.key")) & (F.col("o.hash") == F.col("t.hash"))
    copies = own.alias("o").join(F.broadcast(to).alias("t"), same).groupBy("o.key", "o.hash", "t.goes").agg(F.min("o.text").alias("text"))
    rows = own.select("key", "text", "hash", F.col("bucket").alias("goes"), F.lit(0).alias("head")).unionByName(copies.select("key", "text", "hash", "goes", F.lit(1).alias("head")))
    dealt = rows.repartition(max(partitions(own.sparkSession), len(numbers)), "goes").sortWithinPartitions("goes", "head", "key", "hash", "text")
    return dealt.select("key", "text", "head")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next.

    The edited text is the text with its last floor(n_chars/4) characters replaced by as many of the first (or all) of the next document's in
    order of key, then the hash of the text (nulls first; after the last comes the first). Null text counts as empty. Rows that repeat
    stay; the next of each is then its own repeat. Keys are numbers or strings. Other columns aren't read.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held = None  # key, text and fingerprint of the row before, if its next isn't seen yet
        for batch in slices(batches, 500):
            keys, texts, heads = (batch.column(c).to_pylist() for c in ("key", "text", "head"))
            chains = digests([t.encode() for t in texts])
            own = [held, *zip(keys, texts, chains, strict=True)] if held else list(zip(keys, texts, chains, strict=True))
            last = [0] * bool(held) + heads
            pairs = [(x, y) for x, y, head in zip(own[:-1], own[1:], last[:-1], strict=True) if not head]
            held = None if last[-1] else own[-1]
            edited = [x[1][: len(x[1]) - len(x[1]) // 4] + y[1][: len(x[1]) // 4] for x, y in pairs]
            raws = [e.encode() for e in edited]
            others = digests(raws)
            columns = [
                pa.array([x[0] for x, _ in pairs], batch.schema.field("key").type),
                pa.array([len(x[1]) for x, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(r).hexdigest() for r in raws], pa.string()),
                pa.array([encode(x[2]) for x, _ in pairs], pa.string()),
                pa.array([encode(o) for o in others], pa.string()),
                pa.array([likeness(x[2], o) for (x, _), o in zip(pairs, others, strict=True)], pa.float64()),
                pa.array([likeness(x[2], y[2]) for x, y in pairs], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return with_next(docs, key, text).mapInArrow(run, f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

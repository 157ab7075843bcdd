"""Quality classifier: cumulative-link regression of an ordinal grade on hashed words."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkrow.llm._common import hash_of, highest_hash, mix64, slices, sums, text_array, word_codes

#: Weights shared by all hashed features; each word has KINDS of them.
BUCKETS, KINDS = 1 << 20, 4
#: The model is fitted on a hash sample of about so many graded rows; all counts for scoring come from whole texts.
TRAIN_ROWS = 4_000
#: A feature in fewer texts of the sample has no weight, nor one whose texts are graded like the others: its share of texts above some grade must
#: differ by so many standard deviations from that of all. So words that are rare by chance don't count.
LEAST_TEXTS, LEAST_Z = 4, 4.0
TAIL = re.compile(r"[^\w\s]+$")
BODY = re.compile(r"[\W_]+")
GRADES = 3


def grade(quality: Column, toxic: Column) -> Column:
    """0 for a toxic text, 1 for one of low quality, 2 for a good one; null if neither rating is known."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality.isNotNull(), 2)


def shape(word: str) -> str:
    return "A" if word.isupper() and len(word) > 1 else "A1" if word[:1].isupper() else "0" if word.isdigit() else "a" if word.isalpha() else "-"


def features(words: list[str]) -> np.ndarray:
    """Buckets [word, kind] of: the word without marks, by two hashes; the marks it ends in; its shape with those marks."""
    out = np.empty((len(words), KINDS), np.uint64)
    for i, word in enumerate(words):
        tail = TAIL.search(word)
        tail = tail[0] if tail else ""
        out[i] = [code(x) for x in ("w" + BODY.sub("", word).lower(), "v" + BODY.sub("", word).lower(), "t" + tail, "s" + shape(word.rstrip(tail) if tail else word) + tail)]
    return (mix64(out) & np.uint64(BUCKETS - 1)).astype(np.int64)


def code(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode())


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, value, offsets of each text's, number of words): a feature's value is the log of its count against that of the text's words."""
    codes, offsets, distinct = word_codes(texts, lower=False)
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(texts)), n)
    kinds = features(distinct.to_pylist())
    wide = max(1, len(distinct))
    pairs, count = np.unique(doc.astype(np.int64) * wide + codes, return_counts=True)  # each distinct word of a text once
    doc, codes = pairs // wide, pairs % wide
    bucket = kinds[codes].ravel() if len(codes) else np.zeros(0, np.int64)
    key, inverse = np.unique(np.repeat(doc, KINDS) * BUCKETS + bucket, return_inverse=True)
    total = np.bincount(inverse, np.repeat(count, KINDS), len(key))
    doc = key // BUCKETS
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    return key % BUCKETS, value_of(total, n[doc]), at, n


def value_of(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (np.log1p(count) / np.log1p(np.maximum(words, 1)) * 4).astype(np.float32)


class Model:
    """P(grade > k) = 1 / (1 + exp(threshold[k] - weights . x)); thresholds ascend."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights.astype(np.float32), thresholds

    def tails(self, eta: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - eta[:, None], -50, 50)))


def fit_rows(bucket: np.ndarray, value: np.ndarray, offsets: np.ndarray, grades: np.ndarray, rounds: int = 400, rate: float = 0.1, decay: float = 3e-5) -> Model:
    """Full-batch Adam on the likelihood of the grades; the thresholds are a first one and positive steps."""
    seen, column, texts = np.unique(bucket, return_inverse=True, return_counts=True)
    graded = np.repeat(grades, np.diff(offsets))
    use = np.zeros(len(seen), bool)
    for cut in range(GRADES - 1):
        p = (grades > cut).mean()
        above = np.bincount(column, graded > cut, len(seen))
        use |= np.abs(above - texts * p) >= LEAST_Z * np.sqrt(np.maximum(texts * p * (1 - p), 1e-9))
    use &= texts >= LEAST_TEXTS
    keep = use[column]
    column = (np.cumsum(use) - 1)[column[keep]]
    place = np.concatenate([[0], np.cumsum(keep)])[offsets]
    value, row = value[keep].astype(np.float64), np.repeat(np.arange(len(grades)), np.diff(place))
    m, cuts = int(use.sum()), GRADES - 1
    x = np.zeros(m + cuts)
    x[m] = -1.0
    first, second = np.zeros_like(x), np.zeros_like(x)
    balance = 1 / len(grades)  # grades count as often as they occur: without evidence a text is most likely of the commonest
    for t in range(1, rounds + 1):
        steps = np.exp(np.clip(x[m + 1 :], -5, 5))
        theta = x[m] + np.concatenate([[0], np.cumsum(steps)])
        eta = np.bincount(row, value * x[:m][column], len(grades)) if m else np.zeros(len(grades))
        above = 1 / (1 + np.exp(np.clip(theta[None, :] - eta[:, None], -50, 50)))
        padded = np.concatenate([np.ones((len(eta), 1)), above, np.zeros((len(eta), 1))], axis=1)
        every = np.arange(len(eta))
        p = np.maximum(padded[every, grades] - padded[every, grades + 1], 1e-12)
        slope = padded * (1 - padded)
        d_eta = -(slope[every, grades] - slope[every, grades + 1]) / p * balance
        d_theta = np.zeros((len(eta), GRADES + 1))
        d_theta[every, grades] += slope[every, grades] / p * balance
        d_theta[every, grades + 1] -= slope[every, grades + 1] / p * balance
        d_theta = d_theta[:, 1:-1].sum(axis=0)
        g = np.zeros_like(x)
        g[:m] = np.bincount(column, value * d_eta[row], m) + decay * x[:m] if m else 0
        g[m] = d_theta.sum()
        g[m + 1 :] = d_theta[::-1].cumsum()[::-1][1:] * steps
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        x -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[seen[use]] = x[:m]
    return Model(weights, x[m] + np.concatenate([[0], np.cumsum(np.exp(np.clip(x[m + 1 :], -5, 5)))]))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS) -> Model | None:
    """Model of the grades in labels (key, quality, toxic); None without a graded text.

    A hash sample of about train_rows keys with a grade is fitted, the same in every run; train_rows bounds what is broadcast
    and what reaches the driver (a few thousand features a text). Rows without key, rating or text are left out;
    a key counts once for each grade that its labels give, with one of its texts (that of the least hash), so that a key
    with very many labels or rows stays one row of the sample. A grade that has labels but no text in a sample of them fails.
    """
    graded = labels.select(F.col(key).alias("key"), grade(F.col("quality"), F.col("toxic")).alias("grade")).where("key IS NOT NULL AND grade IS NOT NULL").distinct()
    sizes = {r["grade"]: r["count"] for r in graded.groupBy("grade").count().collect()}
    n = sum(sizes.values())
    if not n:
        return None
    sample = graded.where(hash_of("key") <= highest_hash(train_rows, n))
    held = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL").join(F.broadcast(sample), "key")
    rows = held.groupBy("key", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("grade", "text")

    def extract(batches):
        for batch in slices(batches, 500):
            bucket, value, at, _ = text_features(text_array(batch.column(1)))
            cut = lambda x, kind: pa.array([x[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([batch.column(0), cut(bucket, pa.int32()), cut(value, pa.float32())], ["grade", "bucket", "value"])

    got = rows.mapInArrow(extract, "grade int, bucket array<int>, value array<float>").toArrow()
    if n > train_rows and (lost := sorted(sizes.keys() - set(got["grade"].to_pylist()))):
        raise ValueError(f"no text in the sample of the labels of grades {lost}: raise train_rows")
    if not got.num_rows:
        return None
    bucket = np.concatenate([c.flatten().to_numpy() for c in got["bucket"].chunks])
    value = np.concatenate([c.flatten().to_numpy() for c in got["value"].chunks])
    lengths = np.concatenate([np.diff(c.offsets.to_numpy()) for c in got["bucket"].chunks])
    order = np.lexsort((lengths, sums(bucket.astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])), got["grade"].to_numpy()))  # the sums don't depend on which task ended first
    starts = np.concatenate([[0], np.cumsum(lengths)])
    index = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in order]) if len(order) else np.zeros(0, int)
    return fit_rows(bucket[index], value[index], np.concatenate([[0], np.cumsum(lengths[order])]), got["grade"].to_numpy().astype(np.int64)[order])


def score(docs: DataFrame, model: Model | None, text: str = "text", least: float = 0.5) -> DataFrame:
    """docs with expected_grade (0 to 2), p_usable = P(grade > 0), p_good = P(grade > 1) and accepted = p_good >= least.

    Whole texts count. Null text has no word; a text without words has no evidence: its grades come from the
    thresholds alone and it isn't accepted. Without a model, everything else is accepted with null scores.
    Columns of these names are replaced; all other columns and all rows stay.
    """
    names = ["expected_grade", "p_usable", "p_good", "accepted"]
    kept = docs.drop(*names)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(x, T.DoubleType()) for x in names[:3]), T.StructField("accepted", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights

    def run(batches):
        model = shared.value
        cache: dict[str, int] = {}
        table = np.zeros((0, KINDS), np.int64)
        for batch in slices(batches, 500):
            codes, offsets, distinct = word_codes(text_array(batch.column(text)), lower=False)
            n = np.diff(offsets)
            if model is None:
                none = pa.nulls(batch.num_rows, pa.float64())
                yield pa.RecordBatch.from_arrays([*batch.columns, none, none, none, pa.array(n > 0)], [*batch.schema.names, *names])
                continue
            words = distinct.to_pylist()
            if len(cache) > 150_000:
                cache, table = {}, table[:0]
            if new := [w for w in words if w not in cache]:
                table = np.concatenate([table, features(new)])
                cache.update(zip(new, range(len(cache), len(cache) + len(new)), strict=True))
            kinds = table[np.array([cache[w] for w in words], np.int64)] if words else table[:0]
            # only features that have a weight are gathered by text
            use = model.weights[kinds] != 0
            doc = np.repeat(np.arange(batch.num_rows), n)
            eta = np.zeros(batch.num_rows)
            for kind in range(KINDS if len(codes) else 0):
                has = use[codes, kind]
                key, count = np.unique(doc[has] * BUCKETS + kinds[codes[has], kind], return_counts=True)
                own = key // BUCKETS
                eta += np.bincount(own, model.weights[key % BUCKETS] * value_of(count, n[own]), batch.num_rows)
            tails = model.tails(eta)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, 0]), pa.array(tails[:, 1]), pa.array((tails[:, 1] >= least) & (n > 0))], [*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)

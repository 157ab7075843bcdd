"""Language identification: script ranges narrow the candidates, Viterbi labels the words of mixed text."""

from __future__ import annotations

import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkrow.llm._common import hash_of, highest_hash, slices, sums, text_array, word_codes

#: First and last code points of scripts, in order.
SCRIPTS = [
    (0x0041, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"),
    (0x0B80, 0x0BFF, "Tamil"), (0x0E00, 0x0E7F, "Thai"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"),
    (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x309F, "Hiragana"), (0x30A0, 0x30FF, "Katakana"),
    (0x3400, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"),
]
NAMES = sorted({name for *_, name in SCRIPTS}) + ["Other"]
#: Features of a word are its character trigrams, hashed to so many buckets.
BUCKETS = 1 << 15
#: Training rows are a hash sample of about so many rows of each language; the text of no others is used.
TRAIN_ROWS = 5_000
#: A script is a candidate's if so large a share of the language's letters is in it.
SCRIPT_SHARE = 0.001
#: What a change of language between two words costs, and what a word costs in a language outside the candidates (natural logarithms).
SWITCH, OUTSIDE = 10.0, 60.0
CACHE_WORDS = 150_000
#: Lower-cased texts of the Latin script alone, and the letters in them.
LATIN, LATIN_LETTERS = re.compile("[\0-\u024f]*"), re.compile("[a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


def scripts(points: np.ndarray) -> np.ndarray:
    """Number of the script of each code point in NAMES."""
    first, last = (np.array([s[i] for s in SCRIPTS]) for i in (0, 1))
    at = np.searchsorted(first, points, "right") - 1
    number = np.array([NAMES.index(s[2]) for s in SCRIPTS])
    return np.where((at >= 0) & (points <= last[at]), number[at], len(NAMES) - 1)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each trigram, offsets of each word's, script of each word's first letter); words hold letters only, one at least."""
    points = np.frombuffer((" " + " ".join(words) + "  ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.array([len(w) for w in words])
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    hashed = (points[:-2] * np.uint64(0x9E3779B1) + points[1:-1] * np.uint64(0x85EBCA77) + points[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
    hashed = (hashed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return hashed[at].astype(np.int64), offsets, scripts(points[starts + 1].astype(np.int64))


def parts_of(word: str) -> list[str]:
    """The runs of letters of one script in a lower-cased word; letters are characters of the Unicode categories L only, so no fraction, superscript or circled digit. Marks are left out and part nothing."""
    if word.isascii() or LATIN.fullmatch(word):
        return [word] if word.isalpha() else LATIN_LETTERS.findall(word)
    out, last = [], None
    for c, script in zip(word, scripts(np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)).tolist(), strict=True):
        if c.isalpha():
            if script == last:
                out[-1] += c
            else:
                out.append(c)
            last = script
        elif not unicodedata.category(c).startswith("M"):
            last = None
    return out


def split_words(codes: np.ndarray, offsets: np.ndarray, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Words between white space, as word_codes gives them, cut into parts_of: (code of each part, where each text's parts start and end, the distinct parts, the word that each part is in)."""
    held = [parts_of(w) for w in pc.utf8_lower(distinct).to_pylist()]
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    coded = pa.array(list(chain.from_iterable(held)), pa.string()).dictionary_encode()
    flat, starts, parts = coded.indices.to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]), coded.dictionary.to_pylist()
    if not len(codes):
        return np.zeros(0, np.int64), offsets, parts, np.zeros(0, np.int64)
    n = sizes[codes]
    upto = np.concatenate([[0], np.cumsum(n)])
    word = np.repeat(np.arange(len(codes)), n)
    return flat[starts[codes][word] + np.arange(upto[-1]) - upto[:-1][word]], upto[offsets], parts, word


class Model:
    """Log-probability of each bucket in each language and the languages of each script."""

    def __init__(self, langs: list[str], counts: np.ndarray, by_script: np.ndarray):
        self.langs = langs
        self.logs = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)
        share = by_script / np.maximum(by_script.sum(axis=0), 1)
        self.outside = np.where(share >= SCRIPT_SHARE, 0, -OUTSIDE).astype(np.float32)
        self.outside[(share < SCRIPT_SHARE).all(axis=1)] = 0  # no language has this script: none is ruled out
        self.fresh()

    def fresh(self) -> None:
        """Forgets the words that were scored."""
        self.cache: dict[str, int] = {}
        self.known = np.zeros((0, len(self.langs)), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language; 0 for a word without letters."""
        if len(self.cache) > CACHE_WORDS:
            self.fresh()
        new = list({w for w in words if w and w not in self.cache})
        if new:
            bucket, offsets, script = word_features(new)
            got = np.add.reduceat(self.logs[bucket], offsets[:-1], axis=0) + self.outside[script]
            self.cache.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.known = np.concatenate([self.known, got])
        table = np.concatenate([self.known, np.zeros((1, len(self.langs)), np.float32)])
        return table[np.array([self.cache.get(w, -1) for w in words], np.int64)] if words else table[:0]


def viterbi(emitted: np.ndarray, switch: float) -> np.ndarray:
    """Best state of each step of each row of emitted [step, row, state] where a change of state costs switch. Ties: stay, then the first state."""
    steps, rows, states = emitted.shape
    stays, bests = np.empty((steps, rows, states), bool), np.empty((steps, rows), np.int16)
    value = emitted[0]
    for t in range(1, steps):
        bests[t] = value.argmax(axis=1)
        moved = (value.max(axis=1) - np.float32(switch))[:, None]
        stays[t] = value >= moved
        value = np.maximum(value, moved) + emitted[t]
    path = np.empty((steps, rows), np.int16)
    state, every = value.argmax(axis=1), np.arange(rows)
    for t in range(steps - 1, -1, -1):
        path[t] = state
        if t:
            state = np.where(stays[t, every, state], state, bests[t])
    return path


def label_words(scores: np.ndarray, offsets: np.ndarray, switch: float, cells: int = 400_000) -> np.ndarray:
    """Language of each word, the words of each text apart. Texts of like length go through Viterbi together."""
    lengths = np.diff(offsets)
    out = np.zeros(len(scores), np.int16)
    order = np.argsort(lengths, kind="stable")[::-1]
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        longest = int(lengths[order[at]])
        some = order[at : at + max(1, cells // longest)]
        at += len(some)
        index = offsets[some][None, :] + np.arange(longest)[:, None]
        inside = np.arange(longest)[:, None] < lengths[some][None, :]
        index = np.where(inside, index, 0)
        path = viterbi(np.where(inside[:, :, None], scores[index], np.float32(0)), switch)
        out[index[inside]] = path[inside]
    return out


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS) -> Model | None:
    """Model of the languages of labelled; None if no row has a language and a word.

    Rows without text or language are left out. Each language gives a hash sample of about train_rows rows, and
    the one of the least hash at least, the same rows in every run; a sample without a word in it fails.
    Counts are summed on the executors; languages times BUCKETS sums reach the driver.
    """
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r for r in labelled.groupBy("lang").agg(F.count("*").alias("rows"), F.min(hash_of("text")).alias("least")).collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    # a sample only where a language has more rows than the bound
    limit = F.create_map(*[F.lit(x) for k in langs for x in (k, max(sizes[k]["least"], highest_hash(train_rows, sizes[k]["rows"])))])
    sample = labelled.where(hash_of("text") <= limit[F.col("lang")])
    number = {k: i for i, k in enumerate(langs)}

    def count(batches):
        counts = np.zeros((BUCKETS + len(NAMES), len(langs)), np.int64)
        for batch in slices(batches):
            lang_of = np.array([number[k] for k in batch.column(0).to_pylist()], np.int64)
            codes, offsets, distinct = word_codes(text_array(batch.column(1)), lower=False)
            if not len(codes):
                continue
            codes, offsets, words, _ = split_words(codes, offsets, distinct)
            if not words:
                continue
            bucket, at, script = word_features(words)
            seen = np.zeros((len(words), len(langs)), np.int64)
            np.add.at(seen, (codes, np.repeat(lang_of, np.diff(offsets))), 1)
            lengths = np.diff(at)
            for k in range(len(langs)):
                counts[:BUCKETS, k] += np.bincount(bucket, np.repeat(seen[:, k], lengths), BUCKETS).astype(np.int64)
                counts[BUCKETS:, k] += np.bincount(script, seen[:, k] * lengths, len(NAMES)).astype(np.int64)
        bucket, k = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(bucket, pa.int32()), pa.array(counts[bucket, k], pa.int64())], ["k", "bucket", "n"])

    got = sample.mapInArrow(count, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((BUCKETS + len(NAMES), len(langs)), np.int64)
    counts[got["bucket"].to_numpy(), got["k"].to_numpy()] = got["n"].to_numpy()
    seen = counts[:BUCKETS].sum(axis=0) > 0
    if lost := [k for k, s in zip(langs, seen, strict=True) if not s and sizes[k]["rows"] > train_rows]:
        raise ValueError(f"no word in the sampled texts of {lost}: raise train_rows")
    if not seen.any():
        return None
    return Model([k for k, s in zip(langs, seen, strict=True) if s], counts[:BUCKETS, seen], counts[BUCKETS:, seen])


def identify(docs: DataFrame, model: Model | None, text: str = "text", switch: float = SWITCH, spans: bool = False) -> DataFrame:
    """docs with lang_pred, score and n_spans, and with spans if asked for.

    The words of a whole text, cut where the script changes or another character than a letter stands, are labelled by Viterbi; lang_pred has the most letters of it and score is its
    share of the letters (ties: the first by name). spans holds (first word, last word, language) of each stretch,
    words being counted by the white space between them, so that two stretches may meet in one. A text that is null or has no letter, or a model of nothing, gives und, 0 and no span.
    Columns of these names are replaced; all other columns and all rows stay.
    """
    from pyspark.sql import types as T

    own = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("n_spans", T.LongType())]
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("lang", T.StringType())])
    if spans:
        own.append(T.StructField("spans", T.ArrayType(span)))
    kept = docs.drop(*(f.name for f in own))
    schema = T.StructType([*kept.schema.fields, *own])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS times languages

    def run(batches):
        model = shared.value
        langs = model.langs if model else []
        for batch in slices(batches):
            n = batch.num_rows
            codes, offsets, distinct = word_codes(text_array(batch.column(text)), lower=False)
            first_word = offsets[:-1]
            codes, offsets, words, number = split_words(codes, offsets, distinct)
            lengths = np.array([len(w) for w in words], np.int64)
            total = sums(lengths[codes] if len(codes) else np.zeros(0, np.int64), offsets)
            pred, score, runs, lists = [None] * n, np.zeros(n), np.zeros(n, np.int64), [[] for _ in range(n)]
            if langs and len(codes):
                path = label_words(model.scores(words)[codes], offsets, switch)
                shares = np.zeros((len(codes), len(langs)), np.int64)
                shares[np.arange(len(codes)), path] = lengths[codes]
                shares = sums(shares, offsets)
                best = shares.argmax(axis=1)
                score = np.where(total > 0, shares[np.arange(n), best] / np.maximum(total, 1), 0)
                pred = [langs[b] for b in best]
                first = np.ones(len(codes), bool)
                first[1:] = path[1:] != path[:-1]
                first[offsets[:-1][offsets[:-1] < len(codes)]] = True
                runs = sums(first.astype(np.int64), offsets)
                if spans:
                    begin = np.flatnonzero(first)
                    end = np.concatenate([begin[1:], [len(codes)]]) - 1
                    doc_of = np.searchsorted(offsets, begin, "right") - 1
                    for a, b, d in zip(begin, end, doc_of, strict=True):
                        lists[d].append({"first": int(number[a] - first_word[d]), "last": int(number[b] - first_word[d]), "lang": langs[path[a]]})
            columns = [pa.array([p if t else "und" for p, t in zip(pred, total, strict=True)] if langs else ["und"] * n, pa.string()), pa.array(score, pa.float64()), pa.array(runs, pa.int64())]
            if spans:
                columns.append(pa.array(lists, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *(f.name for f in own)])
        if model:
            model.fresh()

    return kept.mapInArrow(run, schema)

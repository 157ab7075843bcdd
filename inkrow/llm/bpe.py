"""Byte-level BPE encoding and decoding with a segment tree over byte positions."""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from inkrow.llm._common import slices

#: Pieces whose ids a worker keeps; the store is emptied when it is full.
CACHE_PIECES = 400_000
#: Longer pieces are merged one at a time, so that the trees of a batch stay small.
BATCH_WIDTH = 256
NONE = np.int64(2) ** 62


class Codec:
    """Ranks of a vocabulary file and what encoding needs of them. The id of a token is its rank."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.merged = np.array([self.pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.cache: dict[str, tuple[int, ...]] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, NONE if it is no token."""
        if not len(self.keys):
            return np.full(len(left), NONE)
        key = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], NONE)

    def merge_batch(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        """Ids of pieces of at most width bytes (a power of two), one segment tree a piece.

        A leaf holds rank * width + position of the pair that starts at its byte, so a node's minimum is the
        leftmost pair of least rank. Each round merges the pair at every piece's root and updates the leaves
        of that pair, of its right part and of the live neighbour to its left.
        """
        n = np.array([len(p) for p in pieces])
        flat = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        inside = np.arange(width) < n[:, None]
        ids = np.full((len(pieces), width + 1), -1, np.int64)
        ids[:, :width][inside] = flat
        right = np.broadcast_to(np.arange(1, width + 2), ids.shape).copy()
        left = right - 2
        tree = np.full((len(pieces), 2 * width), NONE)
        pair = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width)
        tree[:, width:] = np.where(pair < NONE, pair * width + np.arange(width), NONE)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])

        def update(rows: np.ndarray, at: np.ndarray, rank: np.ndarray) -> None:
            node = at + width
            tree[rows, node] = np.where(rank < NONE, rank * width + at, NONE)
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            rank, at = np.divmod(tree[rows, 1], width)
            gone = right[rows, at]
            after = right[rows, gone]
            ids[rows, at], ids[rows, gone] = rank, -1
            right[rows, at] = after
            left[rows, np.minimum(after, width)] = at
            update(rows, gone, np.full(len(rows), NONE))
            update(rows, at, self.pair_ranks(rank, ids[rows, np.minimum(after, width)]))
            has = left[rows, at] >= 0
            some, before = rows[has], left[rows, at][has]
            update(some, before, self.pair_ranks(ids[some, before], rank[has]))
            rows = rows[tree[rows, 1] < NONE]
        live = ids[:, :width] >= 0
        ends = np.cumsum(live.sum(axis=1)).tolist()
        out = ids[:, :width][live].tolist()
        return [tuple(out[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same for one long piece, in plain integers."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        ids = [*self.bytes[np.frombuffer(piece, np.uint8)].tolist(), -1]
        right, left, none = list(range(1, n + 2)), list(range(-1, n + 1)), int(NONE)
        tree = [none] * (2 * width)
        for i in range(n - 1):
            if (rank := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(at: int, a: int, b: int) -> None:
            rank = self.pairs.get(a << 32 | b) if a >= 0 and b >= 0 else None
            node = width + at
            tree[node] = none if rank is None else rank * width + at
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] < none:
            rank, at = divmod(tree[1], width)
            gone = right[at]
            after = right[gone]
            ids[at], ids[gone] = rank, -1
            right[at] = after
            left[after] = at
            update(gone, -1, -1)
            update(at, rank, ids[after] if after < n else -1)
            if (before := left[at]) >= 0:
                update(before, ids[before], rank)
        return tuple(x for x in ids if x >= 0)

    def encode_pieces(self, pieces) -> None:
        """Puts the ids of the pieces that aren't there yet into the cache."""
        by_width: dict[int, list[str]] = {}
        for piece in pieces:
            raw = piece.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self.cache[piece] = (rank,)
            elif len(raw) > BATCH_WIDTH:
                self.cache[piece] = self.merge_long(raw)
            else:
                by_width.setdefault(1 << (len(raw) - 1).bit_length(), []).append(piece)
        for width, those in by_width.items():
            step = max(1, 1_000_000 // width)
            for at in range(0, len(those), step):
                some = those[at : at + step]
                self.cache.update(zip(some, self.merge_batch([p.encode() for p in some], width), strict=True))

    def encode(self, texts: list[str]) -> list[list[int]]:
        pieces = [self.pattern.findall(t) for t in texts]
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        self.encode_pieces(set().union(*pieces).difference(self.cache))
        return [list(chain.from_iterable(map(self.cache.__getitem__, p))) for p in pieces]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", output: str = "ids") -> DataFrame:
    """docs with a column of token ids. Null text: no ids. A column of that name is replaced."""
    from pyspark.sql import types as T

    kept = docs.drop(output)
    schema = T.StructType([*kept.schema.fields, T.StructField(output, T.ArrayType(T.IntegerType()))])

    def run(batches):
        own = codec(path, pattern)
        for batch in slices(batches, 500):
            ids = own.encode([t or "" for t in batch.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], [*batch.schema.names, output])

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", output: str = "bytes") -> DataFrame:
    """encoded with a column of the bytes that its ids stand for; null ids: none. An id that isn't in the vocabulary fails."""
    from pyspark.sql import types as T

    kept = encoded.drop(output)
    schema = T.StructType([*kept.schema.fields, T.StructField(output, T.BinaryType())])

    def run(batches):
        own = codec(path, pattern)
        for batch in slices(batches, 500):
            out = [own.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, output])

    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes each text, decodes the ids again and returns the digests of both.

    One row per input row: key, n_tokens, ids_sha256, decoded_sha256. Null text counts as empty; a null key
    stays null; repeated rows stay; other columns aren't read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        own = codec(path, pattern)
        digits = {i: str(i) for i in own.tokens}
        for batch in slices(batches, 500):
            ids = own.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(digits.__getitem__, x)).encode()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")

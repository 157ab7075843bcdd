"""Language model scoring: a hierarchical Pitman-Yor model whose seating is sampled by Gibbs."""

from __future__ import annotations

import random
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkrow.llm._common import mix64, new_path, partitions, slices, stored, sums, trim, trimmed, word_codes

#: Discount and strength of the contexts' restaurants and of the root, their parent.
DISCOUNT, STRENGTH = (0.75, 0.6), (2.0, 20.0)
#: Sweeps before the first sample, and samples whose predictive probabilities are averaged.
BURN_IN, SAMPLES = 1, 2
#: So many dishes or fewer that have further customers are gone through by themselves.
FEW = 48
#: Characters of texts in one packed block.
BLOCK_CHARS = 14 << 20
#: Bytes of a block's texts that are taken apart at once.
PART_BYTES = 2 << 20
#: A context of so many customers is dealt in parts, by dish. The list of these contexts has at most two entries for so many tokens.
HOT = 4_000_000
#: The context of a text's first token and the dish that ends a text, where words have their hashes.
START, END = 1, 2
#: Bits of a dish's hash. A context has 64 bits, for its count is exact.
DISH_BITS = 48


def squeeze(values: np.ndarray) -> bytes:
    """An array's bytes, those of equal significance together, compressed."""
    if not len(values):
        return b""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes())


def spread(raw: bytes, kind) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack(docs: DataFrame) -> DataFrame:
    """Blocks of whole documents (key, text, learned): block, number, keys and compressed texts with a flag for those to learn from.

    A block is filled from one task's rows up to BLOCK_CHARS, so that no key decides its size; a longer text is a block by itself.
    """
    schema = "block long, keys binary, learned binary, lengths binary, body binary"

    def run(batches):
        from pyspark import TaskContext

        held, size, number = [], 0, TaskContext.get().partitionId() << 24

        def block():
            own = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.select(["key"]).schema) as out:
                out.write_table(own.select(["key"]))
            raw = [t.encode() for t in own["text"].to_pylist()]
            flags = np.array(own["learned"].to_pylist(), np.int8)
            columns = [number, sink.getvalue().to_pybytes(), flags.tobytes(), np.array([len(r) for r in raw], np.int64).tobytes(), zstandard.ZstdCompressor(level=3).compress(b"".join(raw))]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds, strict=True)], ["block", "keys", "learned", "lengths", "body"])

        for batch in slices(batches, 100):
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
            if size >= BLOCK_CHARS:
                yield block()
                held, size, number = [], 0, number + 1
        if sum(b.num_rows for b in held):
            yield block()

    return docs.mapInArrow(trimmed(run), schema)


def parts_of(row: dict):
    """A block's texts in parts of up to PART_BYTES: (code of each word, where each text's words start and end, distinct words)."""
    lengths = np.frombuffer(row["lengths"], np.int64)
    ends = np.cumsum(lengths)
    body = zstandard.ZstdDecompressor().decompress(row["body"]) if ends[-1] else b""
    at = 0
    while at < len(lengths):
        begin = int(ends[at] - lengths[at])
        to = max(at + 1, int(np.searchsorted(ends, begin + PART_BYTES, "right")))
        offsets = np.concatenate([[0], ends[at:to] - begin]).astype(np.int64)
        yield word_codes(pa.LargeStringArray.from_buffers(to - at, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body[begin : int(ends[to - 1])])))
        at = to


def hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def placed(values: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, place of each value in them) of whole numbers from 0 to below - 1. Where both fit into 63 bits, values are sorted with their places in one word, which is quicker than to sort places by values."""
    bits = len(values).bit_length()
    if int(below).bit_length() + bits > 63:
        return np.unique(values, return_inverse=True)
    both = values.astype(np.int64) << bits
    both |= np.arange(len(values))
    both.sort()
    at = both & ((1 << bits) - 1)
    both >>= bits
    new = np.diff(both, prepend=-1) > 0
    out = np.empty(len(values), np.int64)
    out[at] = np.cumsum(new) - 1
    return both[new], out


class Block:
    """A block's tokens as (context, dish) pairs; the pairs are in the order of the shares that they are dealt to.

    offsets, where each text's tokens start and end; words, hashes of the distinct ones; word and pair of each token; of each pair its
    share, its context's place in words (behind them: START) and hash, and its dish.
    """

    def __init__(self, row: dict, hot: tuple[np.ndarray, np.ndarray], shares: int):
        parts, found, lengths, begin = list(parts_of(row)), [], [], 0
        # a word of several parts is hashed once
        every = pa.chunked_array([distinct.cast(pa.large_string()) for *_, distinct in parts]).combine_chunks().dictionary_encode()
        self.words, place = np.unique(np.append(hashes(every.dictionary), np.uint64(END)), return_inverse=True)
        of, end = place[:-1][every.indices.to_numpy(zero_copy_only=False)], place[-1]
        for codes, starts, distinct in parts:
            n = len(starts) - 1
            out = np.full(len(codes) + n, end, np.int64)
            out[np.arange(len(codes)) + np.repeat(np.arange(n), np.diff(starts))] = of[begin : begin + len(distinct)][codes]
            begin += len(distinct)
            found.append(out)
            lengths.append(np.diff(starts) + 1)
        self.learned = np.frombuffer(row["learned"], np.int8) > 0
        self.offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        self.word = np.concatenate(found)
        del parts, found, every, of
        n = len(self.words)
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        before[self.offsets[:-1]] = n
        pair, at = placed(before * n + self.word, (n + 1) * n)
        del before
        names = np.append(self.words, np.uint64(START))
        opened, dish = pair // n, names[pair % n] >> np.uint64(64 - DISH_BITS)
        share = dealt(names[opened], dish, hot, shares)
        # numbers of 16 bits are sorted by their digits
        order = np.argsort(share.astype(np.uint16) if shares <= 1 << 16 else share, kind="stable")
        self.share, self.opened, self.dish = share[order], opened[order], dish[order]
        self.context = names[self.opened]
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.pair = place[at]

    def counts(self) -> np.ndarray:
        return np.bincount(self.pair[np.repeat(self.learned, np.diff(self.offsets))], minlength=len(self.share))

    def rows(self):
        """(share, its pairs as a slice, where contexts begin in it) of each share with pairs."""
        first = np.flatnonzero(np.diff(self.share, prepend=-1))
        for begin, end in zip(first, np.append(first[1:], len(self.share)), strict=True):
            yield int(self.share[begin]), slice(begin, end), np.flatnonzero(np.diff(self.opened[begin:end], prepend=-1))


def dealt(context: np.ndarray, dish: np.ndarray, hot: tuple[np.ndarray, np.ndarray], shares: int) -> np.ndarray:
    """Share of each pair: by its context, of a hot one by one of the context's parts as well."""
    parts = parts_of_contexts(context, hot).astype(np.uint64)
    return (mix64(context + (dish % parts) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(shares)).astype(np.int64)


def parts_of_contexts(context: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    if not len(hot[0]):
        return np.ones(len(context), np.int64)
    at = np.minimum(np.searchsorted(hot[0], context), len(hot[0]) - 1)
    return np.where(hot[0][at] == context, hot[1][at], 1)


def hot_contexts(blocks: DataFrame, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number of parts) of the contexts with HOT customers. Blocks name what could be one: what they leave out of a context is under a quarter of HOT."""
    least = HOT / (4 * n_blocks)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                learned, at, total = np.frombuffer(row["learned"], np.int8) > 0, 0, {}
                parts = 1 + 2 * np.frombuffer(row["lengths"], np.int64).sum() / PART_BYTES  # at most so many
                for codes, starts, distinct in parts_of(row):
                    own = np.bincount(codes[np.repeat(learned[at : at + len(starts) - 1], np.diff(starts))], minlength=len(distinct))
                    at += len(starts) - 1
                    some = np.flatnonzero(own >= least / parts)
                    for h, c in zip(hashes(distinct.take(pa.array(some))).astype(np.int64).tolist(), own[some].tolist(), strict=True):
                        total[h] = total.get(h, 0) + c
                total[START] = int(learned.sum())
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["context", "n"])

    rows = blocks.mapInArrow(trimmed(run), "context long, n long").groupBy("context").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT // 2).collect()
    hot = np.array(sorted((r["context"] % 2**64, 1 + 2 * r["n"] // HOT) for r in rows), np.uint64).reshape(-1, 2)
    return hot[:, 0], hot[:, 1].astype(np.int64)


def counted(blocks: DataFrame, hot, shares: int) -> DataFrame:
    """One row for each share that a block has pairs for: the contexts, how many pairs each has, and of each pair the dish and its count in texts to learn from."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, hot.value, shares)
                count = block.counts()
                for share, own, first in block.rows():
                    context = block.context[own][first]
                    columns = [np.diff(context, prepend=np.uint64(0)), np.diff(np.append(first, own.stop - own.start)).astype(np.uint32), block.dish[own], count[own].astype(np.uint32)]
                    yield pa.RecordBatch.from_arrays([pa.array([share], pa.int32()), pa.array([row["block"]], pa.int64()), *(pa.array([squeeze(c)], pa.binary()) for c in columns)], ["share", "block", "context", "pairs", "dish", "count"])

    return blocks.mapInArrow(trimmed(run), "share int, block long, context binary, pairs binary, dish binary, count binary")


class Seats:
    """Who sits at which table: of each dish of each restaurant its customers, all at one table at first.

    Dishes are seated independently of each other, so that those of many restaurants are gone through side by side, one customer each at a time; quickest with those of most customers first.
    """

    def __init__(self, count: np.ndarray):
        self.count, self.first = count, np.cumsum(count) - count
        self.tables, self.seated = np.minimum(count, 1), count.copy()
        self.table, self.size = np.zeros(int(count.sum()), np.int32), np.zeros(int(count.sum()), np.int32)
        self.size[self.first[count > 0]] = count[count > 0]
        self._spare()

    def _spare(self):
        """Numbers of tables that aren't in use: of each dish a stack, of count - tables numbers."""
        at = np.arange(len(self.table)) - np.repeat(self.first, self.count)
        self.free = (at + np.repeat(self.tables, self.count)).astype(np.int32)

    def resize(self, count: np.ndarray, weight: float, discount: float, rng: np.random.Generator):
        """Other numbers of customers: any leave, as their order doesn't matter the last ones, and new ones come in and sit down."""
        kept = np.minimum(self.count, count)
        own, first = np.repeat(np.arange(len(count)), kept), np.cumsum(count) - count
        place = np.arange(len(own)) - np.repeat(np.cumsum(kept) - kept, kept)
        used, at = np.unique(own << 32 | self.table[self.first[own] + place], return_inverse=True)
        of = used >> 32
        number = np.arange(len(used)) - np.searchsorted(of, of)
        table, size = np.zeros(int(count.sum()), np.int32), np.zeros(int(count.sum()), np.int32)
        table[first[own] + place] = number[at]
        size[first[of] + number] = np.bincount(at, minlength=len(used))
        self.count, self.first, self.table, self.size, self.seated, self.tables = count, first, table, size, kept, np.bincount(of, minlength=len(count))
        self._spare()
        rows = np.flatnonzero(kept < count)
        self._each(rows, kept[rows], np.full(len(count), weight), discount, rng, True)

    def sweep(self, weight: np.ndarray | float, discount: float, rng: np.random.Generator):
        """Every customer stands up and sits down again, one at a time, given where all others of its dish sit: at a table in proportion to those there less the discount, or at a new one in proportion to weight."""
        weight = np.broadcast_to(weight, self.count.shape)
        # a single customer leaves no other choice than its table
        if (np.diff(self.count) <= 0).all():
            self._each(slice(0, int(np.count_nonzero(self.count > 1))), 0, weight, discount, rng, False)
        else:
            rows = np.flatnonzero(self.count > 1)
            self._each(rows, np.zeros(len(rows), np.int64), weight, discount, rng, False)

    def _each(self, rows: np.ndarray | slice, turn: np.ndarray | int, weight: np.ndarray, discount: float, rng: np.random.Generator, come: bool):
        """Customers from place turn on of the dishes in rows; of a slice, whose counts descend, turn is that of all."""
        whole = isinstance(rows, slice)
        while (width := rows.stop if whole else len(rows)) > FEW:
            f, n, t, a, spare = self.first[rows], self.seated[rows], self.tables[rows], weight[rows], self.count[rows]
            place = f + turn
            if not come:
                k = self.table[place]
                left = self.size[f + k] - 1
                self.size[f + k] = left
                gone = np.flatnonzero(left == 0)
                self.free[f[gone] + spare[gone] - t[gone]] = k[gone]
                t[gone] -= 1
                n = n - 1
            opens = rng.random(width) * (a + n - discount * t) < a
            # who doesn't open a table joins the one that is left, or of several one that is met by a customer who sits there, unless the discount has it
            new = self.table[f + (0 if come else turn == 0)]
            some = np.flatnonzero(opens)
            new[some] = self.free[f[some] + spare[some] - t[some] - 1]
            choose = np.flatnonzero(~opens & (t > 1))
            t[some] += 1
            while len(choose):
                own = f[choose]
                u = rng.random(len(choose)) * n[choose]
                with_ = u.astype(np.int64)
                u -= with_
                if not come:
                    with_ += with_ >= (turn if whole else turn[choose])
                k = self.table[own + with_]
                taken = u * self.size[own + k] >= discount
                new[choose[taken]] = k[taken]
                choose = choose[~taken]
            self.table[place] = new
            self.size[f + new] += 1
            self.tables[rows] = t
            if come:
                self.seated[rows] += 1
            turn = turn + 1
            if whole:
                rows = slice(0, int(np.searchsorted(-spare, -turn)))
            else:
                more = turn < spare
                rows, turn = rows[more], turn[more]
        if whole:
            rows = np.arange(rows.stop)
            turn = np.full(len(rows), turn)
        draw = random.Random(int(rng.integers(1 << 62))).random
        for row, begin in zip(rows.tolist(), turn.tolist(), strict=True):
            self._rest(row, begin, float(weight[row]), discount, draw, come)

    def _rest(self, row: int, begin: int, weight: float, discount: float, draw, come: bool):
        """The same for the last customers of one dish: where few dishes have so many, arrays of one customer each would take longer."""
        own = slice(int(self.first[row]), int(self.first[row] + self.count[row]))
        arrays = self.table[own], self.size[own], self.free[own]
        count, t, n = own.stop - own.start, int(self.tables[row]), int(self.seated[row]) - (not come)
        # lists are faster, but take many times the memory
        lists = count <= 1 << 18
        table, size, free = (x.tolist() if lists else memoryview(x) for x in arrays)
        every = weight + n - discount * t
        for turn in range(begin, count):
            if not come:
                k = table[turn]
                left = size[k] - 1
                size[k] = left
                if not left:
                    free[count - t] = k
                    t -= 1
                    every += discount
            if draw() * every < weight:
                k = free[count - t - 1]
                t += 1
                every -= discount
            elif t == 1:
                k = table[0 if come or turn else 1]
            else:
                while True:
                    u = draw() * n
                    with_ = int(u)
                    k = table[with_ if come or with_ < turn else with_ + 1]
                    # what is left of the draw is as good as another one
                    if (u - with_) * size[k] >= discount:
                        break
            table[turn] = k
            size[k] += 1
            if come:
                n += 1
                every += 1
        if lists:
            for array, values in zip(arrays, (table, size, free), strict=True):
                array[:] = values
        self.tables[row], self.seated[row] = t, count


def new_table(totals: np.ndarray | int, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray | float:
    """What a new table weighs, but for its dish's probability in the parent, in restaurants with so many tables: the discount times a gamma variable, whose integral is the rising product of strength + discount * k."""
    return discount * rng.standard_gamma(strength / discount + totals)


def seat(seats: Seats | np.ndarray, parent: np.ndarray, restaurant: np.ndarray, totals: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after a sweep, in restaurants with so many tables in all. Numbers of customers in place of seats sit at one table of their dish before."""
    seats = seats if isinstance(seats, Seats) else Seats(seats)
    seats.sweep(new_table(totals, discount, strength, rng)[restaurant] * parent, discount, rng)
    return seats.tables


class Share:
    """The pairs of one share, added up over blocks, and their sampled tables.

    The draws depend on the share's pairs only, in no order of arrival: a task that runs again seats the same. sampled are the tables, as told() gives them, where they were drawn before.
    """

    def __init__(self, rows: pa.Table, hot: tuple[np.ndarray, np.ndarray], sampled: bytes | None = None):
        self.rows = sorted(rows.to_pylist(), key=lambda r: r["block"])
        context = [np.cumsum(spread(r["context"], np.uint64), dtype=np.uint64) for r in self.rows]
        pairs = [spread(r["pairs"], np.uint32) for r in self.rows]
        count = np.concatenate([spread(r["count"], np.uint32) for r in self.rows])
        self.ends = np.cumsum([p.sum() for p in pairs])
        self.dishes, d = np.unique(np.concatenate([spread(r["dish"], np.uint64) for r in self.rows]), return_inverse=True)
        self.contexts, self.opened = np.unique(np.concatenate(context), return_inverse=True)
        self.opened_ends = np.cumsum([len(c) for c in context])
        n = len(self.dishes)
        key, self.pair = placed(np.repeat(self.opened, np.concatenate(pairs)) * n + d, len(self.contexts) * n)
        del d, context, pairs
        self.context, self.dish = key // n, key % n
        self.count = np.bincount(self.pair, count, len(key)).astype(np.int64)  # exact under 2**53
        self.parts = parts_of_contexts(self.contexts, hot)
        self.tables = np.zeros((SAMPLES, len(key)), np.int64)
        some = self.count > 0
        if sampled is not None:
            self.tables[:, some] = spread(sampled, np.uint32).reshape(SAMPLES, -1)
        elif some.any():
            self.tables[:, some] = gibbs(self.context[some], self.dish[some], self.count[some], self.parts, len(self.dishes), rows["share"][0].as_py())
        self.customers = np.bincount(self.context, self.count, len(self.contexts)).astype(np.int64)
        self.opened_tables = np.stack([np.bincount(self.context, t, len(self.contexts)) for t in self.tables]).astype(np.int64)

    def told(self) -> bytes:
        return squeeze(self.tables[:, self.count > 0].ravel().astype(np.uint32))

    def letters(self, shares: int):
        """(where to, its dishes, its split contexts), as places."""
        dish_to = (mix64(self.dishes) % np.uint64(shares)).astype(np.int64)
        split = np.flatnonzero(self.parts > 1)
        split_to = (mix64(self.contexts[split]) % np.uint64(shares)).astype(np.int64)
        order = np.argsort(dish_to, kind="stable")
        first = np.flatnonzero(np.diff(dish_to[order], prepend=-1))
        own = {int(dish_to[order[b]]): order[b:e] for b, e in zip(first, np.append(first[1:], len(order)), strict=True)}
        none = np.zeros(0, np.int64)
        for to in sorted({*own, *split_to.tolist()}):
            yield to, own.get(to, none), split[split_to == to]


def gibbs(context: np.ndarray, dish: np.ndarray, count: np.ndarray, parts: np.ndarray, n_dishes: int, seed: int) -> np.ndarray:
    """Tables [sample, pair] of one share's restaurants, by Gibbs sampling: in a sweep every customer of the root and of each restaurant stands up and sits down again, one at a time.

    Dishes of a restaurant depend on each other by its number of tables only, and restaurants by the root. With a gamma variable drawn for a restaurant, given its tables, a new table's weight is discount * variable * parent
    whatever the others do, and with the root's masses drawn, given its tables, the restaurants are independent. So customers of
    different dishes may move side by side, and the sweep is that of one after the other. The root is seated from this share's tables alone; what it keeps for unseen tables goes to all dishes alike; a split context's
    total is that of its part times its parts.
    """
    rng = np.random.default_rng(seed)
    known, dish = np.unique(dish, return_inverse=True)
    n = len(known)
    order = np.argsort(-count, kind="stable")
    context, dish, count = context[order], dish[order], count[order]
    seats, root = Seats(count), Seats(np.bincount(dish, minlength=n))
    out = np.zeros((SAMPLES, len(count)), np.int64)
    for sweep in range(BURN_IN + SAMPLES):
        weight = new_table(root.tables.sum(), DISCOUNT[1], STRENGTH[1], rng) / (n + 1)
        root.resize(np.bincount(dish, seats.tables, n).astype(np.int64), weight, DISCOUNT[1], rng)
        root.sweep(weight, DISCOUNT[1], rng)
        mass, rest = rng.standard_gamma(root.count - DISCOUNT[1] * root.tables), rng.standard_gamma(STRENGTH[1] + DISCOUNT[1] * root.tables.sum())
        parent = (mass + rest / (n + 1)) / (mass.sum() + rest)
        tables = seat(seats, parent[dish], context, np.bincount(context, seats.tables, len(parts)) * parts, DISCOUNT[0], STRENGTH[0], rng)
        if sweep >= BURN_IN:
            out[sweep - BURN_IN, order] = tables
    return out


LETTER = ["share", "to", "dish", *(f"tables_{s}" for s in range(SAMPLES)), "context", "customers", *(f"opened_{s}" for s in range(SAMPLES)), "tokens", "words", "sampled"]
LETTER_SCHEMA = ", ".join(f"{c} {'int' if c in ('share', 'to') else 'long' if c in ('tokens', 'words') else 'binary'}" for c in LETTER)


def sent(pairs: DataFrame, hot, shares: int) -> DataFrame:
    """From each share to those that the root's dishes are dealt to: the tables that it has of each dish, and its part of split contexts."""

    def run(rows: pa.Table) -> pa.Table:
        own, out = Share(rows, hot.value), []
        whole = own.parts == 1
        told = [int(own.customers[whole].sum()), int((own.customers[whole] > 0).sum()), own.told()]
        served = [np.bincount(own.dish, t, len(own.dishes)).astype(np.int64) for t in own.tables]
        for to, dish, split in own.letters(shares):
            columns = [np.diff(own.dishes[dish], prepend=np.uint64(0)), *(t[dish] for t in served), own.contexts[split], own.customers[split], *(t[split] for t in own.opened_tables)]
            out.append([rows["share"][0].as_py(), to, *map(squeeze, columns), *told])
            told = [0, 0, b""]
        trim()
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), LETTER_KINDS, strict=True)], LETTER)

    return pairs.groupBy("share").applyInArrow(run, LETTER_SCHEMA)


LETTER_KINDS = [pa.int32(), pa.int32(), *[pa.binary()] * (3 + 2 * SAMPLES), pa.int64(), pa.int64(), pa.binary()]
ANSWER = ["share", "to", *(f"mass_{s}" for s in range(SAMPLES)), "customers", *(f"opened_{s}" for s in range(SAMPLES)), "sampled"]
TOTALS = ["tokens", "words", *(f"tables_{s}" for s in range(SAMPLES)), *(f"root_{s}" for s in range(SAMPLES))]
ANSWER_KINDS = [pa.int32(), pa.int32(), *[pa.binary()] * (2 + 2 * SAMPLES), *[pa.int64()] * len(TOTALS)]


def rooted(letters: DataFrame, shares: int) -> DataFrame:
    """The root's seating of its dishes, dealt by hash, by Gibbs sweeps: an answer to each letter (each dish's customers less discounts, and split contexts added up), and a row of share -1 with totals.

    A dish's seating depends on other dishes through the root's total only, which in each sweep is the share's own times the number of shares.
    """
    schema = ", ".join(f"{c} {'int' if c in ('share', 'to') else 'binary'}" for c in ANSWER) + ", " + ", ".join(f"{c} long" for c in TOTALS)

    def run(rows: pa.Table) -> pa.Table:
        got = sorted(rows.to_pylist(), key=lambda r: r["share"])
        rng = np.random.default_rng(got[0]["to"])
        ends = np.cumsum([0, *((len(spread(r["dish"], np.uint64))) for r in got)])
        dishes, dish = np.unique(np.concatenate([np.cumsum(spread(r["dish"], np.uint64), dtype=np.uint64) for r in got]), return_inverse=True)
        names, context = np.unique(np.concatenate([spread(r["context"], np.uint64) for r in got]), return_inverse=True)
        context_ends = np.cumsum([0, *(len(spread(r["context"], np.uint64)) for r in got)])
        added = lambda column, at, n: np.bincount(at, np.concatenate([spread(r[column], np.int64) for r in got]), n).astype(np.int64)
        split = [added(c, context, len(names)) for c in ANSWER[2 + SAMPLES : -1]]
        totals, mass = [sum(r["tokens"] for r in got) + int(split[0].sum()), sum(r["words"] for r in got) + int((split[0] > 0).sum())], []
        served = [added(f"tables_{s}", dish, len(dishes)) for s in range(SAMPLES)]
        roots = []
        for customers in served:
            order = np.argsort(-customers, kind="stable")
            seats, root = Seats(customers[order]), np.zeros(len(dishes), np.int64)
            base = np.full(len(dishes), 1 / (int(seats.tables.sum()) * shares + 1))
            for _ in range(1 + BURN_IN):
                root[order] = seat(seats, base, np.zeros(len(dishes), np.int64), np.array([seats.tables.sum() * shares]), DISCOUNT[1], STRENGTH[1], rng)
            roots.append(root)
            mass.append((customers - DISCOUNT[1] * root).astype(np.float32))
        totals += [int(c.sum()) for c in served] + [int(r.sum()) for r in roots]
        out = [[-1, got[0]["to"], *[b""] * (2 + 2 * SAMPLES), *totals]]
        for i, r in enumerate(got):
            own, split_own = dish[ends[i] : ends[i + 1]], context[context_ends[i] : context_ends[i + 1]]
            out.append([r["share"], r["to"], *(squeeze(m[own]) for m in mass), *(squeeze(c[split_own]) for c in split), r["sampled"], *[0] * len(TOTALS)])
        trim()
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), ANSWER_KINDS, strict=True)], ANSWER + TOTALS)

    return letters.groupBy("to").applyInArrow(run, schema)


def root_probability(totals: dict, sample: int, mass: np.ndarray) -> np.ndarray:
    """Of dishes with such customers less discounts; 0 is that of the one unknown word."""
    unknown = (STRENGTH[1] + DISCOUNT[1] * totals[f"root_{sample}"]) / (totals["words"] + 1)
    return (mass + unknown) / (STRENGTH[1] + totals[f"tables_{sample}"])


def predictive(share: Share, answers: list[dict], shares: int) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each pair, averaged over samples; customers of each context)."""
    totals, by = answers[0]["totals"], {a["to"]: a for a in answers}
    mass = np.zeros((SAMPLES, len(share.dishes)))
    customers, opened = share.customers.copy(), share.opened_tables.copy()
    for to, dish, split in share.letters(shares):
        for s in range(SAMPLES):
            mass[s][dish] = spread(by[to][f"mass_{s}"], np.float32)
            opened[s][split] = spread(by[to][f"opened_{s}"], np.int64)
        customers[split] = spread(by[to]["customers"], np.int64)
    out = np.zeros(len(share.count))
    for s in range(SAMPLES):
        parent = root_probability(totals, s, mass[s])[share.dish]
        out += (share.count - DISCOUNT[0] * share.tables[s] + (STRENGTH[0] + DISCOUNT[0] * opened[s][share.context]) * parent) / (STRENGTH[0] + customers[share.context])
    return out / SAMPLES, customers


def answered(pairs: DataFrame, answers: DataFrame, hot, shares: int) -> DataFrame:
    """For each row of pairs, in its order: log10 of the predictive probabilities, and the contexts' customers."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        share = Share(left, hot.value, b"".join(right["sampled"].to_pylist()))
        p, customers = predictive(share, right.to_pylist(), shares)
        logs, out, begin, first = np.log10(p).astype(np.float32), [], 0, 0
        totals = right["totals"][0].as_py()
        for row, end, last in zip(share.rows, share.ends, share.opened_ends, strict=True):
            out.append([row["block"], row["share"], squeeze(logs[share.pair[begin:end]]), squeeze(customers[share.opened[first:last]]), totals["tokens"], totals["words"]])
            begin, first = end, last
        trim()
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()], strict=True)], ["block", "share", "logs", "customers", "tokens", "words"])

    return pairs.groupBy("share").cogroup(answers.groupBy("share")).applyInArrow(run, "block long, share int, logs binary, customers binary, tokens long, words long")


def score(docs: DataFrame, learned: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_tokens, n_known, train_tokens, base_score, score and perplexity.

    Tokens are the words between ASCII white space, A-Z lower-cased, and one end; a null text has the end alone. The model learns from all rows where
    learned is true and scores all rows. Every previous word is a context with a restaurant of its own, as is a text's start; the root is their parent.
    score is the log10 probability of the text, from predictive probabilities averaged over samples; a word that wasn't learned counts as the one
    unknown word. base_score is that of add-one counts. Null keys and repeated rows stay; keys are of any type. With nothing to learn from,
    every token has probability 1.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"), F.coalesce(learned, F.lit(False)).alias("learned"))
    name = f"lm_blocks_{uuid.uuid4().hex}"
    # bucketed, so that texts aren't shuffled when the probabilities come back to them
    pack(own).write.bucketBy(partitions(spark), "block").option("path", new_path(spark, "lm-blocks")).saveAsTable(name)
    blocks = spark.table(name)
    n_blocks = max(1, blocks.select("block").count())
    shares = max(partitions(spark), n_blocks)
    hot = spark.sparkContext.broadcast(hot_contexts(blocks, n_blocks))
    # used twice, for the letters and for what is answered; written out by share, so that they are neither made nor shuffled twice
    held = f"lm_pairs_{uuid.uuid4().hex}"
    counted(blocks, hot, shares).repartition(shares, "share").write.bucketBy(shares, "share").option("path", new_path(spark, "lm-pairs")).saveAsTable(held)
    pairs = spark.table(held)
    # used twice, for its totals and its answers
    answers = stored(rooted(sent(pairs, hot, shares), shares), "lm-answers")
    totals = answers.where("share < 0").agg(F.struct(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOTALS)).alias("totals")).scalar()
    back = answered(pairs, answers.where("share >= 0").select(*ANSWER, totals.alias("totals")), hot, shares)
    names = [key, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got, parts = sorted(right.to_pylist(), key=lambda r: r["share"]), []
        for row in left.to_pylist():
            block = Block(row, hot.value, shares)
            logs, count = np.concatenate([spread(r["logs"], np.float32) for r in got]).astype(np.float64), np.zeros(len(block.words) + 1, np.int64)
            for (_, pairs_, first), r in zip(block.rows(), got, strict=True):
                count[block.opened[pairs_][first]] = spread(r["customers"], np.int64)
            count[:-1][block.words == END] = count[-1]  # a text that starts also ends
            tokens, words = got[0]["tokens"], got[0]["words"]
            n = np.diff(block.offsets)
            total = sums(logs[block.pair], block.offsets)
            base = sums(np.log10((count + 1) / (tokens + words + 1))[block.word], block.offsets)
            known = sums((count > 0)[block.word].astype(np.int64), block.offsets)
            keys = pa.ipc.open_stream(row["keys"]).read_all()["key"].combine_chunks().cast(out_kind)
            parts.append(pa.table([keys, pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), tokens), pa.int64()), pa.array(base), pa.array(total), pa.array(10 ** np.minimum(-total / n, 300))], names))
        trim()
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], t) for t in (out_kind, *[pa.int64()] * 3, *[pa.float64()] * 3)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    out_kind, kind = to_arrow_type(docs.schema[key].dataType), docs.schema[key].dataType.simpleString()
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, f"`{key}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")

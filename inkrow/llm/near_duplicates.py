"""MinHash near-duplicates: an inverted join of signature coordinates, confirmed on the full shingle sets."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkrow.llm._common import free, mix64, slices, stored, text_array, word_codes

#: Words of a shingle; links need 100 * shared >= percent * all, PERCENT if nothing else is asked for.
WORDS, PERCENT = 5, 85
#: Coordinates of a signature, and the share of pairs just alike enough that may agree in too few of them.
COORDINATES, LOSS = 64, 1.6e-7
#: Node ids up to so many, with keys of so many bytes as text, are broadcast when their texts are looked for again.
MOST_BROADCAST, MOST_BYTES = 1_000_000, 32 << 20
#: Shingles and nodes of a chunk of a family.
CHUNK, CHUNK_NODES = 1 << 17, 1_024
RNG = np.random.default_rng(8)
FACTORS = RNG.integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = RNG.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def matches(percent: int) -> int:
    """Coordinates that must agree: the most that all but LOSS of the pairs with a likeness of percent reach (38 at 85, 33 at 80)."""
    p, under, m = percent / 100, 0.0, 0
    while m < COORDINATES and (under := under + math.comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)) <= LOSS:
        m += 1
    return max(1, m)


def word_hashes(distinct: pa.Array) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w) for w in distinct.cast(pa.binary()).to_pylist()], np.uint64)


def shingle_hashes(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; a text of fewer words, but not none, has one of all its words."""
    codes, offsets, distinct = word_codes(texts)
    hashed = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    out = []
    if len(hashed) >= words:
        rolled = np.zeros(len(hashed) - words + 1, np.uint64)
        for i in range(words):
            rolled = mix64(rolled + hashed[i : len(hashed) - words + 1 + i])
    else:
        rolled = np.zeros(0, np.uint64)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        else:
            one = np.zeros(min(1, b - a), np.uint64)
            for h in hashed[a:b]:
                one = mix64(one + h)
            out.append(one if b == a else mix64(one + np.uint64(b - a)))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """Least value of each coordinate's permutation, its upper 31 bits."""
    out = np.empty(COORDINATES, np.int32)
    for i in range(0, COORDINATES, 16):
        mixed = hashes[None, :] * FACTORS[i : i + 16, None] + SHIFTS[i : i + 16, None]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        out[i : i + 16] = (mixed.min(axis=1) >> np.uint64(33)).astype(np.int32)
    return out


def node_of(hashes: np.ndarray) -> bytes:
    """Name of a shingle set: equal sets are one node, and 128 bits keep different ones apart."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def sets(docs: DataFrame, words: int) -> DataFrame:
    """key, node, n_shingles, signature and a hash of the text of every row; without words node and signature are null."""

    def run(batches):
        for batch in slices(batches, 500):
            hashes = shingle_hashes(text_array(batch.column(1)), words)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([node_of(h) if len(h) else None for h in hashes], pa.binary()),
                    pa.array([len(h) for h in hashes], pa.int64()),
                    pa.array([signature(h) if len(h) else None for h in hashes], pa.list_(pa.int32())),
                    batch.column(2),
                ],
                ["key", "node", "n", "signature", "digest"],
            )

    kind = docs.schema["key"].dataType.simpleString()
    return docs.select("key", "text", F.xxhash64("text").alias("digest")).mapInArrow(run, f"key {kind}, node binary, n long, signature array<int>, digest long")


def postings(nodes: DataFrame, least: int) -> DataFrame:
    """token, node, n and central: the signature prefix of every node.

    A token is a coordinate with its value. Nodes that agree in least coordinates share a token among the COORDINATES - least + 1 rarest of
    either (by count, then token). Tokens of one node only come first and need no posting, so most nodes have none. central sums the tokens'
    logarithmic counts: the node most like the others has the most.
    """
    prefix = COORDINATES - least + 1
    exploded = nodes.select("node", "n", F.posexplode("signature").alias("at", "value")).select("node", "n", F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(F.col("value").cast("long")).alias("token"))
    counts = exploded.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = exploded.join(counts, "token")
    own = Window.partitionBy("node")
    ranked = shared.withColumns({"place": F.row_number().over(own.orderBy("df", "token")), "many": F.count("*").over(own), "central": F.sum(F.log2("df")).over(own)})
    return ranked.where(F.col("place") <= F.lit(prefix - COORDINATES) + F.col("many")).select("token", "node", "n", "central")


def agreeing(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that agree in enough coordinates: the skip step, which looks up whole signatures rather than merging the long postings."""
    one = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa"), F.col("n").alias("na"))
    two = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"), F.col("n").alias("nb"))
    both = pairs.join(one, "a").join(two, "b")
    agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda z: z))
    fits = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return both.where(fits & (agree >= matches(percent))).select("a", "b")


def full_sets(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """node, its whole set of shingles and its signature for the ids (node, rep); the text of one row of each node is read again."""
    n, n_bytes = ids.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("rep").cast("string")).cast("long")), F.lit(0))).first()
    wanted = F.broadcast(ids) if n <= MOST_BROADCAST and n_bytes <= MOST_BYTES else ids
    rows = docs.join(wanted, docs["key"].eqNullSafe(wanted["rep"])).select("node", "text")

    def run(batches):
        for batch in slices(batches, 500):
            hashes = shingle_hashes(text_array(batch.column(1)), words)
            keep = [len(h) > 0 and node_of(h) == node for h, node in zip(hashes, batch.column(0).to_pylist(), strict=True)]
            signs = pa.array([signature(h) if k else None for h, k in zip(hashes, keep, strict=True)], pa.list_(pa.int32()))
            own = pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.view(np.int64) for h in hashes], pa.list_(pa.int64())), signs], ["node", "shingles", "signature"])
            yield pc.filter(own, pa.array(keep, pa.bool_()))

    # one row a node before it is written, so that joins with many pairs of one node can be split
    return stored(rows.mapInArrow(run, "node binary, shingles array<long>, signature array<int>").dropDuplicates(["node"]), "near-full")


def confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs whose full sets are alike enough."""
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "rep"), "node"), "near-ids")
    full = full_sets(ids, docs, words)
    both = pairs.join(full.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(full.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def shared_counts(lists: list[np.ndarray]) -> np.ndarray:
    """Number of shingles that each two of the sets share. Common shingles go through a matrix product, others through their short postings."""
    n = len(lists)
    row = np.repeat(np.arange(n), [len(x) for x in lists])
    _, column, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    out = np.zeros((n, n), np.float32)
    common = np.flatnonzero(times >= 16)
    step = max(1, 8_000_000 // n)
    place = np.full(len(times), -1)
    for at in range(0, len(common), step):
        place[:] = -1
        place[common[at : at + step]] = np.arange(len(common[at : at + step]))
        use = place[column] >= 0
        dense = np.zeros((n, len(common[at : at + step])), np.float32)
        dense[row[use], place[column[use]]] = 1
        out += dense @ dense.T
    rare = (times[column] > 1) & (times[column] < 16)
    order = np.argsort(column[rare], kind="stable")
    row, column = row[rare][order], column[rare][order]
    for gap in range(1, 16):  # members of a posting that stand so far apart in it
        same = column[gap:] == column[:-gap]
        np.add.at(out, (row[:-gap][same], row[gap:][same]), 1)
        np.add.at(out, (row[gap:][same], row[:-gap][same]), 1)
    return out


def collisions(signs: np.ndarray, least: int, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of rows that are apart and agree in least coordinates.

    Coordinates are taken from the one with the fewest collisions on. A pair that agrees in none of the first COORDINATES - least + 1 can't reach least; the collisions of the others
    are counted on, and a pair is skipped once what is left can't bring it to least.
    """
    n, prefix = len(signs), COORDINATES - least + 1
    lengths = [np.unique(signs[:, k], return_counts=True)[1] for k in range(COORDINATES)]
    order = np.argsort([(x.astype(np.int64) ** 2).sum() for x in lengths], kind="stable")
    count = np.zeros((n, n), np.uint8)
    for k in order[:prefix]:
        count += signs[:, k][:, None] == signs[:, k][None, :]
    i, j = np.nonzero(np.triu(count > 0, 1) & apart)
    have = count[i, j].astype(np.int64)
    for done, k in enumerate(order[prefix:], prefix):
        keep = have + (COORDINATES - done) >= least
        if not keep.all():
            i, j, have = i[keep], j[keep], have[keep]
        have += signs[i, k] == signs[j, k]
    keep = have >= least
    return i[keep], j[keep]


def linked(lists: list[np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs of whole sets are alike enough. Many pairs are counted together, few each by itself."""
    size = np.array([len(x) for x in lists], np.int64)
    if len(i) > 4 * len(lists):
        shared = shared_counts(lists)[i, j].astype(np.int64)
    else:
        shared = np.array([len(np.intersect1d(lists[a], lists[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    return 100 * shared >= percent * (size[i] + size[j] - shared)


def links_within(families: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs of components (a, b) with a link between them, from the nodes of a family (hub, node) that are in different ones.

    Families of one component are done. Others are dealt into chunks of about CHUNK shingles and CHUNK_NODES nodes, and each two chunks are one group: a group counts the collisions of
    its nodes' coordinates, compares the whole sets of pairs that collide often enough, and
    returns each pair of components once, so that candidate pairs are never rows.
    """
    placed = families.join(labels, "node").join(nodes.select("node", "n", "rep"), "node")
    sized = placed.groupBy("hub").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.greatest(F.ceil(F.sum("n") / CHUNK), F.ceil(F.count("*") / CHUNK_NODES)).cast("int").alias("chunks"))
    # written out, so that a hub with very many nodes isn't held together by the sums above when its nodes are joined to them
    open_ = stored(sized.where("low < high").select("hub", "chunks"), "near-hubs")
    left = stored(placed.join(open_, "hub"), "near-open")
    full = full_sets(stored(left.select("node", "rep").distinct(), "near-open-ids"), docs, words)
    own = F.pmod(F.xxhash64("node", "hub"), F.col("chunks")).cast("int")
    tiles = left.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = tiles.select("hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "comp").join(full, "node")

    def run(group: pa.Table) -> pa.Table:
        coded = group["comp"].combine_chunks().dictionary_encode()
        comp, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        found = []
        if len(names) > 1:
            signs = np.stack([x.values.to_numpy() for x in group["signature"]])
            a, b = collisions(signs, matches(percent), comp[:, None] != comp[None, :])
            lists = [np.asarray(x.values.to_numpy()) for x in group["shingles"]]
            use = linked(lists, a, b, percent) if len(a) else np.zeros(0, bool)
            found = sorted({tuple(sorted((names[x], names[y]))) for x, y in zip(comp[a[use]], comp[b[use]], strict=True)})
        return pa.table([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], ["a", "b"])

    return tiles.groupBy("hub", "i", "j").applyInArrow(run, "a binary, b binary").distinct()


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (node, comp) after the edges (a, b) between components are joined in: comp becomes the least one that edges reach.

    A round works on the components that edges touch. It takes the least neighbour and then follows it to its own; every round is written out.
    """
    cross = stored(edges.where("a <> b").select(F.col("a").alias("ca"), F.col("b").alias("cb")).distinct(), "near-cross")
    if cross.isEmpty():
        return labels
    both = stored(cross.unionByName(cross.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"))).distinct(), "near-both")
    own = both.select(F.col("ca").alias("c")).distinct().withColumn("to", F.col("c"))
    while True:
        near = both.join(own.withColumnRenamed("c", "cb"), "cb").groupBy(F.col("ca").alias("c")).agg(F.min("to").alias("least"))
        hooked = own.join(near, "c").select("c", "to", F.least("to", "least").alias("next"))
        hooked = stored(hooked, "near-hooked")
        jumped = hooked.join(hooked.select(F.col("c").alias("next"), F.col("next").alias("far")), "next").select("c", "to", F.least("next", "far").alias("now"))
        jumped = stored(jumped, "near-jumped")
        changed = jumped.where("`to` <> now").limit(1).count()
        own = jumped.select("c", F.col("now").alias("to"))
        if not changed:
            break
    moved = own.withColumnRenamed("c", "comp")
    return stored(labels.join(moved, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "near-labels")


def labelled(own: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of sets(), their nodes, and labels (node, comp) once all links are found, for docs (key, text)."""
    rows = stored(sets(own, words), "near-sets")
    some = rows.where("node IS NOT NULL")
    reps = some.groupBy("node").agg(F.min("key").alias("rep"), F.count("*").alias("n_copies"))
    nodes = stored(some.dropDuplicates(["node"]).select("node", "n", "signature").join(reps, "node"), "near-nodes")
    posted = stored(postings(nodes, matches(percent)), "near-postings")
    hubs = posted.groupBy("token").agg(F.max(F.struct("central", "node"))["node"].alias("hub"))
    families = stored(posted.join(hubs, "token").select("hub", "node").distinct(), "near-families")
    labels = nodes.select("node", F.col("node").alias("comp"))  # every node is a component
    paired = families.where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    labels = components(confirmed(stored(agreeing(paired, nodes, percent), "near-agreeing"), own, nodes, words, percent), labels)
    return rows, nodes, components(links_within(families, labels, nodes, own, words, percent), labels)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component of link(): that with the least key (nulls last), then the least hash of its text.

    Of rows with equal keys and texts one stays, also where they have no shingle; other rows without one all stay.
    """
    rows, _, labels = labelled(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), words, percent)
    row = F.struct(F.col("key").isNull().alias("none"), "key", "digest")
    first = rows.where("node IS NOT NULL").join(labels, "node").groupBy("comp").agg(F.min(row).alias("__row")).select("__row")
    wanted = first.unionByName(rows.where("node IS NULL").select(row.alias("__row")).distinct())
    # nulls inside of structs are equal; the window finds the rows as the join dealt them
    at, place = free("__row", docs.columns), free("__place", docs.columns)
    own = docs.withColumn(at, F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(text).alias("digest")))
    equal = Window.partitionBy(at).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    return own.join(wanted.withColumnRenamed("__row", at), at, "left_semi").withColumn(place, F.row_number().over(equal)).where(f"{place} = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id, kept and n_copies (rows with the same set) of every row.

    Rows whose sets of distinct shingles share percent of a hundred of their union are linked; component_id is the least key
    that links reach, kept says whether the row has it. Equal sets are one node from the start. Other candidates come from the
    prefix postings: every node of a posting is held against its hub, the most central node of it; then all nodes that share
    a hub and are still in different components against each other, in groups of bounded size that return joined components
    only. So a group of many near copies isn't expanded into rows of pairs, and every candidate pair is either tested or joined
    already. Null or empty text: no shingle, no link. Null keys: least only where a component has no other; repeated
    rows are equal sets. Other columns aren't read.
    """
    rows, nodes, labels = labelled(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), words, percent)
    least = nodes.join(labels, "node").groupBy("comp").agg(F.min("rep").alias("component"))
    named = nodes.select("node", "n_copies").join(labels, "node").join(least, "comp").select("node", "n_copies", "component")
    out = rows.select("key", "node", "n").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("component"))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))

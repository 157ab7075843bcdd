"""Trie of conversations by their turns: most-significant-first radix partitioning into buckets until they are local, which multikey quicksort finishes."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkrow.llm._common import partitions, slices, stored

#: Turns of a bucket up to which one task sorts it.
LOCAL_ROWS = 1000
#: A conversation takes up to HEADS - 1 turns from the first of each FAMILY of ids.
FAMILY, HEADS = 5, 9
#: Big buckets up to so many are broadcast (some 60 bytes each); more of them are shuffled.
MOST_BROADCAST = 200_000
#: Ids that are joined into one text before digests are taken.
CHUNK = 10_000
NODES = "conv long, depth long, parent long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean"


def dictionary(turns: DataFrame) -> DataFrame:
    """digest and id of every distinct turn; the ids are stored, so that they stay."""
    return stored(turns.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()), "trie-dictionary")


def numbered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, seq (from 1, in order of turn, role and text), digest of role and text, bytes of the text and cum, the bytes of the conversation's turns up to this one.

    Numbers and sums are taken in two steps, so that a conversation of any size is spread: within ranges of conversation and turn, then over the few conversations that border on ranges.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(blank(role)).cast("string"), F.lit(":"), blank(role), blank(text)).cast("binary"))
    own = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"), digest.alias("digest")).where("conv IS NOT NULL")
    order = ["conv", "turn", "role", "text"]
    dealt = own.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches):
        current, seq, at = None, 0, 0
        for batch in slices(batches):
            seqs, sums = [], []
            for c, size in zip(batch.column("conv").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                if c != current:
                    current, seq, at = c, 0, 0
                seq, at = seq + 1, at + size
                seqs.append(seq)
                sums.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seqs, pa.int64()), pa.array(sums, pa.int64())], [*batch.schema.names, "seq", "cum"])

    slim = dealt.select("conv", "part", "digest", F.octet_length("text").cast("long").alias("bytes"))
    rows = stored(slim.mapInArrow(run, "conv long, part int, digest string, bytes long, seq long, cum long"), "trie-turns")
    ends = rows.groupBy("part").agg(F.min("conv").alias("low"), F.max("conv").alias("high")).select("part", F.explode(F.array("low", "high")).alias("conv")).distinct()
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # two conversations a range
    sums = rows.join(F.broadcast(ends), ["part", "conv"]).groupBy("conv", "part").agg(F.max("seq").alias("n"), F.max("cum").alias("b"))
    more = sums.select("conv", "part", F.sum("n").over(before).alias("n0"), F.sum("b").over(before).alias("b0")).where("n0 IS NOT NULL")
    joined = rows.join(F.broadcast(more), ["conv", "part"], "left")
    return joined.select("conv", "digest", "bytes", (F.col("seq") + F.coalesce("n0", F.lit(0))).alias("seq"), (F.col("cum") + F.coalesce("b0", F.lit(0))).alias("cum"))


def rebuilt(rows: DataFrame) -> DataFrame:
    """conv, seq, id, bytes, cum and len of the rebuilt conversations of rows (conv, seq, id, bytes, cum): the first h turns of conversation conv - conv % FAMILY, then the own turns after the first h,
    h being crc32(conv as text) % HEADS. Each has a row 0 without a turn beside. Remainders have the sign of conv."""
    n = HEADS - 1
    head = F.array_sort(F.collect_list(F.when(F.col("seq") <= n, F.struct("seq", "id", "bytes", "cum"))))  # n turns at most
    convs = stored(rows.groupBy("conv").agg(F.max("seq").alias("n"), head.alias("head")), "trie-heads")
    base = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"), F.col("head").alias("base_head"))
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEADS))
    own = convs.withColumns({"h": h, "base": F.col("conv") - F.col("conv") % FAMILY}).join(base, "base", "left")
    taken, left = F.least("h", F.coalesce("base_n", F.lit(0))), F.least("h", "n")
    cum = lambda of, at: F.when(at > 0, F.element_at(of, F.greatest(at, F.lit(1)).cast("int"))["cum"]).otherwise(0)
    own = own.select("conv", "h", "base_head", taken.alias("taken"), (taken - F.col("h")).alias("shift"), (cum(F.col("base_head"), taken) - cum(F.col("head"), left)).alias("more"), (taken + F.col("n") - left).alias("len"))
    none = F.array(F.struct(F.lit(0).cast("long").alias("seq"), F.lit(-1).cast("long").alias("id"), F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("cum")))
    front = F.concat(none, F.coalesce(F.slice("base_head", F.lit(1), F.col("taken").cast("int")), F.slice(none, 1, 0)))
    first = own.select("conv", "len", F.inline(front)).select("conv", "seq", "id", "bytes", "cum", "len")
    rest = rows.join(own, "conv").where("seq > h").select("conv", (F.col("seq") + F.col("shift")).alias("seq"), "id", "bytes", (F.col("cum") + F.col("more")).alias("cum"), "len")
    return first.unionByName(rest)


def small(table: DataFrame) -> DataFrame:
    """table, broadcast if it has few rows by count."""
    return F.broadcast(table) if table.count() <= MOST_BROADCAST else table


def digests(ends: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ends_sha256: the digest of the ids (conv) in numerical order, joined by commas.

    Ids are joined into texts by ranges first, so that the one task that must run over a hot key's digest reads a row for CHUNK ids.
    """
    dealt = ends.repartitionByRange(partitions(ends.sparkSession), *keys, "conv").sortWithinPartitions(*keys, "conv")

    def chunks(batches):
        key, held = None, []

        def row():
            return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])], [*keys, "first", "ids"])

        for batch in slices(batches):
            for *k, c in zip(*(batch.column(x).to_pylist() for x in (*keys, "conv")), strict=True):
                if k != key or len(held) == CHUNK:
                    if held:
                        yield row()
                    key, held = k, []
                held.append(c)
        if held:
            yield row()

    def whole(batches):
        key, state = None, None

        def row():
            return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([state.hexdigest()])], [*keys, "ends_sha256"])

        for batch in slices(batches):
            for *k, ids in zip(*(batch.column(x).to_pylist() for x in (*keys, "ids")), strict=True):
                if k != key:
                    if key is not None:
                        yield row()
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if key is not None:
            yield row()

    typed = ", ".join(f"{k} long" for k in keys)
    packed = dealt.select(*keys, "conv").mapInArrow(chunks, f"{typed}, first long, ids string")
    return packed.repartition(partitions(ends.sparkSession), *keys).sortWithinPartitions(*keys, "first").mapInArrow(whole, f"{typed}, ends_sha256 string")


def quicksorted(members: list[tuple[int, list[int], list[int]]], top: int, parent: int | None) -> list[list]:
    """Nodes (conv, depth, parent, n_convs, n_children, n_leaves, saved_tokens, ids that end here, top) of members (conv, ids and bytes of the turns from depth top on), which share their turn at top.

    Multikey quicksort: members are parted by their turn at a depth into less than, equal to and more than a pivot's; the equal ones are a node and are parted on by the next turn. Nodes follow their parents.
    """
    nodes: list[list] = []
    todo = [(sorted(members), top, -1)]
    while todo:
        held, depth, over = todo.pop()
        at = depth - top
        ended = [m[0] for m in held if len(m[1]) == at]
        if ended:
            nodes[over][7] = ended  # in order of their ids, as held is
            held = [m for m in held if len(m[1]) > at]
        if not held:
            continue
        pivot = held[len(held) // 2][1][at]
        parts: tuple[list, list, list] = ([], [], [])
        for m in held:
            parts[(m[1][at] >= pivot) + (m[1][at] > pivot)].append(m)
        for other in (parts[0], parts[2]):
            if other:
                todo.append((other, depth, over))
        same = parts[1]
        if over >= 0:
            nodes[over][4] += 1
        nodes.append([same[0][0], depth, nodes[over][0] if over >= 0 else parent, len(same), 0, 0, (len(same) - 1) * same[0][2][at], [], over < 0, over])
        todo.append((same, depth + 1, len(nodes) - 1))
    for node in reversed(nodes):
        node[5] = node[5] or 1
        if node[9] >= 0:
            nodes[node[9]][5] += node[5]
            nodes[node[9]][6] += node[6]
    return nodes


def finished(rows: DataFrame) -> DataFrame:
    """NODES of local buckets: rows (kid, top, parent, conv, seq, id, bytes), a bucket being (kid, top)."""
    dealt = rows.repartition(partitions(rows.sparkSession), "kid", "top").sortWithinPartitions("kid", "top", "conv", "seq")
    kinds = [*[pa.int64()] * 7, pa.string(), pa.bool_()]
    names = [part.split()[0] for part in NODES.split(", ")]

    def run(batches):
        key, members, parent = None, [], None  # LOCAL_ROWS turns at most
        out: list[list] = []

        def table():
            columns = list(zip(*out, strict=True))
            columns[7] = [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() for e in columns[7]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:9], kinds, strict=True)], names)

        for batch in slices(batches):
            for *k, p, conv, turn, size in zip(*(batch.column(c).to_pylist() for c in ("kid", "top", "parent", "conv", "id", "bytes")), strict=True):
                if k != key:
                    if members:
                        out += quicksorted(members, key[1], parent)
                    key, members, parent = k, [], p
                    if len(out) >= LOCAL_ROWS:
                        yield table()
                        out = []
                if not members or members[-1][0] != conv:
                    members.append((conv, [], []))
                members[-1][1].append(turn)
                members[-1][2].append(size)
        if members:
            out += quicksorted(members, key[1], parent)
        if out:
            yield table()

    return dealt.select("kid", "top", "parent", "conv", "id", "bytes").mapInArrow(run, NODES)


def trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", local_rows: int = LOCAL_ROWS) -> DataFrame:
    """A row a node of the trie of the rebuilt conversations: conv_id (the smallest member), depth, parent_conv_id (the parent's; null at the root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Turns stand in order of turn (null first), then role and text; a null role or text is empty, rows that repeat are turns of their own, rows without a conversation are none. An empty table has no node.

    Buckets are sets of conversations that share their first turns; the first holds all. A bucket's members go together down to the depth at which one ends or two differ: so many nodes have one child, and
    their numbers follow from the bucket's size and the prefix sums of bytes of its smallest member. Below, members are dealt by their next turn's id into new buckets. Buckets of up to local_rows turns are
    finished by one task each; the others are dealt again, so that a first turn or a conversation that a third of all share takes a few rounds, not one task.
    """
    coded = numbered(turns, conv, turn, role, text)
    coded = coded.join(dictionary(coded), "digest").drop("digest")
    active = rebuilt(coded).withColumns({"kid": F.lit(None).cast("long"), "top": F.lit(0).cast("long"), "parent": F.lit(None).cast("long")})
    active = stored(active, "trie-rows")
    active = active.withColumn("kid", F.lit(active.agg(F.min("conv")).first()[0]).cast("long"))
    rounds, local = [], []
    while True:
        # size and depth of each bucket's common part, first by depth, so that no bucket meets in one task
        deep = active.groupBy("kid", "top", "seq").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"), F.min("len").alias("least"), F.min("parent").alias("parent"))
        fork = F.min(F.when(F.col("low") != F.col("high"), F.col("seq")))
        shape = deep.groupBy("kid", "top").agg(F.max("n").alias("m"), F.least(F.min("least"), F.coalesce(fork - 1, F.min("least"))).alias("last"), F.min("parent").alias("over"))
        shape = stored(shape, "trie-shape")
        if shape.isEmpty():
            break
        placed = active.join(small(shape), ["kid", "top"])
        chain = stored(placed.where("conv = kid AND seq <= last").select("kid", "top", "over", "m", "last", "seq", "bytes", "cum"), "trie-chain")
        ends = placed.where("seq = last AND len = last").select("kid", F.col("last").alias("depth"), "conv")
        below = placed.where("seq > last").select("kid", "top", "last", "conv", "seq", "id", "bytes", "cum", "len")
        forks = below.where(F.col("seq") == F.col("last") + 1)
        kids = forks.groupBy("kid", "top", "id").agg(F.min("conv").alias("new"), F.sum(F.col("len") - F.col("last")).alias("rows"), F.min("seq").alias("at"))
        kids = stored(kids, "trie-kids")
        dealt = forks.select("kid", "top", "id", "conv").join(small(kids), ["kid", "top", "id"]).select("conv", "new", F.col("kid").alias("parent"), "at", "rows")
        rows = stored(below.drop("top", "last").join(dealt, "conv").select(F.col("new").alias("kid"), F.col("at").alias("top"), "parent", "conv", "seq", "id", "bytes", "cum", "len", "rows"), "trie-rows")
        local.append(rows.where(F.col("rows") <= local_rows))
        active = rows.where(F.col("rows") > local_rows).drop("rows")
        rounds.append((chain, kids, stored(digests(ends, ["kid", "depth"]), "trie-ends")))
    if not rounds:
        return turns.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    nodes = finished(_union(local))
    nodes = stored(nodes, "trie-nodes")
    totals = nodes.where("top").select(F.col("conv").alias("new"), F.col("depth").alias("at"), "n_leaves", "saved_tokens")
    upper = []
    # leaves and bytes are added up from the last round's buckets to the first's
    for chain, kids, ends in reversed(rounds):
        sums = kids.join(totals, ["new", "at"]).groupBy("kid", "top").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))
        foot = chain.where("seq = last").select("kid", "top", F.col("cum").alias("foot"))
        own = chain.join(small(foot.join(sums, ["kid", "top"], "left")), ["kid", "top"])
        saved = F.coalesce("below", F.lit(0)) + (F.col("m") - 1) * (F.col("foot") - F.col("cum") + F.col("bytes"))
        is_last = F.col("seq") == F.col("last")
        none = F.sha2(F.lit("").cast("binary"), 256)
        made = own.join(ends.withColumnsRenamed({"kid": "of", "depth": "at"}), (F.col("kid") == F.col("of")) & (F.col("seq") == F.col("at")), "left").select(
            F.col("kid").alias("conv"), F.col("seq").alias("depth"), F.when(F.col("seq") == F.col("top"), F.col("over")).otherwise(F.col("kid")).alias("parent"), F.col("m").alias("n_convs"),
            F.when(is_last, F.coalesce("n_children", F.lit(0))).otherwise(1).cast("long").alias("n_children"), F.coalesce("leaves", F.lit(1)).alias("n_leaves"), saved.alias("saved_tokens"),
            F.coalesce("ends_sha256", none).alias("ends_sha256"), (F.col("seq") == F.col("top")).alias("top"),
        )
        made = stored(made, "trie-upper")
        upper.append(made)
        totals = totals.unionByName(made.where("top").select(F.col("conv").alias("new"), F.col("depth").alias("at"), "n_leaves", "saved_tokens"))
    every = _union([nodes, *upper])
    return every.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

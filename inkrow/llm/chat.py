"""Chat formatting: budgeted windows of whole turns with repeated, masked history."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkrow.llm._common import partitions, slices, stored

#: Tokens a window may hold, and how many of them may repeat earlier turns. A token stands for CHARS characters.
BUDGET, HISTORY, CHARS = 4096, 512, 4
#: Fixed values of the template: a turn is HEAD, role, MIDDLE, text, END; an escape sign stands before each of these characters inside roles and texts.
HEAD, MIDDLE, END, ESCAPED = "### ", ": ", " </turn>\n", "\\#<:"
TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<:]|\\.)*) </turn>\n", re.S)
UNESCAPE = re.compile(r"\\(.)", re.S)
ESCAPE = re.compile(r"[\\#<:]")
#: Budgets of tokens in a stretch of a conversation; stretches are cut into windows apart from each other.
STRETCH = 64
#: First characters of a text that deal and order the rows of one turn.
HEAD_CHARS = 32
WINDOW_SCHEMA = "conv string, window long, text string, n_system long, n_history long, loss array<struct<start:long,length:long>>"


def escape(text: str) -> str:
    return ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def numbered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, role, body, tokens, seq and start (the tokens before it) of every turn, in order of turn, role and text in its conversation.

    The prefix sums are taken in two steps, so that a conversation of any size is spread: rows are dealt by ranges of conversation and
    turn and summed up within each range; only where a conversation runs over several ranges the sums of those before are added, one row a range.
    """
    own = turns.select(F.col(conv).cast("string").alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("body"))
    own = own.withColumn("begin", F.left("body", F.lit(HEAD_CHARS)))
    order = ["conv", "turn", "role", "begin"]
    dealt = own.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order, "body").withColumn("part", F.spark_partition_id())

    def run(batches):
        current, seq, at, started = None, 0, 0, False
        for batch in slices(batches):
            convs, roles, bodies = (batch.column(c).to_pylist() for c in ("conv", "role", "body"))
            seqs, starts, sizes = [], [], []
            for c, r, b in zip(convs, roles, bodies, strict=True):
                if not started or c != current:
                    current, seq, at, started = c, 0, 0, True
                size = -(-len(piece(r, b)) // CHARS)
                seqs.append(seq)
                starts.append(at)
                sizes.append(size)
                seq, at = seq + 1, at + size
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("part"), batch.column("role"), batch.column("body"), *(pa.array(x, pa.int64()) for x in (seqs, starts, sizes))], ["conv", "part", "role", "body", "seq", "start", "tokens"])

    rows = stored(dealt.select("conv", "part", "role", "body").mapInArrow(run, "conv string, part int, role string, body string, seq long, start long, tokens long"), "chat-turns")
    sums = rows.groupBy("conv", "part").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    # each border between ranges parts one conversation at most, so that these are at most twice as many as ranges
    ends = rows.groupBy("part").agg(F.min(F.struct(F.col("conv").isNotNull(), "conv"))["conv"].alias("low"), F.max(F.struct(F.col("conv").isNotNull(), "conv"))["conv"].alias("high"))
    edges = ends.select(F.explode(F.array("low", "high")).alias("c"), "part").distinct()
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    some = sums.alias("s").join(F.broadcast(edges).alias("e"), F.col("s.conv").eqNullSafe(F.col("e.c")) & (F.col("s.part") == F.col("e.part"))).select("s.*")
    more = some.withColumns({"n0": F.sum("n").over(before), "t0": F.sum("t").over(before)}).where("n0 IS NOT NULL").select(F.col("conv").alias("conv_"), F.col("part").alias("part_"), "n0", "t0")
    joined = rows.join(F.broadcast(more), F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("part") == F.col("part_")), "left")
    return joined.select("conv", "role", "body", "tokens", (F.col("seq") + F.coalesce("n0", F.lit(0))).alias("seq"), (F.col("start") + F.coalesce("t0", F.lit(0))).alias("start"))


def piece(role: str, body: str) -> str:
    return f"{HEAD}{escape(role)}{MIDDLE}{escape(body)}{END}"


def spans(start: list[int], tokens: list[int], first: int, system: int, budget: int, history: int) -> list[tuple[int, int, int]]:
    """(first turn of the history, first turn of the span, end of the span) of each window, greedily, by the turns' prefix sums.

    Turns before first only serve as history. system is the size of the system turn, 0 without any; where it has the whole budget or more, windows are cut as if there were none.
    """
    out, at, upto = [], first, [a + n for a, n in zip(start, tokens, strict=True)]
    while at < len(start):
        repeated = system if start[at] > 0 else 0  # the window of the system turn itself holds it among its turns
        free = budget - repeated if repeated < budget else budget
        behind = max(0, min(history, free // 2, free - tokens[at]))
        low = bisect_left(start, start[at] - behind, 0, at)
        if system and low < at and start[low] == 0:  # the system turn isn't history
            low += 1
        end = max(at + 1, bisect_right(upto, start[low] + free, at))
        out.append((low, at, end))
        at = end
    return out


def windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Formatted windows: conv, window (ascends in a conversation), text, n_system, n_history (turns at the start of text that repeat) and loss.

    Turns stand in order of turn, then role and text; nulls come first, a null role or text is empty, null conversations are one. Prefix
    sums of the turns' tokens cut each conversation greedily into spans of whole turns: a window takes as many turns as fit in budget beside what it repeats, so that
    only a single turn that doesn't fit by itself exceeds it, and no turn is cut or dropped. A leading system turn is repeated at the
    start of each later window, then as many whole turns just before the span's first as fit in history tokens, in half of what the system turn
    leaves, and in what the span's first turn leaves. A system turn of the whole budget or more leaves nothing: all later windows exceed it, and are cut as if there were none.
    Every STRETCH budgets of a conversation a new span begins, so that the stretches of a long one are cut by different tasks. loss has
    (start, length) in characters of the escaped texts of the assistant turns of the span itself; repeated ones are masked.
    Rows that repeat stay turns of their own.
    """
    room = STRETCH * budget
    rows = numbered(turns, conv, turn, role, text).withColumn("stretch", F.floor(F.col("start") / room).cast("long"))
    spark = turns.sparkSession
    # a turn that starts just before a stretch may be history there; a long conversation's system turn goes to each of its stretches
    ahead = rows.where(F.col("start") >= (F.col("stretch") + 1) * room - history).withColumn("stretch", F.col("stretch") + 1)
    last = rows.where("stretch > 0").groupBy("conv").agg(F.max("stretch").alias("last")).withColumnRenamed("conv", "c")
    top = rows.where((F.col("seq") == 0) & (F.lower("role") == "system"))
    more = top.join(last, F.col("conv").eqNullSafe(F.col("c"))).withColumn("stretch", F.explode(F.sequence(F.lit(1), F.col("last")))).drop("c", "last")
    every = rows.withColumn("part", F.lit(2)).unionByName(ahead.withColumn("part", F.lit(1))).unionByName(more.withColumn("part", F.lit(0)))
    dealt = every.repartition(partitions(spark), "conv", "stretch").sortWithinPartitions("conv", "stretch", "part", "seq")

    def formatted(held: list[dict]):
        system = next((r for r in held if r["seq"] == 0 and r["role"].lower() == "system"), None)
        own = [r for r in held if r["part"] > 0]
        first = next((i for i, r in enumerate(own) if r["part"] == 2), len(own))
        cut = spans([r["start"] for r in own], [r["tokens"] for r in own], first, system["tokens"] if system else 0, budget, history)
        for number, (low, at, end) in enumerate(cut):
            top = [system] * bool(system and own[at]["start"] > 0)
            out, loss, size = [], [], 0
            for k, r in enumerate([*top, *own[low:end]]):
                said = piece(r["role"], r["body"])
                if k >= len(top) + at - low and r["role"].lower() == "assistant":
                    loss.append({"start": size + len(HEAD) + len(escape(r["role"])) + len(MIDDLE), "length": len(escape(r["body"]))})
                out.append(said)
                size += len(said)
            yield (own[at]["conv"], own[at]["stretch"] << 32 | number, "".join(out), len(top), at - low, loss)

    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))]

    def run(batches):
        held: list[dict] = []  # the rows of one stretch: its tokens and one long turn at most

        def done():
            for w in formatted(held):
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(w, kinds, strict=True)], ["conv", "window", "text", "n_system", "n_history", "loss"])

        for batch in slices(batches):
            for r in batch.to_pylist():
                if held and (r["conv"], r["stretch"]) != (held[0]["conv"], held[0]["stretch"]):
                    yield from done()
                    held = []
                held.append(r)
        if held:
            yield from done()

    return dealt.mapInArrow(run, WINDOW_SCHEMA)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window; text that isn't one fails."""
    out, at = [], 0
    while at < len(text):
        if not (found := TURN.match(text, at)):
            raise ValueError("not a formatted window")
        out.append((unescape(found[1]), unescape(found[2])))
        at = found.end()
    return out


def read_back(formatted: DataFrame, conv: str = "conv_id", kind: str = "bigint") -> DataFrame:
    """Digests of each conversation read from its windows: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A conversation's windows stream through one task in order; digests are carried along, so that no conversation is held.
    """
    schema = "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        state, current, started = None, None, False

        def row():
            return (current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        def table(rows):
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            out = []
            for w in batch.to_pylist():
                if not started or w["conv"] != current:
                    if started:
                        out.append(row())
                    state, current, started = [0, hashlib.sha256(), 0, hashlib.sha256(), 0], w["conv"], True
                for role, text in parse(w["text"])[w["n_system"] + w["n_history"] :]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in w["loss"]:
                    text = unescape(w["text"][span["start"] : span["start"] + span["length"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(w["text"])
            if out:
                yield table(out)
        if started:
            yield table([row()])

    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = formatted.repartition(n, "conv").sortWithinPartitions("conv", "window")
    out = ordered.mapInArrow(run, schema)
    return out.select(F.col("conv").cast(kind).alias(conv), *[c for c in out.columns if c != "conv"])

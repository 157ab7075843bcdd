"""Sharding, filter audit and prefix trie against brute force: nulls, empty and long texts, ties, repeated rows, hot groups, empty tables and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from inkrow.llm import filter_audit, prefix_trie, sharding


def frame(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("aa b cc ddd EE f".split()) for _ in range(rng.randint(0, 60))), f"s{i % 7}") for i in range(400)]
    rows += [(1000 + i, "the same text of many rows", "hot") for i in range(250)]
    rows += [(2000, None, None), (2001, "", ""), (2002, None, "s1"), (None, "the same text of many rows", "hot"), (None, "alone", "s2"), (None, "alone", "s2"), (2003, "x" * 9000 + " ñ日😀", "s3"), (3, rows[3][1], "s3"), (3, rows[3][1], "s3")]
    return spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], "doc_id long, text string, source string, shard string, slot int, mask string").repartition(6)


def test_shards_are_near_equal_and_gapless(spark):
    docs = frame(spark)
    got = sharding.assign(docs, shards=6).collect()
    said = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == said
    full, slots = Counter(), defaultdict(list)
    for r in got:
        full[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(full.values()) / 6
    assert sorted(full) == list(range(6)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    # one row alone exceeds a shard's bytes, the others share the rest
    others = sorted(full.values())[:-1]
    assert max(full.values()) == 9000 + 1 + 2 + 3 + 4 + 8 and max(others) - min(others) < 0.03 * mean
    groups = defaultdict(set)
    for r in got:
        groups[r["text_crc32"]].add(r["shard"])
    hot = zlib.crc32(b"the same text of many rows")
    assert all(len(s) == 1 for k, s in groups.items() if k != hot) and len(groups[hot]) > 1
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    again = sharding.assign(docs.repartition(3), shards=6).collect()
    key = lambda r: (str(r["doc_id"]), r["text_crc32"], r["shard"])
    assert [key(r) for r in sorted(got, key=key) if r["doc_id"] not in (None, 3)] == [key(r) for r in sorted(again, key=key) if r["doc_id"] not in (None, 3)]
    assert sharding.assign(docs.limit(0)).count() == 0 and sharding.assign(docs.limit(1)).first()["slot"] == 0


def test_shards_are_written(spark, tmp_path):
    docs = frame(spark)
    path = f"file://{tmp_path}/shards"
    name = sharding.write(docs, path, shards=5)
    back = spark.read.parquet(path)
    assert name == "_shard" and back.select(docs.columns).exceptAll(docs).count() == 0 == docs.exceptAll(back.select(docs.columns)).count()
    assert back.groupBy(name).agg(F.count("*").alias("n"), F.max("_slot").alias("m")).where("n <> m + 1").count() == 0


def test_cuts_part_groups_and_rows():
    low, high = "a" * 32 + "/1", "c" * 32 + "/9"
    sample = [("a" * 32 + f"/{i}", 1.0) for i in range(3)] + [("b" * 32 + "/1", 0.2), ("c" * 32 + "/2", 0.9)]
    assert sharding.new_cuts(sample, low, high) == ["a" * 32 + "~", "c" * 32]
    assert sharding.new_cuts([], low, high) == ["a" * 32 + "~"]
    assert sharding.new_cuts(sample[:3], "a" * 32 + "/0", "a" * 32 + "/2") == ["a" * 32 + "/1", "a" * 32 + "/2"]
    assert sharding.new_cuts([], low, low) == [] and sharding.new_cuts([], "a/1", "a/2") == ["a/2"]


def audited(docs, labels):
    """All rows of the audit, by applying every order to every row."""
    said = [(r["doc_id"], r["text"] or "", r["source"] or "") for r in docs]
    ids = defaultdict(list)
    for i, t, _ in said:
        if i is not None:
            ids[t].append(i)
    marks = defaultdict(lambda: [False, False])
    for i, q, x in labels:
        if i is not None:
            marks[i][0] |= q == 1
            marks[i][1] |= x == 1
    fails = []
    for i, t, part in said:
        words = [w for w in t.translate(dict.fromkeys([32, *range(9, 14)], " ")).split(" ") if w]
        own = {c for c, bad in zip("ABCD", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t)), strict=True) if bad}
        if any(i is None or k < i for k in ids[t]):
            own.add("E")
        fails.append((part, own, *(marks[i] if i is not None else (False, False))))
    out = {}
    for part in {f[0] for f in fails}:
        rows = [f for f in fails if f[0] == part]
        shapley = {c: sum(next((x for x in order if x in own), None) == c for order in permutations("ABCDE") for _, own, *_ in rows) for c in "ABCDE"}
        for order in permutations("ABCDE"):
            for step, c in enumerate(order):
                gone = set(order[:step])
                removed = [r for r in rows if c in r[1] and not gone & r[1]]
                out[part, "".join(order), step + 1] = (sum(not (gone | {c}) & r[1] for r in rows), len(removed), sum(c in r[1] and bool(gone & r[1]) for r in rows), sum(r[1] == {c} for r in rows), sum(r[2] for r in removed), sum(r[3] for r in removed), shapley[c])
    return out


def test_audit_equals_every_order(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["a", "b", f"w{rng.randrange(400)}", f"v{rng.randrange(400)}"][: rng.choice([2, 4])]) for _ in range(rng.choice([5, 250]))) + rng.choice(["", "", " $", " " + "Q" * 60, "\x1fq"]), rng.choice(["x", "y", None, ""])) for i in range(60)]
    rows += [(100 + i, rows[i % 5][1], "x") for i in range(20)] + [(200, None, "x"), (201, "", "y"), (202, None, None), (None, rows[0][1], "y"), (None, "new", "y"), (None, "new", "y"), (3, rows[3][1], "y"), (300, "z " * 5000, "x"), (301, "a b " * 210, "z")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 120, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, source string, mask string, n int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, marks).collect()
    want = audited(docs.collect(), labels)
    assert len(got) == len(want) == 120 * 5 * 4
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == want
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    none = {(r["part"], r["filter_order"], r["step"]): (r["good_lost"], r["toxic_lost"]) for r in filter_audit.audit(docs, marks.limit(0)).collect()}
    assert set(none.values()) == {(0, 0)}


@pytest.mark.parametrize("seed", [1, 2])
def test_parity_sums_invert(spark, seed):
    rng = random.Random(seed)
    counts = [rng.choice([0, 0, 1, 5, 70]) for _ in range(32)]
    rows = spark.createDataFrame([("p", m, m % 2 == 0, False) for m, n in enumerate(counts) for _ in range(n)], "part string, mask int, good boolean, toxic boolean")
    out = filter_audit.parity_sums(rows).select(filter_audit.cells(F.col("every")).alias("every"), filter_audit.cells(F.col("good")).alias("good"), filter_audit.cells(F.col("toxic")).alias("toxic")).first()
    assert out["every"] == counts and out["good"] == [n if m % 2 == 0 else 0 for m, n in enumerate(counts)] and out["toxic"] == [0] * 32


def brute_trie(turns):
    convs = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [v[2:] for v in sorted(rows)] for c, rows in convs.items()}
    members, sizes = defaultdict(list), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole = own.get(c - c % 5, [])[:h] + own[c][h:]
        sizes[c] = len(whole)
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return {(min(m), len(p)): (min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(m) if sizes[c] == len(p)).encode()).hexdigest()) for p, m in members.items()}


@pytest.mark.parametrize("local_rows", [1, 6, 1000])
def test_trie_equals_brute_force(spark, local_rows):
    rng = random.Random(7)
    turns = [(c, k, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "ccc"])) for c in range(60) for k in range(rng.randint(1, 6))]
    turns += [(c, k, "user", f"hot {k}") for c in range(100, 160) for k in range(12)]  # many equal conversations
    turns += [(200, k, "user", "long " * 50) for k in range(300)] + [(203, k, "user", "long " * 50) for k in range(299)]  # long ones that differ at the end
    turns += [(301, None, None, None), (301, 0, None, ""), (301, 1, "", None), (302, 5, "x", "tie"), (302, 5, "x", "tie"), (302, 5, "w", "tie"), (None, 1, "user", "no conversation"), (777, 0, "system", "y" * 20000)]
    df = spark.createDataFrame([(*t, "clash", 1) for t in turns], "conv_id long, turn long, role string, text string, depth string, id int").repartition(5)
    got = prefix_trie.trie(df, local_rows=local_rows).collect()
    assert {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in got} == brute_trie(turns) and len(got) == len(brute_trie(turns))
    if local_rows == 6:
        assert prefix_trie.trie(df.limit(0)).count() == 0


def test_quicksort_of_one_member():
    assert [n[:8] for n in prefix_trie.quicksorted([(4, [9, 8], [1, 2])], 3, 1)] == [[4, 3, 1, 1, 1, 1, 0, []], [4, 4, 4, 1, 0, 1, 0, [4]]]

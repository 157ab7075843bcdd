import difflib
import random

import pytest
from pyspark.sql import functions as F

from inkrow.functions import jamo, likeness
from inkrow.operators import classify, decide


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize(("most", "letters"), [(1, False), (2, False), (1, True), (2, True)])
def test_nearest_equals_all_pairs(spark, most, letters):
    rng = random.Random(most)
    signs = "가각간나낙다단라" if letters else "abcd"
    names = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 6))) for _ in range(120)]
    said = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 7))) for _ in range(150)] + names[:10] + [""]
    pairs = lambda values: [(rng.choice("xy"), v) for v in values] + [("x", None)]
    words, listed = spark.createDataFrame(pairs(said), "kind string, word string"), spark.createDataFrame(pairs(names), "kind string, candidate string")
    spelt = {r["w"]: r["j"] for r in spark.createDataFrame([(w,) for w in {*names, *said}], "w string").select("w", jamo.jamo(F.col("w")).alias("j")).collect()} if letters else {w: w for w in {*names, *said}}
    want = {}
    own = {(r["kind"], r["candidate"]) for r in listed.collect() if r["candidate"] is not None}
    for r in words.collect():
        if r["word"] is not None:
            scores = [(distance(spelt[r["word"]], spelt[c]), c) for k, c in own if k == r["kind"] and abs(len(c) - len(r["word"])) <= 1]
            best = [c for d, c in scores if d == min(scores)[0] and d <= most]
            want[r["kind"], r["word"]] = best[0] if len(best) == 1 else None
    got = decide.nearest(words, listed, most, within=["kind"], letters=letters).collect()
    assert {(r["kind"], r["word"]): r["found"] for r in got} == want and len(got) == len(want)


def test_large_dictionaries_meet_few_pairs(spark):
    sign = lambda k: F.substring(F.md5(F.concat(F.lit(f"{k}:"), "id").cast("binary")), 1, 8)
    names = spark.range(20_000).select("id", sign(1).alias("candidate"))
    words = names.select("id", F.concat(F.left("candidate", F.lit(3)), F.lit("z"), F.substring("candidate", 5, 4)).alias("word"))
    keyed = lambda df, c: df.select(F.explode(decide.deletions(F.col(c), 1)).alias("key"))
    joined = keyed(words, "word").join(keyed(names, "candidate"), "key").count()
    assert 20_000 <= joined < 0.01 * 20_000 * 20_000
    got = decide.nearest(words, names, 1).join(words, "word").join(names, "id")
    assert got.where("found = candidate").count() > 19_900 and got.where("found <> candidate").count() == 0


def test_likeness_equals_matching_blocks():
    rng = random.Random(9)
    first, second = (["".join(rng.choice("abc가나") for _ in range(rng.randint(0, 12))) for _ in range(3000)] for _ in range(2))
    assert [float(x) for x in likeness.ratios(first, second)] == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(first, second, strict=True)]
    assert likeness.ratios([], []).tolist() == []


def test_closed_lists_of_many_names(spark):
    rng = random.Random(10)
    names = sorted({"".join(rng.choice("가나다라마바사서울부산경찰청장") for _ in range(rng.randint(4, 9))) for _ in range(10_000)})
    said = []
    for name in rng.sample(names, 60):
        letters = list(name)
        letters[rng.randrange(len(letters))] = rng.choice("가힣나")
        said.append("".join(letters))
    said += ["", "없는이름입니다요", names[5], names[5][:2] + "　" + names[5][2:]]
    got = {r["t"]: r["s"] for r in spark.createDataFrame([(t,) for t in [*said, None]], "t string").select("t", classify.snap_to_list(F.col("t"), names).alias("s")).collect()}
    for t in said:
        bare = t.replace("　", "")
        scores = [difflib.SequenceMatcher(None, bare, n).ratio() for n in names]
        best = names[scores.index(max(scores))]
        assert tuple(got[t]) == ((best, best != bare) if max(scores) >= 0.75 else (t, False))
    assert tuple(got[None]) == (None, False)

"""Lists of many shards, labels of one key, columns of any name, long texts in stretches, and words of several scripts."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkrow.llm import decontaminate, fingerprint, language, near_duplicates, quality, urls


def fitting(rules, host, path):
    found = [(len(h + p), len(h), -i, h + p, v) for i, (v, h, p) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(found)[3:] if found else (None, "allow")


@pytest.mark.parametrize(("most_bytes", "frame"), [(64 << 20, False), (64 << 20, True), (0, False)])
def test_lists_of_many_shards(spark, monkeypatch, most_bytes, frame):
    monkeypatch.setattr(urls, "MOST_BYTES", most_bytes)
    monkeypatch.setattr(urls, "GROUP_ROWS", 40)
    rng = random.Random(11)
    rules = [(rng.choice(["allow", "block"]), f"{rng.choice('abc')}{k}.org" if k % 3 else f"h{k % 40}.com", f"/{rng.choice('xyz')}" * (k % 3)) for k in range(300)]
    said = [f"http://{rng.choice(['', 'www.', 'a.b.'])}{h}{p}{rng.choice(['', '/', '/q?x'])}" for _, h, p in rng.sample(rules, 150)] + ["http://h1.com/x/y", "none", None, "http://h1.com/x/y"]
    pages = spark.createDataFrame([(i if i != 7 else None, u) for i, u in enumerate(said)], "page_id long, url string").repartition(5)
    given = spark.createDataFrame([(*r, i) for i, r in enumerate(rules)], "verdict string, host string, path string, place int") if frame else rules
    got = urls.judge(pages, given, shard_keys=50).collect()
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == Counter((r["page_id"], r["host"], r["path"], *fitting(rules, r["host"], r["path"])) for r in got) and len(got) == len(said)
    assert sum(r["rule"] is not None for r in got) > 100


def test_labels_of_one_key_leave_the_sample(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["good", "fine", "text"] if i % 2 else ["bad", "poor", "text"]) for _ in range(30))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    many = labels.unionByName(spark.range(200_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    one, other = quality.train(docs, labels, train_rows=300), quality.train(docs, many, train_rows=300)
    assert (one.weights != 0).any() and np.array_equal(one.weights, other.weights) and np.array_equal(one.thresholds, other.thresholds)


def test_stages_keep_columns_of_any_name(spark):
    import corpus_pipeline

    rng = random.Random(13)
    text = lambda i: " ".join(rng.choice("the of and der die und w1 w2 w3".split()) + str(rng.randrange(30)) for _ in range(40)) if i % 4 else "the same text of many words that " * 5
    rows = [(i, text(i), "en", "s", f"score {i}", f"accepted {i}", i, f"row {i}", "p", "b", "t", "l") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string, accepted string, expected_grade int, __row string, __place string, __bad string, __text string, lang_pred string")
    want = {r["doc_id"]: tuple(r) for r in docs.collect()}
    near, clean = near_duplicates.one_of_each(docs), decontaminate.clean(docs, spark.createDataFrame([(1, "the same text of many words that")], "item_id long, text string"))
    assert near.columns == clean.columns == docs.columns and all(want[r["doc_id"]] == tuple(r) for r in near.collect() + clean.collect())
    assert near.where("doc_id % 4 = 0").count() == 1 and clean.where("doc_id % 4 = 0").count() == 0 and clean.count() == 45
    model = language.train(docs)
    kept = language.identify(corpus_pipeline.packed(docs), model).where("score >= 0.5").select("doc.*")
    scored = quality.score(corpus_pipeline.packed(docs), None).where("accepted").select("doc.*")
    assert kept.columns == scored.columns == docs.columns and {tuple(r) for r in scored.collect()} == set(want.values())


def test_stretches_of_long_texts_give_the_same_features(monkeypatch):
    rng = random.Random(14)
    words = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(n)).encode() for n in (40, 900)] + [b"ab" * 900, bytes(rng.randrange(256) for _ in range(4000)), b"x" * 700]
    whole = fingerprint.features(texts)
    for piece in (64, 257, 1000):
        monkeypatch.setattr(fingerprint, "PIECE", piece)
        assert all(np.array_equal(a, b) for a, b in zip(whole, fingerprint.features(texts), strict=True))


def test_features_dont_depend_on_neighbours():
    texts = [b"x" * 400, b"x" * 400, b"ab" * 300, b"ab" * 300 + b"x" * 40, b"x" * 40, b"", b"x", b"x", "wort für wort ".encode() * 9, "wort für wort ".encode() * 9]
    assert all(np.array_equal(a, fingerprint.features([t])[0]) for a, t in zip(fingerprint.features(texts), texts, strict=True))


def test_words_part_where_scripts_change(spark):
    assert language.parts_of("naïve-ab1cd") == ["naïve", "ab", "cd"] and language.parts_of("日本語textカナ") == ["日本語", "text", "カナ"] and language.parts_of("½³") == [] and language.parts_of("हिन्दी") == ["हनद"]
    rng = random.Random(15)
    english = "the of and to in that was he for it with as his on be at by had not are".split()
    chinese = ["我们在这里", "他说不是", "今天天气好", "可以看到的"]
    rows = [(" ".join(rng.choice(english) for _ in range(30)), "en") for _ in range(30)] + [("，".join(rng.choice(chinese) for _ in range(12)), "zh") for _ in range(30)]
    model = language.train(spark.createDataFrame(rows, "text string, lang string"))
    mixed = "，".join(chinese * 3) + "/".join(english * 2)
    got = language.identify(spark.createDataFrame([(1, mixed), (2, "/".join(english))], "doc_id long, text string"), model, spans=True).orderBy("doc_id").collect()
    assert [s["lang"] for s in got[0]["spans"]] == ["zh", "en"] and 0.4 < got[0]["score"] < 1 and {(s["first"], s["last"]) for s in got[0]["spans"]} == {(0, 0)}
    assert (got[1]["lang_pred"], got[1]["score"], got[1]["n_spans"]) == ("en", 1.0, 1)


def test_next_documents_equal_brute_force(spark):
    rng = random.Random(16)
    rows = [(rng.choice([None, 1, *range(2, 60)]), rng.choice(["", "some text of words and more of it", "other words of a text, and so on", "x" * 400])) for _ in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    dealt = fingerprint.with_next(docs, "doc_id", "text", rows_a_bucket=7, few_buckets=6)
    n = dealt.where("head = 0").count()
    assert n == 80 and Counter(map(tuple, dealt.where("head = 0").select("key", "text").collect())) == Counter(rows)
    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
    want = Counter()
    for (k, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        want[k, round(fingerprint.likeness(fingerprint.digest(t.encode()), fingerprint.digest(u.encode())), 9)] += 1
    got = Counter((r["doc_id"], round(r["near_next"], 9)) for r in fingerprint.fingerprints(docs).collect())
    assert got == want


def test_pairs_of_a_language_model_are_made_once_and_sorted_with_their_places(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    from inkrow.llm import pitman_yor

    values = np.array([5, 0, 7, 5, 0], np.int64)
    for below in (8, 1 << 62):  # sorted with places in one word, or not
        for got, want in zip(pitman_yor.placed(values, below), np.unique(values, return_inverse=True), strict=True):
            assert (got == want).all()
    assert [len(x) for x in pitman_yor.placed(values[:0], 8)] == [0, 0]
    seen, own = [], pitman_yor.sent
    monkeypatch.setattr(pitman_yor, "sent", lambda pairs, *rest: seen.append(pairs) or own(pairs, *rest))
    docs = spark.createDataFrame([(1, " a b a "), (2, "b a"), (3, None)], "doc_id long, text string")
    assert pitman_yor.score(docs, F.lit(True)).count() == 3
    assert "MapInArrow" not in seen[0]._jdf.queryExecution().executedPlan().toString()

"""Whole queries against plain versions of them, very long texts, empty tables, and a pipeline in which every stage decides something."""

import base64
import hashlib
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from inkrow.llm import decontaminate, filter_audit, language, near_duplicates, warc

EN = "the of and to in that was he for it with as his on be at by had not are from this have but all were".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden".split()


def best_path(scores, switch):
    """Viterbi over one text, step by step: stay where that is as good, then the first language."""
    value, back = scores[0].copy(), []
    for row in scores[1:]:
        best = int(np.argmax(value))
        moved = value[best] - np.float32(switch)
        back.append([k if value[k] >= moved else best for k in range(len(row))])
        value = np.maximum(value, moved) + row
    path = [int(np.argmax(value))]
    for steps in reversed(back):
        path.append(steps[path[-1]])
    return path[::-1]


def test_languages_equal_a_plain_version(spark):
    rng = random.Random(21)
    say = lambda words, n: " ".join(rng.choice(words) + rng.choice(["", ",", "."]) for _ in range(n))
    model = language.train(spark.createDataFrame([(say(EN, 40), "en") for _ in range(20)] + [(say(DE, 40), "de") for _ in range(20)], "text string, lang string"))
    texts = [say(EN, 30) + " " + say(DE, 40), say(DE, 3) + "/" + say(EN, 3), "", None, "12 !", say(EN, 20_000) + say(DE, 20_001), "für", *(say(rng.choice([EN, DE]), rng.randint(1, 60)) for _ in range(40))]
    want = []
    for text in texts:
        words = ["".join(c for c in w if not unicodedata.category(c).startswith("M")) for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
        if not words:
            want.append(("und", 0.0, 0))
            continue
        letters, path = Counter(), best_path(model.scores(words), language.SWITCH)
        for w, k in zip(words, path, strict=True):
            letters[k] += len(w)
        most = min(letters, key=lambda k: (-letters[k], k))
        want.append((model.langs[most], letters[most] / sum(letters.values()), 1 + sum(a != b for a, b in zip(path, path[1:]))))
    model.fresh()
    got = language.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), model).orderBy("doc_id").collect()
    assert [(r["lang_pred"], pytest.approx(r["score"]), r["n_spans"]) for r in got] == want


def test_archives_equal_a_plain_version(spark):
    rng = random.Random(22)
    bodies = [None, "", "x", "ü" * 9, "<html>\r\n\r\n</html>", "long " * 600_000, *(f"page {k}" for k in range(12))]
    rows = [(k, f"http://h/{k}", rng.choice(bodies)) for k in rng.sample(range(-50, 500), 150)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string").repartition(6)
    for least in (0, 5):
        first = {}
        for k, _, html in sorted(rows):
            first.setdefault((html or "").encode(), k)
        want = set()
        for k, _, html in rows:
            body = (html or "").encode()
            again = len(body) >= least and first[body] != k
            want.add((k, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first[body] if again else None))
        got = warc.round_trip(pages, least_bytes=least).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert len(got) == len(rows) and set(map(tuple, got)) == want


def test_audit_of_very_long_texts(spark):
    long_ = spark.range(1).select(F.expr("repeat('A', 22000000)").alias("t"), F.expr("repeat('a ', 300000)").alias("u"))
    assert tuple(long_.select(filter_audit.text_failures(F.col("t")), filter_audit.text_failures(F.col("u"))).first()) == (1 + 4, 2)


def test_windows_and_ids_of_many_bytes_are_shuffled(spark, monkeypatch):
    rng = random.Random(23)
    word = lambda: f"w{rng.randrange(40)}" + "x" * rng.choice([1, 1, 900])
    rows = [(f"key {i}", " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(60)]
    rows += [(f"copy {i}", f"{t} more") for i, (_, t) in enumerate(rows[:30])]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    items = spark.createDataFrame([(i, " ".join(rows[i][1].split()[3:20])) for i in range(20)], "item_id long, text string")
    run = lambda: (Counter(map(tuple, decontaminate.overlap(docs, items).collect())), Counter(map(tuple, near_duplicates.link(docs).collect())))
    small = run()
    monkeypatch.setattr(decontaminate, "MOST_BYTES", 100)
    monkeypatch.setattr(near_duplicates, "MOST_BYTES", 100)
    assert run() == small and sum(r[-1] for r in small[0]) > 10 and sum(not r[3] for r in small[1]) > 10


def test_links_of_very_long_texts(spark):
    rng = random.Random(24)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60_000)]
    near = [f"x{k}" if k % 200 == 0 else w for k, w in enumerate(base)]
    other = [f"y{k}" if k % 10 == 0 else w for k, w in enumerate(base)]
    rows = [(5, base), (7, near), (8, other), (9, base), (4, base[:100]), (3, ["z" * 500_000]), (2, ["z" * 500_000])]
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in rows}
    low = {k: min(j for j in sets if 100 * len(sets[j] & sets[k]) >= 85 * len(sets[j] | sets[k])) for k in sets}
    assert low == {5: 5, 7: 5, 8: 8, 9: 5, 4: 4, 3: 2, 2: 2}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.link(docs, percent=85).collect()} == {k: (len(sets[k]), low[k]) for k in sets}


def tables(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


@pytest.mark.parametrize(("docs", "items"), [([], []), ([], [(1, "a b c")]), ([(1, "the of and", "en", "s"), (None, None, None, None), (2, "", None, "s")], [])])
def test_stages_of_empty_tables(spark, tmp_path, docs, items):
    import corpus_pipeline

    tables(spark, str(tmp_path), docs, [], items)
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, held, str(tmp_path)).columns == held.columns
        assert stage(spark, held.limit(0), str(tmp_path)).count() == 0
    assert [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [d[0] for d in docs if d[1]]


def test_every_stage_of_the_pipeline_decides(spark, tmp_path):
    import corpus_pipeline
    import tiktoken

    rng = random.Random(25)
    marks = {"toxic": [f"vile{k}" for k in "abcdefgh"], "low": [f"spam{k}" for k in "abcdefgh"]}
    passage = [f"item{k}" for k in "abcdefghijkl"]

    def prose(kind, words):
        own = [rng.choice(words) + str(rng.randrange(400)) for _ in range(50)] + [rng.choice(words) for _ in range(70)]
        own += [rng.choice(marks[kind]) for _ in range(25)] if kind in marks else [f"clear{rng.choice('abcdefgh')}" for _ in range(25)]
        rng.shuffle(own)
        return own

    rows, labels, kept, fate = [], [], {}, defaultdict(int)
    for k in range(360):
        kind, lang = ["good", "toxic", "good", "low", "good"][k % 5], "de" if k % 3 == 0 else "en"
        text = prose(kind, DE if lang == "de" else EN)
        hit, copied = kind == "good" and k % 20 == 2, kind == "good" and k % 20 == 4
        if hit:
            text[40:40] = passage
        said = " ".join(text)
        rows.append((k, said, lang, "s"))
        if k % 2:
            labels.append((k, int(kind == "good"), int(kind == "toxic")))
        if copied:  # a near copy with a larger id
            rows.append((k + 1000, said + " last", lang, "s"))
        fate["hit" if hit else kind] += 1
        if kind == "good" and not hit:
            kept[k] = said
    rows += [(5000 + k, f"{k} !! 12 34", "en", "s") for k in range(5)]  # no letter
    tables(spark, str(tmp_path), rows, labels, [(1, " ".join(passage))])
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}, special_tokens={})
    assert min(fate.values()) > 10
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {k: len(own.encode_ordinary(t)) for k, t in kept.items()}

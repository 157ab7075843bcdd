"""Each operator against brute force on small fixtures with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkrow.llm import bpe, chat, decontaminate, fingerprint, language, near_duplicates, pitman_yor, quality, urls, warc

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = {"en": "the of and to in that was he for it with as his on be at by had not are".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()}


def prose(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", ",", "."]) for _ in range(n))


def docs(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, "de" if i % 3 == 0 else "en", rng.randint(1, 80)), "de" if i % 3 == 0 else "en") for i in range(120)]
    base = [f"w{k}" for k in range(60)]
    for i in range(200, 212):  # near copies that differ in one place each
        words = list(base)
        words[(i - 200) * 5] = f"x{i}"
        rows.append((i, " ".join(words), "en"))
    rows += [(300, None, "en"), (301, "", None), (302, " \n\t", "en"), (303, "!!! 123", "en"), (304, rows[5][1], "en"), (304, rows[5][1], "en"), (None, "the of and", "en"), (305, "wort " * 4000, "de"), (306, "日本語 text ñ \U0001f600", "en")]
    return spark.createDataFrame([(*r, "src", "clash") for r in rows], "doc_id long, text string, lang string, source string, ids string").repartition(5)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_bpe_equals_tiktoken(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.codec(PATH, PATTERN)
    rng = random.Random(2)
    texts = ["", "a" * 3000, "ab" * 700, " " * 500, "naïve façade\u00a0x", "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(2000)), "the theology of 12345 don't"]
    assert codec.encode(texts) == [own.encode_ordinary(t) for t in texts]
    frame = docs(spark)
    got = bpe.decode(bpe.encode(frame, PATH, PATTERN), PATH, PATTERN)
    assert got.where(F.col("bytes") != F.coalesce("text", F.lit("")).cast("binary")).count() == 0 and got.count() == frame.count()
    for r in rows_of(bpe.digests(frame, PATH, PATTERN).join(frame.select("doc_id", "text").distinct(), "doc_id")):
        ids = own.encode_ordinary(r["text"] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert bpe.digests(frame.limit(0), PATH, PATTERN).count() == 0


def test_language(spark):
    frame = docs(spark)
    model = language.train(frame.where("doc_id % 2 = 0 AND doc_id < 120"))
    got = rows_of(language.identify(frame, model, spans=True))
    assert len(got) == frame.count() and {r["lang_pred"] for r in got if r["doc_id"] in (300, 301, 302, 303)} == {"und"}
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 120 and r["doc_id"] % 2 and len(r["text"].split()) > 3]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    rng = random.Random(3)
    mixed = spark.createDataFrame([(1, prose(rng, "en", 30) + " " + prose(rng, "de", 30))], "doc_id long, text string")
    spans = language.identify(mixed, model, spans=True).first()["spans"]
    assert [s["lang"] for s in spans] == ["en", "de"] and spans[0]["first"] == 0 and abs(spans[0]["last"] - 29) <= 2 and spans[-1]["last"] == 59
    odd = spark.createDataFrame([(1, "½ ² ① ⅷ 3"), (2, "½ der ② und")], "doc_id long, text string").withColumns({"lang_pred": F.lit("clash"), "score": F.lit("clash")})
    assert [(r["lang_pred"], r["score"], r["n_spans"]) for r in language.identify(odd, model).orderBy("doc_id").collect()] == [("und", 0.0, 0), ("de", 1.0, 1)]
    assert language.train(frame.limit(0)) is None and language.identify(frame, None).where("lang_pred <> 'und'").count() == 0


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(4)
    import itertools

    scores = rng.normal(size=(5, 1, 3)).astype(np.float32) * 3
    value = lambda p: sum(scores[t, 0, s] for t, s in enumerate(p)) - 2 * sum(a != b for a, b in zip(p, p[1:], strict=False))
    assert value(language.viterbi(scores, 2.0)[:, 0].tolist()) == pytest.approx(max(map(value, itertools.product(range(3), repeat=5))), abs=1e-4)


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(3, "http://a/ é", "x" * 50), (1, None, "x" * 50), (2, "u", None), (4, "u", "ü\r\n\r\n"), (None, "u", "x" * 50), (5, "v", ""), (4, "u", "ü\r\n\r\n")], "page_id long, url string, html string")
    got = rows_of(warc.round_trip(pages))
    assert len(got) == 7
    by = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got}
    assert by == {(3, "revisit", 1, 50), (1, "response", None, 50), (2, "response", None, 0), (4, "response", None, 6), (None, "revisit", 1, 50), (5, "revisit", 2, 0)}
    assert {r["payload_digest"] for r in got if r["page_id"] == 4} == {base64.b32encode(hashlib.sha1("ü\r\n\r\n".encode()).digest()).decode()}
    index = warc.write(pages)
    assert [bytes(r["block"]) for r in warc.lookup(index, spark.createDataFrame([(1,)], "key long")).collect()] == [b"x" * 50]
    assert warc.round_trip(pages.limit(0)).count() == 0 and all(r["record_type"] == "response" for r in rows_of(warc.round_trip(pages, least_bytes=100)))


def test_warc_records_follow_the_standard(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x" * 50), (2, "http://b/", "x" * 50), (None, None, "y")], "page_id long, url string, html string").withColumns({"payload": F.lit("clash"), "key": F.lit("clash"), "sha1": F.lit(1)})
    index = rows_of(warc.write(pages.coalesce(1)))
    raw = {}
    for r in index:
        fs, where = warc.filesystem(r["path"])
        file = fs.open_input_file(where)
        start, n = warc.read_seek_table(file, file.size())[r["frame"]]
        file.seek(start)
        plain = warc.zstandard.ZstdDecompressor().decompress(file.read(n))
        assert warc.parse(plain[: plain.index(b"\r\n\r\nWARC/1.1") + 4])[0]["WARC-Type"] == "warcinfo"
        raw[r["key"]] = warc.parse(plain[r["offset"] : r["offset"] + r["length"]])
    (first, block), (again, empty), (nameless, _) = raw["1"], raw["2"], raw[None]
    assert first["WARC-Type"] == "response" and block.startswith(b"HTTP/1.1 200 OK\r\n") and warc.payload_of(block) == b"x" * 50
    assert again["WARC-Type"] == "revisit" and again["WARC-Refers-To"] == first["WARC-Record-ID"] and warc.payload_of(empty) == b"" and "X-Key" not in nameless
    assert {r["page_id"] for r in rows_of(warc.round_trip(pages))} == {1, 2, None}


def brute_overlap(texts, items):
    split = lambda t: [w for w in __import__("re").split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    wins = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            wins.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    out = []
    for d, t in texts:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[x]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    long_ = " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 3)) for _ in range(40))
    items = [(1, long_), (2, "Zwei Wörter"), (3, "solo"), (4, None), (5, "..."), (11, long_), (None, "three short words")]
    texts = [(1, "x " + long_ + " y " + long_), (2, " ".join(long_.split()[5:20])), (3, "ZWEI, wörter! solo"), (4, None), (5, ""), (None, "solo"), (6, "clean text here"), (6, "clean text here"), (7, "three short words")]
    texts += [(k, " ".join(rng.choice(long_.split()) for _ in range(60))) for k in range(20, 40)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").withColumn("words", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(tuple(r) for r in decontaminate.overlap(frame, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    assert got == brute_overlap(texts, items)
    assert decontaminate.overlap(frame, bench.limit(0)).where("contaminated").count() == 0 and decontaminate.overlap(frame.limit(0), bench).count() == 0
    assert {r["doc_id"] for r in decontaminate.clean(frame, bench).collect()} >= {4, 5, 6}
    very_long = spark.createDataFrame([(1, "w " * 300_000 + long_)], "doc_id long, text string")
    assert [tuple(r)[1:4] for r in decontaminate.overlap(very_long, bench).collect()] == [(300_040, 40, 2)]


def test_decontamination_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 0)
    test_decontamination_equals_brute_force(spark)


def test_clean_decides_by_row(spark):
    rows = [(None, "x solo y"), (None, "clean"), (7, "solo"), (7, "other text")]
    kept = decontaminate.clean(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, "solo")], "item_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([(None, "clean"), (7, "other text")])


def test_quality(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        kind = i % 3
        text = prose(rng, "en", 40)
        rows.append((i, text + (" vile nasty" if kind == 0 else " %%% it%%% x%%%" if kind == 1 else "")))
        labels.append((i, 0 if kind == 1 else 1, int(kind == 0)))
    rows += [(900, None), (901, ""), (None, "the of")]
    frame, graded = spark.createDataFrame(rows, "doc_id long, text string").withColumn("accepted", F.lit("clash")), spark.createDataFrame([*labels, (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    model = quality.train(frame, graded.where("doc_id % 2 = 0 OR doc_id IS NULL"))
    got = {r["doc_id"]: r for r in rows_of(quality.score(frame, model))}
    assert len(got) == 603 and not got[900]["accepted"] and model.thresholds[0] < model.thresholds[1]
    assert sum(got[i]["accepted"] == (i % 3 == 2) for i in range(1, 600, 2)) >= 290
    assert np.mean([got[i]["expected_grade"] for i in range(0, 600, 3)]) < np.mean([got[i]["expected_grade"] for i in range(1, 600, 3)]) < np.mean([got[i]["expected_grade"] for i in range(2, 600, 3)])
    assert quality.train(frame, graded.limit(0)) is None and quality.score(frame, None).where("accepted").count() == 601


def test_quality_equals_brute_force(spark):
    """Scores from the formula, text by text; the fit against its own likelihood at other weights and thresholds."""
    import xxhash

    rng = random.Random(16)
    rows = [(i, prose(rng, "en", rng.randint(1, 30)) + [" vile nasty", " %%% it%%%", " Fine NASA 7"][i % 3]) for i in range(90)] + [(None, "the of"), (901, ""), (902, None), (903, " \n"), (904, "vile " * 30_000), (1, "the vile"), (1, "the vile")]
    model = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 != 1), int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int"))

    def bucket(name):
        return int(quality.mix64(np.array([xxhash.xxh64_intdigest(name.encode())], np.uint64))[0]) & (quality.BUCKETS - 1)

    def want(text):
        words = (text or "").split()
        eta = 0.0
        for kind in ("w", "v", "t", "s"):
            count = Counter()
            for w in words:
                tail = quality.TAIL.search(w)
                tail = tail[0] if tail else ""
                bare = quality.BODY.sub("", w).lower()
                count[bucket({"w": "w" + bare, "v": "v" + bare, "t": "t" + tail, "s": "s" + quality.shape(w[: len(w) - len(tail)]) + tail}[kind])] += 1
            eta += sum(model.weights[b] * 4 * math.log1p(c) / math.log1p(len(words)) for b, c in count.items())
        usable, good = (1 / (1 + math.exp(t - eta)) for t in model.thresholds)
        return usable, good, usable + good, good >= 0.5 and bool(words)

    got = rows_of(quality.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model))
    assert len(got) == len(rows) and (model.weights != 0).any()
    for r in got:
        usable, good, expected, accepted = want(r["text"])
        assert (r["p_usable"], r["p_good"], r["expected_grade"]) == pytest.approx((usable, good, expected), abs=1e-4)
        assert r["accepted"] == accepted or abs(good - 0.5) < 1e-4

    def loss(weights, thresholds):
        total = 0.0
        for i, t in rows[:90]:
            if i == 1:  # this key has several texts, one of which is fitted
                continue
            b, v, _, _ = quality.text_features(pa.array([t]))
            eta = float((weights[b] * v).sum())
            above = [1.0, *(1 / (1 + math.exp(c - eta)) for c in thresholds), 0.0]
            g = 0 if i % 3 == 0 else 1 if i % 3 == 1 else 2
            total -= math.log(max(above[g] - above[g + 1], 1e-12))
        return total / 90

    best = loss(model.weights, model.thresholds)
    assert best < 0.2 < loss(np.zeros(quality.BUCKETS), model.thresholds)


def test_samples_of_very_many_rows_are_not_empty(spark):
    from inkrow.llm._common import highest_hash

    for rows in (4001, 10**6, 7 * 10**9, 10**13):
        assert (highest_hash(4000, rows) + 1) / 2**63 == pytest.approx(4000 / rows)
    assert highest_hash(4000, 4000) == highest_hash(4000, 1) == 2**63 - 1
    # as many rows for each one wanted as 5.5 billion for 5,000
    many = spark.range(1_100_000)
    labelled = many.select(F.concat(F.lit("the of and "), "id").alias("text"), F.lit("en").alias("lang")).unionByName(spark.createDataFrame([("der die das", "de")], "text string, lang string"))
    assert language.train(labelled, train_rows=1).langs == ["de", "en"]
    graded = many.select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") == 5).cast("int").alias("toxic"))
    with pytest.raises(ValueError, match="grades"):
        quality.train(many.select(F.col("id").alias("doc_id"), F.lit("the of").alias("text")), graded, train_rows=1)


def test_pitman_yor(spark):
    frame = docs(spark)
    got = rows_of(pitman_yor.score(frame, F.coalesce(F.col("doc_id") % 4 != 1, F.lit(True))))
    source = rows_of(frame)
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    seen = Counter(w for r in source if r["doc_id"] is None or r["doc_id"] % 4 != 1 for w in tokens(r["text"]))
    n, v = sum(seen.values()), len(seen)
    want = Counter((r["doc_id"], len(tokens(r["text"])), sum(seen[w] > 0 for w in tokens(r["text"])), n, round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens(r["text"])), 6)) for r in source)
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert pitman_yor.score(frame.limit(0), F.lit(True)).count() == 0


def test_pitman_yor_equals_brute_force(spark):
    """No pair repeats and no word follows two others, so that each dish has one table everywhere and nothing is left to chance."""
    texts = [(1, "a b c d"), (2, "e f"), (3, "g"), (4, None), (5, "h i j"), (6, "a x"), (7, "y d")]
    learned = [1, 5]
    got = {r["doc_id"]: r["score"] for r in rows_of(pitman_yor.score(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), F.col("doc_id").isin(learned)))}
    (d, d0), (s, s0) = pitman_yor.DISCOUNT, pitman_yor.STRENGTH
    pairs = [p for i, t in texts if i in learned for w in [["<", *t.split(), ">"]] for p in zip(w, w[1:], strict=False)]
    assert len(set(pairs)) == len(pairs)
    served = Counter(w for _, w in pairs)  # END has a table in two contexts, and its root tables are left to chance
    opened, words = Counter(u for u, _ in pairs), len(served)

    def score(text, ends):
        root_tables = words - 1 + ends
        total = 0.0
        for u, w in (lambda x: zip(x, x[1:], strict=False))(["<", *(text or "").split(), ">"]):
            root = (served[w] - d0 * (ends if w == ">" else served[w] > 0) + (s0 + d0 * root_tables) / (words + 1)) / (s0 + len(pairs))
            total += math.log10((((u, w) in pairs) * (1 - d) + (s + d * opened[u]) * root) / (s + opened[u]))
        return total

    for i, t in texts:
        low, high = sorted(score(t, ends) for ends in (1, 2))
        assert low - 1e-4 <= got[i] <= high + 1e-4


@pytest.mark.parametrize("hot", [4_000_000, 40])
def test_pitman_yor_probabilities_add_up(spark, monkeypatch, hot):
    monkeypatch.setattr(pitman_yor, "HOT", hot)
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(12)]
    texts = [(k, " ".join(rng.choice(vocabulary[: 1 + k % 12]) for _ in range(rng.randint(0, 40))), True) for k in range(60)]
    every = [*vocabulary, "unknown"]
    texts += [(100, "\n".join([""]), False), *((1000 + k, f"{a} {b}", False) for k, (a, b) in enumerate((a, b) for a in every for b in every)), *((2000 + k, a, False) for k, a in enumerate(every))]
    frame = spark.createDataFrame([(k, t, flag) for k, t, flag in texts], "key long, text string, learned boolean")
    blocks = pitman_yor.pack(frame.coalesce(1))
    found = pitman_yor.hot_contexts(blocks, 1)
    assert (len(found[0]) > 0) == (hot == 40)
    sent = spark.sparkContext.broadcast(found)
    pairs = pitman_yor.counted(blocks, sent, 5)
    answers = pitman_yor.rooted(pitman_yor.sent(pairs, sent, 5), 5)
    totals = answers.where("share < 0").agg(F.struct(*(F.sum(c).alias(c) for c in pitman_yor.TOTALS)).alias("totals")).scalar()
    back = rows_of(pitman_yor.answered(pairs, answers.where("share >= 0").select(*pitman_yor.ANSWER, totals.alias("totals")), sent, 5).orderBy("share"))
    block = pitman_yor.Block(rows_of(blocks)[0], found, 5)
    p = 10.0 ** np.concatenate([pitman_yor.spread(r["logs"], np.float32) for r in back])
    per = np.bincount(block.opened, p)
    assert len(per) == len(every) + 2 and np.allclose(np.delete(per, np.flatnonzero(block.words == pitman_yor.END)), 1, atol=1e-4)
    assert {r["tokens"] for r in back} == {sum(len(t.split()) + 1 for _, t, flag in texts if flag)} and {r["words"] for r in back} == {13}


def test_pitman_yor_of_hot_contexts(spark, monkeypatch):
    """Parts of a context count as one: what doesn't depend on chance is the same."""
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score"]
    frame = docs(spark).withColumn("doc_id", F.col("doc_id").cast("string"))
    whole = Counter(tuple(r[c] if c != "base_score" else round(r[c], 6) for c in names) for r in rows_of(pitman_yor.score(frame, F.lit(True))))
    monkeypatch.setattr(pitman_yor, "HOT", 30)
    assert Counter(tuple(r[c] if c != "base_score" else round(r[c], 6) for c in names) for r in rows_of(pitman_yor.score(frame, F.lit(True)))) == whole


def test_seating():
    rng = np.random.default_rng(3)
    customers = np.array([0, 1, 2, 500, 30, 7])
    tables = pitman_yor.seat(customers, np.full(6, 0.1), np.zeros(6, np.int64), np.array([10]), 0.5, 2.0, rng)
    assert (tables <= customers).all() and ((tables > 0) == (customers > 0)).all()


@pytest.mark.parametrize("few", [24, 10**9])
def test_customers_move_one_at_a_time_by_the_exact_law(monkeypatch, few):
    """Numbers of tables are in proportion to generalised Stirling numbers times weight ** tables, which seating all anew from left to right doesn't give."""
    monkeypatch.setattr(pitman_yor, "FEW", few)
    rng, discount, weight, n = np.random.default_rng(5), 0.75, 0.8, 6000
    seats = pitman_yor.Seats(np.full(n, 6))
    for customers in (6, 9, 4):
        seats.resize(np.full(n, customers), weight, discount, rng)
        for _ in range(12):
            seats.sweep(weight, discount, rng)
        ways = {0: 1.0}
        for k in range(customers):
            ways = {t: ways.get(t - 1, 0) + max(k - discount * t, 0) * ways.get(t, 0) for t in range(1, k + 2)}
        law = np.array([ways[t] * weight**t for t in range(1, customers + 1)])
        law /= law.sum()
        seen = np.bincount(seats.tables, minlength=customers + 1)[1:] / n
        assert (np.abs(seen - law) <= 4.5 * np.sqrt(law / n) + 2e-4).all()
        table, size = seats.table.reshape(n, customers), seats.size.reshape(n, customers)
        assert all((np.bincount(t, minlength=customers) == s).all() for t, s in zip(table[:200], size[:200], strict=True))


def test_squeezed_arrays():
    for kind in (np.uint64, np.int64, np.uint32, np.float32):
        values = np.array([0, 1, 127, 300, 2**31 - 1], kind)
        assert pitman_yor.spread(pitman_yor.squeeze(values), kind).tolist() == values.tolist()
    assert len(pitman_yor.spread(pitman_yor.squeeze(np.zeros(0, np.int64)), np.int64)) == 0


def test_chat(spark):
    rng = random.Random(8)
    turns = []
    for c in range(12):
        turns += [(c, t, "system" if t == 0 and c % 2 else ["user", "assistant"][t % 2], prose(rng, "en", rng.randint(1, 60)) + rng.choice(["", " </turn>\n### user: x", "\\", "\\<#:"])) for t in range(rng.randint(1, 40))]
    turns += [(50, None, None, None), (51, 1, "assistant", ""), (52, 1, "user", "same"), (52, 1, "user", "same"), (None, 1, "user", "null"), (53, 0, "user", "long " * 5000)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    formatted = chat.windows(frame, budget=400, history=80)
    many = formatted.where("n_history > 0 AND window > 0")
    assert many.count() > 5 and formatted.where("n_system > 0").count() > 0
    got = {r["conv_id"]: r for r in rows_of(chat.read_back(formatted))}
    by = {}
    for c, t, r, x in sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        said = "".join(x for r, x in own if r == "assistant")
        want = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == want
    assert chat.read_back(chat.windows(frame.limit(0))).count() == 0


def brute_windows(turns, budget, history, room):
    """(texts of the system turn and the history, texts of the span, tokens) of each window of one conversation's turns (role, text without characters to escape), turn by turn."""
    size = [-(-len(f"### {r}: {t} </turn>\n") // 4) for r, t in turns]
    start = [sum(size[:i]) for i in range(len(size))]
    system = size[0] if turns[0][0] == "system" else 0
    out, at = [], 0
    while at < len(turns):
        top = [0] * bool(system and at)
        free = budget - (system if top and system < budget else 0)
        behind, again = min(history, free // 2, free - size[at]), []
        for i in range(at - 1, -1 if not system else 0, -1):
            if sum(size[k] for k in again) + size[i] > behind:
                break
            again.insert(0, i)
        span = [at]
        for i in range(at + 1, len(turns)):
            if start[i] // room != start[at] // room or sum(size[k] for k in again + span) + size[i] > free:
                break
            span.append(i)
        out.append(([turns[i][1] for i in top + again], [turns[i][1] for i in span], sum(size[i] for i in top + again + span), len(span)))
        at = span[-1] + 1
    return out


@pytest.mark.parametrize("stretch", [64, 2])
def test_chat_windows_equal_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(chat, "STRETCH", stretch)
    rng = random.Random(15)
    say = lambda n: " ".join(f"t{rng.randrange(10**4)}" for _ in range(n))
    who = lambda t: ["assistant", "user"][t % 2]
    talks = {c: [("system" if not t and c % 2 else who(t), say(rng.choice([1, 5, 20, 60, 500, 4000]))) for t in range(30)] for c in range(8)}
    talks[20] = [("user", say(60)), ("assistant", "x" * 7000), ("user", "short"), ("assistant", "y" * 16000), ("user", "end")]
    for c, n in ((21, 8000), (22, 14000), (23, 15900), (24, 20000)):  # long system turns
        talks[c] = [("system", "s" * n)] + [(who(t), say(rng.randint(1, 20))) for t in range(60)]
    talks[30] = [("system", "s" * 3000)] + [(who(t), "z" * 720) for t in range(900)]  # one conversation has most of the rows
    rows = [(c, t, r, x) for c, own in talks.items() for t, (r, x) in enumerate(own)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    got, tokens = {}, {}
    for r in chat.windows(frame).orderBy("window").collect():
        pieces = chat.parse(r["text"])
        said, k = [x for _, x in pieces], r["n_system"] + r["n_history"]
        got.setdefault(int(r["conv"]), []).append((said[:k], said[k:]))
        tokens.setdefault(int(r["conv"]), []).append((sum(-(-len(chat.piece(*p)) // 4) for p in pieces), len(said) - k))
        assert [unescaped for s in r["loss"] for unescaped in [chat.unescape(r["text"][s["start"] : s["start"] + s["length"]])]] == [x for role, x in pieces[k:] if role == "assistant"]
    want = {c: brute_windows(own, chat.BUDGET, chat.HISTORY, stretch * chat.BUDGET) for c, own in talks.items()}
    assert got == {c: [w[:2] for w in own] for c, own in want.items()}
    # only a single turn that doesn't fit exceeds the budget, and windows are filled
    over = {c for c, own in talks.items() if own[0][0] == "system" and len(own[0][1]) >= 16000}
    assert 24 in over and all(n <= chat.BUDGET or turns == 1 for c, own in tokens.items() if c not in over for n, turns in own)
    assert np.mean([n for n, _ in tokens[30]]) > 0.9 * chat.BUDGET
    back = {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.windows(frame)).collect()}
    assert back == {c: len(own) for c, own in talks.items()}


def brute_components(rows):
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").encode().lower().split()) else frozenset() for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, len(s), d if not s else least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(9)
    frame = docs(spark)
    base = [f"b{k}" for k in range(100)]
    more = []
    for i in range(400, 460):  # chains whose ends aren't alike
        for k in range(rng.randint(0, 2)):
            base[rng.randrange(100)] = f"c{i}-{k}"
        more.append((i, " ".join(base)))
    frame = frame.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumn("node", F.lit("clash"))
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    got = near_duplicates.link(frame).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert near_duplicates.link(frame.limit(0)).count() == 0


def test_near_duplicates_of_short_boilerplate(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "CHUNK_NODES", 40)  # families in many chunks
    rng = random.Random(19)
    rows = [(k, " ".join([*"a b c d e f g h".split(), *(f"x{rng.randrange(4)}" for _ in range(3))])) for k in range(500)]
    # long near copies of several texts that share a long passage
    passage = [f"p{k}" for k in range(300)]
    for g in range(6):
        own = [f"g{g}-{k}" for k in range(40)]
        rows += [(1000 + 10 * g + c, " ".join(passage + own[:c] + [f"u{g}-{c}"] + own[c:])) for c in range(9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates.link(frame).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows)


def test_collisions_and_recall():
    rng = np.random.default_rng(20)
    signs = rng.integers(0, 3, (60, near_duplicates.COORDINATES)).astype(np.int32)
    apart = rng.random((60, 60)) < 0.8
    apart = apart | apart.T
    i, j = near_duplicates.collisions(signs, 26, apart)
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if apart[a, b] and (signs[a] == signs[b]).sum() >= 26}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and want
    # pairs of sets with a likeness of 0.85 to 0.90: the share that agrees in enough coordinates
    hit = 0
    for k in range(2000):
        n, both = 200, 184 + k % 6  # 184 of 216 is 0.852, 189 of 211 is 0.896
        own = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
        hit += (near_duplicates.signature(np.sort(own[:n])) == near_duplicates.signature(np.sort(own[n - both :]))).sum() >= near_duplicates.matches(85)
    assert hit == 2000


def test_near_copies_at_080_are_one_document_of_the_pipeline(spark):
    import corpus_pipeline

    base = [f"w{k}" for k in range(504)]  # 500 shingles; each changed word far from others costs 5 of them
    changed = {1: [], 2: range(10, 500, 50), 3: range(10, 500, 40)}  # 450 of 550 shared (0.818), and 435 of 565 (0.770)
    rows = [(d, " ".join(f"x{k}" if k in places else w for k, w in enumerate(base))) for d, places in changed.items()]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, frame, "").collect()} == {1, 3}
    assert all(r["kept"] for r in near_duplicates.link(frame).collect())
    assert (near_duplicates.matches(85), near_duplicates.matches(80)) == (38, 33)


def test_shared_counts():
    rng = np.random.default_rng(10)
    lists = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(30)]
    got = near_duplicates.shared_counts(lists)
    assert all(got[a, b] == len(np.intersect1d(lists[a], lists[b])) for a in range(30) for b in range(30) if a != b)


def test_fingerprints(spark):
    frame = docs(spark).withColumn("head", F.lit("clash"))
    got = rows_of(fingerprint.fingerprints(frame))
    import xxhash

    place = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), seed=42)) - (h >> 63 << 64)
    source = sorted(((r["doc_id"], r["text"] or "") for r in frame.collect()), key=lambda x: (x[0] is not None, x[0] or 0, place(x[1])))
    want = Counter()
    for k, (d, t) in enumerate(source):
        following, q = source[(k + 1) % len(source)][1], len(t) // 4
        want[d, len(t), hashlib.sha256((t[: len(t) - q] + following[:q]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next"))
    text = prose(random.Random(11), "en", 900).encode()
    chain = fingerprint.digest(text)
    assert fingerprint.likeness(chain, chain) == 1 and fingerprint.likeness(chain, fingerprint.digest(text[:-800] + prose(random.Random(12), "de", 130).encode())) > 0.5
    assert fingerprint.decode(fingerprint.encode(chain)).tolist() == chain.tolist()
    for r in got:
        own, edited = fingerprint.decode(r["fingerprint"]), fingerprint.decode(r["edited_fingerprint"])
        assert r["near_edited"] == pytest.approx(brute_likeness(own, edited), abs=1e-5)
    # small buckets, a key with a third of the rows and another with as many nulls
    rows = [(k if k % 3 else None if k % 2 else 7, f"text {k} " * (1 + k % 4)) for k in range(600)]
    many = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    source = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, place(x[1])))
    want = Counter((d, t, source[(k + 1) % 600][1]) for k, (d, t) in enumerate(source))
    for cast in ("long", "string"):
        seen, last = Counter(), None
        dealt = fingerprint.with_next(many.withColumn("doc_id", F.col("doc_id").cast(cast)), "doc_id", "text", 40).select("key", "text", "head", F.spark_partition_id().alias("p")).collect()
        for x, y in zip(dealt, dealt[1:], strict=False):
            if x["p"] == y["p"] and not x["head"]:
                seen[None if x["key"] is None else int(x["key"]), x["text"], y["text"]] += 1
        assert cast == "string" or seen == want
        assert sum(seen.values()) == 600
    assert fingerprint.fingerprints(frame.limit(0)).count() == 0


def test_fingerprints_of_texts_without_spaces():
    rng = random.Random(16)
    like = lambda a, b: fingerprint.likeness(fingerprint.digest(a), fingerprint.digest(b))
    for letters in ("".join(map(chr, range(0x4E00, 0x5200))), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
        text = lambda n: "".join(rng.choice(letters) for _ in range(n)).encode()  # noqa: B023, E731
        own, other, n = text(3000), text(3000), 300
        n *= len(own) // 3000
        size = len(own)
        assert like(own[:n] + other[n:], own) < 0.5 and like(own, other) < 0.1  # the same beginning alone
        for at in (0, size // 2, size - n):  # start, middle and end changed
            assert 0.7 < like(own, own[:at] + other[at : at + n] + own[at + n :]) < 1
    spaced = b" ".join([own[:1000], own[1000:2000], own[2000:]])
    assert like(spaced, own) > 0.7 and like(spaced, b" ".join([own[:40] + other[40:1000], own[1000:1040] + other[1040:2000], own[2000:2040] + other[2040:]])) < 0.4
    # a text's features don't depend on those computed with it
    assert [x.tolist() for x in fingerprint.digests([own, spaced])] == [fingerprint.digest(x).tolist() for x in (own, spaced)] == [x.tolist() for x in fingerprint.digests([spaced, own])[::-1]]


def brute_features(raw):
    """Every window ranked, every run of windows looked at, one by one."""
    raw = raw + bytes(max(0, fingerprint.SPAN - len(raw))) if raw else raw
    places = []
    for k in range(len(raw) - fingerprint.SPAN + 1):
        window = raw[k : k + fingerprint.SPAN]
        entropy = -sum(n / fingerprint.SPAN * math.log2(n / fingerprint.SPAN) for n in Counter(b % fingerprint.CLASSES for b in window).values())
        rank = 0 if entropy < fingerprint.LEAST - 1e-4 else abs(entropy - fingerprint.USUAL) / fingerprint.SPREAD * 1000
        places.append((-round(rank), window))
    times = Counter()
    for run in range(1 - fingerprint.NEAR, len(places)):
        held = places[max(0, run) : run + fingerprint.NEAR]
        times[min(held)[0]] += 1
    return places, times


def test_fingerprint_features_equal_brute_force():
    rng = random.Random(18)
    for n in (1, 5, 16, 17, 40, 400):
        raw = "".join(rng.choice("abcdefgh  éßñ.") for _ in range(n)).encode()
        got = fingerprint.ranks(np.frombuffer(raw + bytes(max(0, fingerprint.SPAN - len(raw))), np.uint8))
        places, _ = brute_features(raw)
        rank = 65535 - (got >> np.uint64(48)).astype(int)
        assert np.abs(rank - [-p for p, _ in places]).max() <= 1
        count = Counter(int(min(got[max(0, k) : k + fingerprint.NEAR])) for k in range(1 - fingerprint.NEAR, len(got)))
        want = [x for x in dict.fromkeys(got.tolist()) if count[x] >= fingerprint.POPULAR]
        assert fingerprint.features([raw])[0].tolist() == fingerprint.mix64(np.array(want, np.uint64)).tolist()
        chain = np.zeros((1, fingerprint.BITS), bool)
        for f in fingerprint.features([raw])[0].tolist()[: fingerprint.FEATURES]:
            for i in range(fingerprint.HASHES):
                chain[0, f >> 11 * i & fingerprint.BITS - 1] = True
        assert fingerprint.digest(raw)[:1].tolist() == np.packbits(chain, axis=1).tolist()
    long_ = [b"x" * 40, "".join(rng.choice("abc d") for _ in range(3 * fingerprint.PIECE // 2)).encode(), b"short one"]
    assert [d.tolist() for d in fingerprint.digests(long_)] == [fingerprint.digest(x).tolist() for x in long_]
    assert fingerprint.digest(b"").shape == (0, fingerprint.BITS // 8)


def brute_likeness(a, b):
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if (len(a), a.tobytes()) > (len(b), b.tobytes()):
        a, b = b, a
    best = []
    for x in a:
        scores = []
        for y in b:
            n, m, both = (int(np.unpackbits(z).sum()) for z in (x, y, x & y))
            chance = n * m / fingerprint.BITS
            scores.append(0.0 if min(n, m) <= chance else min(1.0, max(0.0, (both - chance) / (min(n, m) - chance))))
        best.append(max(scores))
    return sum(best) / len(best)


def test_fingerprints_at_all_sizes():
    rng = random.Random(17)
    like = lambda a, b: fingerprint.likeness(fingerprint.digest(a), fingerprint.digest(b))
    for size in (60, 120, 158, 160, 400, 640, 2000):
        text, other = (" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(600)) for _ in range(2))
        assert like(text[:size].encode(), (text[:size] + " word").encode()) > 0.6
        assert like(text[:size].encode(), other[: size + 5].encode()) < 0.15
    assert like(b"a", b"a") == 1 and like(b"a", b"b") < 0.1 and like(b"", b"") == 1 and like(b"", b"a") == 0


def brute_judge(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        rest = rest[: min([len(rest), *(rest.find(c) for c in "?#" if c in rest)])]
        host, slash, tail = rest.partition("/")
        host, path = host.translate({c: c + 32 for c in range(65, 91)}), slash + tail
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls_equal_brute_force(spark):
    own = ["http://A.Example.org/es/x?q#f", "https://example.org/en/12", "http://x.org", "http://x.org/", "ftp://a.com/de/1", "http://a.com/fr/1", "no url", None, "", "://", "http://org/", "http://com.org.net/de/", "x://a.com/de#/fr/", "http://badexample.org/es/"]
    rng = random.Random(13)
    own += [f"http://{rng.choice('abc')}.{rng.choice(['example.org', 'com', 'net'])}/{rng.choice(['es', 'en', 'fr', 'de'])}/{rng.randint(0, 99)}" for _ in range(300)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(own)] + [(None, own[0])], "page_id long, url string").withColumn("key", F.lit("clash"))
    got = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect())
    assert got == Counter([(i, *brute_judge(u)) for i, u in enumerate(own)] + [(None, *brute_judge(own[0]))])
    assert urls.judge(pages.limit(0)).count() == 0


@pytest.mark.parametrize(("shard_keys", "most", "group"), [(10**6, 64 << 20, 10**6), (700, 64 << 20, 10**6), (700, 0, 300)])
def test_cascade_is_exact(spark, monkeypatch, shard_keys, most, group):
    monkeypatch.setattr(urls, "MOST_BYTES", most)
    monkeypatch.setattr(urls, "GROUP_ROWS", group)
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("crc32(key) % 5 = 0")
    cascade = urls.build(listed, universe, shard_keys)
    assert cascade.levels > 2 and cascade.shards == max(1, -(-listed.count() // shard_keys))
    hot = universe.limit(1).crossJoin(spark.range(9_000)).select("key")  # one key holds a third of the rows
    asked = universe.unionByName(hot).unionByName(spark.createDataFrame([(None,)], "key string")).withColumn("h1", F.lit("clash"))
    got = urls.members(asked, cascade)
    assert got.count() == 29_001 and got.where("listed <> coalesce(crc32(key) % 5 = 0, false)").count() == 0
    assert urls.members(asked, urls.build(listed.limit(0), universe)).where("listed").count() == 0


def test_longest_rule_wins_whatever_its_shape(spark):
    rules = [("block", "com", "/a/very/long/path"), ("allow", "www.example.com", "/a"), ("block", "x.com", "/"), ("allow", "x.com", "/")]
    pages = spark.createDataFrame([(1, "http://www.example.com/a/very/long/path/1"), (2, "http://www.example.com/ab"), (3, "http://x.com/" + "y" * 100_000)], "page_id long, url string")
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages, rules).collect()} == {1: ("com/a/very/long/path", "block"), 2: ("www.example.com/a", "allow"), 3: ("x.com/", "block")}
    assert {r["verdict"] for r in urls.judge(pages, []).collect()} == {"allow"}


def test_pipeline_runs(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{sf}/documents.parquet")
    names = source.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        source = stage(spark, source, sf)
        assert source.columns == names, name
        source = corpus_pipeline.stored(source, "test")
    assert corpus_pipeline.run(spark, sf).count() == source.count() > 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline
    import tiktoken

    rng = random.Random(14)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    base, other, passage = fresh(504), fresh(60), fresh(12)
    near = [f"x{k}" if k % 50 == 10 else w for k, w in enumerate(base)]  # a likeness of about 0.82
    rows = [(1, base), (2, near), (None, near), (None, fresh(30)), (None, other), (3, other), (4, fresh(20)), (5, fresh(9) + passage), (5, fresh(25)), (None, passage), (6, ["solo"]), (7, ["solo"]), (8, fresh(40))]
    rows = [(d, " ".join(w)) for d, w in rows]
    rows += [rows[6], rows[6], rows[11], rows[12], rows[3], (9, None), (10, "123 !"), (10, "123 !")]
    frame = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = sorted((r for r in rows if r[1] and any(c.isalpha() for c in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in (t.lower().split() for _, t in left)]
    group = list(range(len(left)))
    for a in range(len(left)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    kept = [left[group.index(g)] for g in sorted(set(group))]
    hit = {r for r in kept if next(iter(brute_overlap([r], [(1, " ".join(passage))])))[-1]}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}, special_tokens={})
    want = Counter((d, len(own.encode_ordinary(t))) for d, t in kept if (d, t) not in hit)
    assert want and hit and Counter((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_words_of_a_slice():
    texts = pa.array(["Ä b", None, " c  d ", "e"]).slice(1)
    from inkrow.llm._common import text_array, word_codes

    codes, offsets, distinct = word_codes(text_array(texts))
    assert [distinct[c].as_py() for c in codes] == ["c", "d", "e"] and offsets.tolist() == [0, 0, 2, 3]
    assert zlib.crc32(b"1") % 3 in (0, 1, 2)

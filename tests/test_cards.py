import random

import pytest
from pyspark.sql import functions as F

from inkrow.functions import text
from inkrow.operators import evaluate, layout, picture, read, synthetic


def value(spark, said, f):
    return spark.createDataFrame([(said,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "said", "want"),
    [
        (text.leading_hangul, "하　늘 이(天)", "하늘이"), (text.leading_hangul, "  가 나 7다", "가나"), (text.leading_hangul, "x가", ""),
        (text.hanja_in_parens, "가나()（　河　天）", "河天"), (text.hanja_in_parens, "가(나) (河)", None), (text.hanja_in_parens, "가((河)", "(河"), (text.hanja_in_parens, "가(河", None), (text.hanja_in_parens, "가( )(河)", None), (text.hanja_in_parens, "가(㐂豈)", "㐂豈"),
        (text.text_after_numbers, "1999.　8.　나라 청", "나라 청"), (text.text_after_numbers, "x 3 . 가람시장", "가람시장"),
        (text.find_serial_code, "AB 12　CD", "AB12CD"),
        (evaluate.norm, "가　나 다 라\n", "가나다라"),
    ],
)
def test_white_space_of_all_scripts(spark, f, said, want):
    assert value(spark, said, f) == want


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("1특수(소형)", ["1종특수"]), ("(I보통)", ["1종보통"]), ("1종대형 (보통) 소형", ["1종대형", "1종소형"]), ("1 종 대형)보통(", ["1종대형", "1종보통"]), ("2종소형(1종보통)", ["2종소형"]), ("특수（구난 .　소형견인）", ["1종특수(구난)", "1종특수(소형견인)"]),
        ("112 보통", []), ("1종대 보통", []), ("1보통2소형", ["1종보통", "2종소형"]), ("보통 2종 소형", ["2종소형"]),
    ],
)
def test_kinds_and_brackets(spark, said, want):
    assert value(spark, said, text.find_license_types) == want


@pytest.mark.parametrize(("said", "raw"), [("1998/7,31,4x", "1998/7,31"), ("1998/7,31, 4x", "1998/7,31,"), ("1998.7.31 .가", "1998.7.31 ."), ("1998-07-31", "1998-07-31"), ("2001.2.29,", "2001.2.29,")])
def test_raw_dates_stop_before_digits(spark, said, raw):
    assert value(spark, said, text.find_dates)[0]["raw"] == raw


def greedy(words, size, percent, room):
    def width(t):
        return sum(100 if "가" <= c <= "힣" or "一" <= c <= "鿿" else synthetic.NARROW for c in t) * size * percent / 10_000

    lines, now = [], ""
    for w in words:
        if now and width(f"{now} {w}") > room:
            lines.append(now)
            now = w
        else:
            now = f"{now} {w}" if now else w
    return lines + [now] * bool(now)


def test_wrapping_equals_a_greedy_loop(spark):
    rng = random.Random(3)
    slots, end = [(10, 0, 20), (10, 30, 20)], 150
    cases = [[], ["가" * 30], *([rng.choice(["가나", "12", "다라마바사", "(가", "나)", "x"]) for _ in range(rng.randint(1, 12))] for _ in range(60))]
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, words array<string>").select("i", synthetic.fitted(F.col("words"), slots, end).alias("f")).collect()
    for r in got:
        tries = [(p, greedy(cases[r["i"]], 20, p, end - 10)) for p in synthetic.SHRINKS]
        percent, lines = next(((p, t) for p, t in tries if len(t) <= 2), tries[-1])
        assert (r["f"]["percent"], r["f"]["lines"]) == (percent, lines[:2])
    assert len({r["f"]["percent"] for r in got}) > 3


def test_noise_is_the_same_in_any_partitions_and_grows(spark):
    papers = synthetic.documents(synthetic.cards(spark.range(40)))
    one = lambda c, n: synthetic.photographed(papers.withColumn("condition", F.lit(c)).repartition(n))
    assert one("blur", 1).exceptAll(one("blur", 5)).count() == 0
    clean = one("clean", 2)
    assert clean.select("text", "score").exceptAll(synthetic.lines(papers).select("text", "score")).count() == 0
    changed = [synthetic.lines(papers).select("id", "text").exceptAll(one(c, 2).select("id", "text")).count() for c in ("bright", "glare", "heavyblur")]
    assert 0 < changed[0] < changed[1] < changed[2]
    assert one("dark", 2).agg(F.min("score")).first()[0] == pytest.approx(0.83)


def test_misread_letters(spark):
    df = spark.createDataFrame([("a1나닿", 2, 3), ("a9나닿", 2, 3), ("a1나닿", 3, 1), ("a1나닿", 4, 1), ("a1나닿", 1, 1)], "t string, at int, by int")
    assert [r[0] for r in df.select(synthetic.misread(F.col("t"), F.col("at"), F.col("by"))).collect()] == ["a4나닿", "a2나닿", "a1낙닿", "a1나닾", "a1나닿"]


def test_titles_below_the_middle(spark):
    box = lambda y: [(0.0, y), (100.0, y), (100.0, y + 10), (0.0, y + 10)]
    rows = [(1, 0, "자동차운전면허증", 90.0), (1, 1, "가나다", 0.0), (1, 2, "라마바", 40.0), (2, 0, "주민등록증", 0.0), (2, 1, "가나다", 40.0), (2, 2, "라마바", 90.0), (3, 0, "주민등록증", 50.0), (3, 1, "가나다", 0.0), (4, 0, "x", 0.0), (4, 1, None, 5.0)]
    lines = spark.createDataFrame([(i, k, t, 0.9, box(y), None) for i, k, t, y in rows], "image long, idx int, text string, score double, box array<struct<x:double,y:double>>, chars array<struct<text:string,score:double,box:array<struct<x:double,y:double>>>>")
    from inkrow.operators import classify

    types = classify.classified(lines)
    got = {r["image"]: (r["n_lines"], r["title_low"], r["vertical"]) for r in read.looks(lines, types).collect()}
    assert got == {1: (3, True, False), 2: (3, False, False), 3: (2, False, False), 4: (1, False, False)}
    assert {r["image"]: (r["document_type"], r["title"]) for r in types.collect()} == {1: ("DRIVER_LICENSE", 0), 2: ("RESIDENT_CARD", 0), 3: ("RESIDENT_CARD", 0), 4: ("UNKNOWN", None)}


def test_boxes_of_characters(spark):
    point = lambda x, y: (float(x), float(y))
    quad = lambda x, w: [point(x, 0), point(x + w, 0), point(x + w, 9), point(x, 9)]
    df = spark.createDataFrame([(quad(0, 40), [("가", 0.9, quad(0, 10)), ("나", 0.8, quad(10, 10)), ("1", 0.7, quad(20, 10)), ("x", 0.6, None)])], "box array<struct<x:double,y:double>>, chars array<struct<text:string,score:double,box:array<struct<x:double,y:double>>>>")
    hangul = lambda c: c.rlike("^[가-힣]$")
    lead, tail = layout.leading_chars(F.col("chars"), hangul), layout.trailing_chars_after(F.col("chars"), hangul)
    r = df.select(lead.alias("lead"), tail.alias("tail"), layout.chars_box(F.col("box"), lead).alias("a"), layout.chars_box(F.col("box"), F.slice("chars", 4, 1)).alias("b"), layout.union_box(F.array(F.struct("box"))).alias("u")).first()
    assert [c["text"] for c in r["lead"]] == ["가", "나"] and [c["text"] for c in r["tail"]] == ["1", "x"]
    assert [tuple(p) for p in r["a"]] == quad(0, 20) and [tuple(p) for p in r["b"]] == quad(0, 40) == [tuple(p) for p in r["u"]]


def test_hull_and_background(spark):
    rng = random.Random(4)
    points = [[(float(rng.randrange(12)), float(rng.randrange(12))) for _ in range(rng.choice([2, 3, 8, 20]))] for _ in range(40)] + [[(1.0, 1.0)] * 4, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "i int, p array<struct<x:double,y:double>>").withColumn("h", picture.hull("p"))
    probes = spark.createDataFrame([(float(x), float(y)) for x in range(-1, 13, 2) for y in range(-1, 13, 3)], "px double, py double")
    got = df.join(F.broadcast(probes)).select("i", "px", "py", "h", picture.inside(F.col("h"), F.col("px"), F.col("py")).alias("in")).collect()

    def within(own, x, y):
        own = set(own)
        if (x, y) in own:
            return True
        cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        lines = [(a, b) for a in own for b in own if a != b and all(cross(a, b, c) >= 0 for c in own)]
        return bool(lines) and all(cross(a, b, (x, y)) >= 0 for a, b in lines) and min(p[0] for p in own) <= x <= max(p[0] for p in own) and min(p[1] for p in own) <= y <= max(p[1] for p in own)

    for r in got:
        if len(points[r["i"]]) < 3:
            assert r["h"] is None
        elif len({(p["x"], p["y"]) for p in r["h"]}) > 2:
            assert r["in"] == within(points[r["i"]], r["px"], r["py"])
    images = spark.createDataFrame([(1, [[(0.0, 0.0), (9.0, 0.0), (0.0, 9.0), (9.0, 9.0)]], None, None), (2, None, None, None)], "image long, boxes array<array<struct<x:double,y:double>>>, outline array<struct<x:double,y:double>>, faces array<struct<x0:double,y0:double,x1:double,y1:double>>")
    pixels = spark.createDataFrame([(1, x, y, 200, 190, 180) for x in range(10) for y in range(10)] + [(2, 0, 0, 1, 1, 1)], "image long, x long, y long, r int, g int, b int")
    assert [tuple(r) for r in picture.background(pixels, images).orderBy("image").collect()] == [(1, None, None, None), (2, None, None, None)]


def test_second_readings_of_names(spark):
    from inkrow.operators import classify, extract

    quad = lambda x, y, w: [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + 20), (x, y + 20))]
    letters = lambda t, x, y: [(c, 0.9, quad(x + 10 * i, y, 10)) for i, c in enumerate(t)]
    data = [(i, k, t, 0.9, quad(10, y, 90), letters(t, 10, y)) for i in (1, 2, 3) for k, (t, y) in enumerate([("주민등록증", 0), ("하늘이인", 50) if i == 3 else ("하늘이)인", 50), ("800101-2345678", 100)])]
    lines = spark.createDataFrame(data, "image long, idx int, text string, score double, box array<struct<x:double,y:double>>, chars array<struct<text:string,score:double,box:array<struct<x:double,y:double>>>>")
    again = spark.createDataFrame([(1, "하늘아 외", 0.7), (2, "하x", 0.99), (3, "하늘아", 0.8)], "image long, text string, score double")
    got = {r["image"]: (r["value"], r["confidence"]) for r in extract.resident_fields(lines, classify.title_lines(lines, classify.RESIDENT), F.lit("2026-10-07").cast("date"), again=again).where("field = 'name'").collect()}
    assert got == {1: ("하늘아외", 0.7), 2: ("하늘이", 0.9), 3: ("하늘이인", 0.9)}

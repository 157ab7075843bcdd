"""Pages are read in Arrow batches: the plain rules agree with those on columns, and lines meet once."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from inkrow import catalog
from inkrow.functions import plain, text
from inkrow.operators import address, extract, layout, page, synthetic

SAID = [
    "", " ", "\n", "800101-1234567", "800101 1234567", "8001011234567", "8OO1O1-l23456B", "*800101-1*****", "800101-1", "800101-●●", "800101–1234567", "1800101-1234567", "991301-1234567", "800101-9234567", "1 800101-1234567x2",
    "2020.02.29", "2020. 2. 3.", "2021.02.29,", "2O20-01/02", "2020.01.02.03", "1899.01.01", "2020.1.2 서울", "2020.12.11.\n", "가2020.01.02서울특별시경찰청장", "2020.01.02 3",
    "11-20-123456-61", "서울 20-123456-61", "경기북부20-123456-61", "11-20-12345X-6●", "●11-20-123456-6*9", "28–20–123456–61", "12-l8-123456-78", "서울 20 - 123456 - 61",
    "홍길동(洪吉童)", "홍 길동 (洪", "홍길동()(金)", "남궁 민수）", "(가)(洪)", "김\n", "홍길동（洪 吉）", "가나다라마바", "김A",
    "서울특별시강동구청장", "경기도 안양시 장", "강동구청창", "연천군", "서울지방경찰", "동구청", "시장", "서울특별시 경찰청", "읍장\n", "제주특별자치도 서귀포 시장", "구",
    "가람로12(하늘채)101동1203호", "누리길5", "한빛대로3번길 4-5(별빛 2차)1층", "동1동", "3차2층", "5동6호", ")가(", "로1 (", "12동 3호(", "새빛길7 8", "a로9(",
    "1종 보통", "2종소헝2종보통 원동기", "l종대형(견인)", "특수(구난,소형견인)", "1 종 특수 (구난) 보통", "12종보통", "대형 1종", "보퉁", "자동차운전면허증", "특수(", "２종보통",
    "AB1CDE", "0O1IQ1", "A B1C DE", "000000", "ABCDE", "조건: A,B", "조 건 : C·D", "조:", "조 1234567890123", "조건", "초건", "적성검사", "갱 신 기간", "적 성갱신", "서울 종로구", "세종특별자치시x", "１２３４５６-1234567",
]


def test_plain_rules_are_those_on_columns(spark):
    rng = random.Random(3)
    signs = "".join(SAID)
    said = SAID + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 24))) for _ in range(700)] + [a + b for a, b in (rng.sample(SAID, 2) for _ in range(500))]
    rules = {
        "collapse_spaces": plain.collapse_spaces, "numeric_view": plain.numeric_view, "text_after_numbers": plain.text_after_numbers, "hangul_count": plain.hangul_count, "leading_hangul": plain.leading_hangul, "name_is_valid": plain.name_is_valid,
        "hanja_in_parens": plain.hanja_in_parens, "space_after_province": plain.space_after_province, "address_is_valid": plain.address_is_valid, "repair_issuer": plain.repair_issuer, "issuer_is_valid": plain.issuer_is_valid, "find_license_types": plain.find_license_types,
        "find_serial_code": plain.find_serial_code, "has_lookalike": plain.has_lookalike, "condition_codes": plain.condition_codes, "aptitude_kind": plain.aptitude_kind, "license_type_is_valid": plain.license_type_is_valid,
    }
    today = F.lit("2026-10-07").cast("date")
    number = lambda r: F.struct(text.rrn_formatted(r["front"], r["sex"], r["back"]), text.rrn_birth(r["front"], r["sex"]), text.rrn_checksum_ok(r["front"], r["sex"], r["back"]), text.rrn_is_valid(r["front"], r["sex"], today), text.rrn_derived(r["front"], r["sex"])["is_foreigner"].cast("string"))
    licence = lambda r: F.struct(text.license_formatted(r), text.license_is_masked(r), text.license_number_is_valid(r), r["printed"])
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").repartition(4)
    columns = {name: getattr(text, name)("t") for name in rules}
    columns |= {"fix_spacing": address.fix_spacing(F.col("t")), "rrns": F.transform(text.find_rrns("t"), number), "dates": text.find_dates("t"), "licences": F.transform(text.find_license_numbers("t"), licence), "others": text.serial_alternatives(F.left("t", F.lit(6)))}
    rules |= {
        "fix_spacing": plain.fix_spacing, "rrns": lambda t: [(n.formatted, n.birth, n.checksum_ok, n.valid(date(2026, 10, 7)), n.derived()["is_foreigner"]) for n in plain.find_rrns(t)], "dates": plain.find_dates,
        "licences": lambda t: [(n.formatted, n.masked, n.valid, n.printed) for n in plain.find_license_numbers(t)], "others": lambda t: plain.serial_alternatives(t[:6]),
    }
    same = lambda x: [tuple(v) if isinstance(v, tuple) else v for v in x] if isinstance(x, list) else tuple(x) if isinstance(x, tuple) else x
    wrong = [(name, said[r["i"]], r[name], rules[name](said[r["i"]])) for r in rows.select("i", *[c.alias(n) for n, c in columns.items()]).collect() for name in columns if same(r[name]) != same(rules[name](said[r["i"]]))]
    assert not wrong, wrong[:20]


def test_tenths_are_rounded_as_spark_rounds(spark):
    values = [0.05, 0.15, 0.25, 604.05, 1.005, -0.05, -0.25, 999 - 445.18, 15.18 * 7, 0.0, -0.01, 123456.75, float("inf"), None]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(F.round("v", 1)).collect()]
    assert [page.rounded(v) for v in values] == got


@pytest.mark.parametrize("degrees", [0, 90, 180])
def test_boxes_on_turned_pictures(spark, degrees):
    rows = spark.createDataFrame([("가 1(", 0.9, 430.0, 355.0, 27.6), ("", None, 5.0, 1.0, 20.0), (" ", 0.5, 7.0, 2.0, 10.0), ("洪a😀", 0.97, 80.0, 170.0, 44.0)], "text string, score double, x double, y double, size double")
    around = {0: None, 90: lambda p: (719 - p["y"], p["x"]), 180: lambda p: (999 - p["x"], 719 - p["y"])}[degrees]

    def turned(box):
        xs, ys = (F.transform(box, lambda p: around(p)[i]) for i in (0, 1))  # noqa: B023
        return layout.quad(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))

    want = synthetic.boxed(rows)
    if around:
        want = want.withColumns({"box": turned(F.col("box")), "chars": F.transform("chars", lambda c: c.withField("box", turned(c["box"])))})
    assert synthetic.boxed(rows, None, F.lit(degrees), (1000, 720)).collect() == want.collect()


def test_document_results_sets_addresses_right_once_and_reads_pages_in_batches(spark, tmp_path, monkeypatch):
    spark.range(20).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    asked, plans = [], []
    correct, stored = address.correct, extract.stored
    monkeypatch.setattr(address, "correct", lambda df, *rest: asked.append(df) or correct(df, *rest))
    monkeypatch.setattr(extract, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or stored(df, name))
    assert catalog.QUERIES["document_results"](spark, str(tmp_path)).count() == 20
    assert len(asked) == 1
    pages = [plan for name, plan in plans if name == "pages"]
    # lines aren't joined to types, and no function on arrays reads them
    assert len(pages) == 2 and all("ArrowEvalPython" in p and "Join" not in p and "lambdafunction" not in p for p in pages)


def test_card_conditions_places_letters_in_batches(spark, tmp_path):
    papers = synthetic.documents(synthetic.cards(spark.range(12)))
    plan = synthetic.photographed(papers)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(split(text" not in plan
    spark.range(60).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    assert sum(r["n"] for r in catalog.QUERIES["card_conditions"](spark, str(tmp_path)).collect()) == 60


def test_empty_letters_and_missing_boxes_are_no_error(spark):
    kind = "image long, idx int, text string, score double, box array<struct<x:double,y:double>>, chars array<struct<text:string,score:double,box:array<struct<x:double,y:double>>>>"
    quad = [(10.0, 100.0), (90.0, 100.0), (90.0, 120.0), (10.0, 120.0)]
    rows = [(1, 0, "800101-1234567", None, quad, []), (1, 1, "홍길동", 0.9, None, None), (1, None, "김철수", 0.8, [(10.0, 50.0), (70.0, 50.0), (70.0, 70.0), (10.0, 70.0)], [("김", None, None), (None, 0.1, [(10.0, 50.0)])]), (2, 0, " ", 0.1, quad, None)]
    titles = spark.createDataFrame([], "image long, idx int")
    for read in (extract.resident_fields, extract.license_fields):
        got = {(r.image, r.field): (r.value, r.confidence) for r in read(spark.createDataFrame(rows, kind), titles, F.lit("2026-10-07").cast("date")).collect()}
        assert got[1, "rrn"] == ("800101-1234567", None) and {k for k, _ in got} == {1}
    assert extract.numbers(spark.createDataFrame(rows, kind), F.lit("2026-10-07").cast("date")).count() == 1

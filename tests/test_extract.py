import pytest
from pyspark.sql import functions as F

from inkrow.functions import text
from inkrow.operators import address, classify, extract, layout


def test_license_types(spark):
    cases = {
        "특수(구난,소형견인)": ["1종특수(구난)", "1종특수(소형견인)"],
        "2종소헝2종보통 원동기": ["2종소형", "2종보통", "2종원동기"],
        "l종 대형 보통": ["1종대형", "1종보통"],
        "대형 보통": [],
        "": [],
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "t string").select("t", text.find_license_types("t").alias("got"))
    assert {r.t: r.got for r in df.collect()} == {**cases, None: None}


def test_addresses(spark):
    provinces = spark.createDataFrame([("서울특별시",), ("대전광역시",), ("경기도",), ("부산광역시",)], "province string")
    districts = spark.createDataFrame([("서울특별시", "종로구"), ("서울특별시", "중구"), ("부산광역시", "중구"), ("대전광역시", "서구"), ("경기도", "성남시"), ("경기도", "분당구")], "province string, district string")
    cases = [
        ("대전광역서 서구 대학로 1", "대전광역시 서구 대학로 1", True),
        ("경기도 성남시 분당규 정자로12", "경기도 성남시 분당구 정자로 12", True),
        ("서울특별시 중앙로 1", "서울특별시 중앙로 1", True),
        ("서올특벌지 종로구 은천로 93", "서울특별시 종로구 은천로 93", True),
        ("서올특벌지 중구 세종대로 1", "서올특벌지 중구 세종대로 1", False),
        ("", "", False),
        ("경기도", "경기도", True),
        (None, None, False),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, address string")
    for words in (None, spark.createDataFrame([], "word string")):
        got = address.correct(df, provinces, districts, words).orderBy("id").collect()
        assert [(r.corrected, r.valid) for r in got] == [c[1:] for c in cases]
    assert [tuple(p) for p in got[0].changed] == [("대전광역서", "대전광역시")]
    same = spark.createDataFrame([(1, "서울특별시 송파구 올림픽루 1"), (1, "서울특별시 종로구 은천로 93"), (None, "서울특별시 종로구 올림픽루 2")], "id int, address string")  # ids repeat and are missing
    fixed = address.correct(same, provinces, districts, spark.createDataFrame([("올림픽로",), ("은천로",)], "word string")).collect()
    assert {(r.id, r.corrected, r.changed[0].new if r.changed else None) for r in fixed} == {(1, "서울특별시 송파구 올림픽로 1", "올림픽로"), (1, "서울특별시 종로구 은천로 93", None), (None, "서울특별시 종로구 올림픽로 2", "올림픽로")}
    assert spark.createDataFrame([("성남시분당구",)], "d string").select(address.split_district(F.col("d"))).first()[0] == ["성남시", "분당구"]


LINES = "image long, idx int, text string, score double, box array<struct<x:double,y:double>>, chars array<struct<text:string,score:double,box:array<struct<x:double,y:double>>>>"


def line(image, idx, said, x, y, w, h=20, score=0.9, chars=None):
    return image, idx, said, score, [(float(a), float(b)) for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h))], chars and [(*c, None) for c in chars]


def test_resident_fields(spark):
    number = "800101-2345678"
    chars = [(c, 0.5 if i == 3 else 0.95) for i, c in enumerate(number)]
    data = [
        line(1, 0, "주민등록증", 20, 0, 80), line(1, 1, "홍길동)", 10, 50, 60), line(1, 2, number, 10, 100, 80, chars=chars), line(1, 3, "1990.08.16", 40, 200, 50),
        line(2, 0, "800101-2345678", 10, 100, 80), line(2, 1, "800101-2345679", 10, 150, 80), line(2, 2, "2020.02.31", 10, 190, 80),
        line(3, 0, "홍길동", 10, 50, 60), line(3, 1, None, 10, 90, 60),
    ]
    lines = spark.createDataFrame(data, LINES)
    got = {(r.image, r.field): (r.value, r.confidence, r.valid, r.warnings) for r in extract.resident_fields(lines, classify.title_lines(lines, classify.RESIDENT), F.lit("2026-10-07").cast("date")).collect()}
    assert got[1, "rrn"] == (number, 0.5, True, ["CHECKSUM_MISMATCH:rrn"])
    assert got[1, "name"] == ("홍길동", 0.9, True, [])
    assert got[1, "issue_date"] == ("1990-08-16", 0.9, False, [])
    assert got[2, "rrn"][2:] == (False, ["AMBIGUOUS:rrn", "CHECKSUM_MISMATCH:rrn"])
    assert got[2, "issue_date"][2] is False
    assert not [k for k in got if k[0] == 3]
    assert extract.resident_fields(lines.limit(0), classify.title_lines(lines.limit(0), classify.RESIDENT), F.current_date()).count() == 0


@pytest.mark.parametrize("turn", [0, 90, 180, 270])
def test_boxes_turn_back(spark, turn):
    w, h, x, y = 100, 60, 30, 20
    seen = {0: (x, y), 90: (h - 1 - y, x), 180: (w - 1 - x, h - 1 - y), 270: (y, w - 1 - x)}[turn]
    df = spark.createDataFrame([([(float(seen[0]), float(seen[1]))],)], "box array<struct<x:double,y:double>>")
    assert tuple(df.select(layout.turned_back(F.col("box"), F.lit(turn), F.lit(w), F.lit(h), F.lit(2.0))[0].alias("p")).first().p) == (15.0, 10.0)


def test_license_fields(spark):
    data = [
        line(1, 0, "자동차운전면허증", 200, 0, 150), line(1, 1, "1종보통", 10, 30, 60), line(1, 2, "2종보퉁", 10, 60, 60, score=0.8),
        line(1, 3, "11-20-123456-61", 200, 60, 150), line(1, 4, "홍길동", 200, 90, 60), line(1, 5, "800101-1234567", 200, 120, 140),
        line(1, 6, "서울특별시 중구 세종대로 1", 200, 150, 180), line(1, 7, "적성검사기간", 200, 190, 100), line(1, 8, "2025.01.01", 310, 190, 70),
        line(1, 9, "~2025.12.31", 310, 215, 70, score=0.7), line(1, 10, "조건: A", 200, 250, 50), line(1, 11, "AB1CDE", 420, 230, 60),
        line(1, 12, "2015.03.02", 220, 300, 70), line(1, 13, "서울특별시경찰청장", 300, 300, 150),
        line(2, 0, "11-20-123456-6X", 200, 60, 150), line(2, 1, "29-20-123456-61", 200, 90, 150), line(2, 2, None, 0, 0, 9),
    ]
    lines = spark.createDataFrame(data, LINES)
    titles = spark.createDataFrame([(1, 0)], "image long, idx int")
    rows = extract.license_fields(lines, titles, F.lit("2026-10-07").cast("date")).collect()
    got = {(r.image, r.field): (r.value, r.confidence, r.valid, r.warnings) for r in rows}
    assert len(got) == len(rows) == 15
    assert got[1, "address"][:3] == ("서울특별시 중구 세종대로 1", 0.9, True) and got[1, "issuer"] == ("서울특별시경찰청장", 0.9, True, [])
    assert {(r.image, r.field): r.derived for r in rows if r.derived}[1, "license_number"] == {"license_region_name": "서울"}
    assert got[2, "rrn"] == ("123456-6******", 0.9, False, ["MASKED:rrn"])  # a licence number with a hidden check digit reads as a hidden number too
    assert got[1, "rrn"][0] == "800101-1234567"
    assert got[1, "license_number"] == ("11-20-123456-61", 0.9, True, [])
    assert got[1, "license_types"] == ("1종보통|2종보통", 0.8, True, [])
    assert got[1, "name"] == ("홍길동", 0.9, True, [])
    assert got[1, "aptitude_period"] == ("2025-01-01~2025-12-31", 0.7, True, [])
    assert got[1, "issue_date"] == ("2015-03-02", 0.9, True, [])
    assert got[1, "serial_code"] == ("AB1CDE", 0.9, True, ["LOOKALIKE:serial_code"])
    assert got[1, "conditions"] == ("A", 0.9, True, [])
    assert got[2, "license_number"] == ("11-20-123456-6X", 0.9, False, ["AMBIGUOUS:license_number", "MASKED:license_number"])

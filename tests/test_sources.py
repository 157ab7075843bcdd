import hashlib
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from inkrow.functions import text
from inkrow.operators import decide, evaluate, layout, synthetic
from inkrow.sources import files, tables
from inkrow.streaming import lines as stream

JPEG, PNG, WEBP = b"\xff\xd8\xff\xe0rest of it", b"\x89PNG\r\n\x1a\nmore", b"RIFF\x01\x02\x03\x04WEBPVP8 "


def put(folder, **contents):
    for name, content in contents.items():
        path = folder / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)


def test_bodies_tell_errors(spark, tmp_path):
    for name, content in {"a/good.jpg": JPEG, "b/good.png": PNG, "c/plain": WEBP, "octets.bin": PNG, "empty.jpg": b"", "large.jpg": JPEG * 100, "wrong.png": JPEG, "text.jpg": b"no picture", "notes.txt": b"hello"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.bodies(spark, str(tmp_path), most_bytes=500).collect()}
    assert {k: r["error"] for k, r in got.items()} == {"good.jpg": None, "good.png": None, "plain": None, "octets.bin": None, "empty.jpg": "EMPTY_BODY", "large.jpg": "PAYLOAD_TOO_LARGE", "wrong.png": "UNSUPPORTED_MEDIA_TYPE", "text.jpg": "UNSUPPORTED_MEDIA_TYPE", "notes.txt": "UNSUPPORTED_MEDIA_TYPE"}
    assert bytes(got["good.jpg"]["content"]) == JPEG and got["plain"]["media_type"] == "image/webp" and got["large.jpg"]["content"] is None and got["wrong.png"]["content"] is None


def test_manifest(spark, tmp_path):
    put(tmp_path, **{"models__same.bin": b"one", "models__changed.bin": b"two", "more.bin": b"three"})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    listed = spark.createDataFrame([("models/same.bin", digest(b"one").upper()), ("models/changed.bin", digest(b"2")), ("gone.bin", digest(b"x")), ("more2.bin", None)], "file string, sha256 string")
    got = {r["file"]: r["state"] for r in files.verified(spark, str(tmp_path), listed).collect()}
    assert got == {"models/same.bin": "ok", "models/changed.bin": "altered", "gone.bin": "missing", "more2.bin": "missing", "more.bin": "extra"}


def test_specimens_meet_by_name(spark, tmp_path):
    truth = lambda n: json.dumps({"document_type": "RESIDENT_CARD", "fields": {"name": n}}, indent=1).encode()
    for name, content in {"card.gt.json": truth("A"), "card.v2.gt.json": truth("B"), "lonely.gt.json": truth("C"), "card.jpg": b"1", "card.v2.png": b"2", "cards.jpg": b"3", "card.v2.jpg": b"4", "nothing": b"5"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r["fields"]["name"]: r["image"].rsplit("/", 1)[1] for r in files.specimens(spark, str(tmp_path), "name string").collect()}
    assert got == {"A": "card.jpg", "B": "card.v2.jpg"}  # the truth files' own names begin alike


def test_sets_are_read_back(spark, tmp_path):
    papers = synthetic.documents(synthetic.cards(spark.range(30))).withColumn("condition", F.when(F.col("id") % 2 == 0, "clean").otherwise("dark"))
    path, fields = str(tmp_path / "set"), "name string, rrn string, address string, license_number string"
    for batch, some in enumerate((papers.where("id < 20"), papers.where("id >= 20"))):
        files.write_set(some, synthetic.lines(some), path, batch)
    files.write_set(papers.where("id >= 20"), synthetic.lines(papers.where("id >= 20")), path, 1)  # once more
    back = files.read_set(spark, path, fields)
    want = {(str(r["id"]), r["condition"], r["document_type"], *(r["truth"].get(k) for k in ("name", "rrn", "address", "license_number"))) for r in papers.collect()}
    got = [(r["image"], r["condition"], r["document_type"], *r["fields"]) for r in back.collect()]
    assert set(got) == want and len(got) == 30
    assert spark.read.json(f"{path}/lines").select("id", "idx").distinct().count() == synthetic.lines(papers).count()
    # truth without an index isn't there
    papers.where("id = 0").select(F.lit("x").alias("name"), "document_type").write.json(f"{path}/truth/batch=9")
    assert files.read_set(spark, path, fields).count() == 30


def test_truth_in_files_of_its_own(spark, tmp_path):
    put(tmp_path, **{"clean__a b.gt.json": json.dumps({"document_type": "X", "fields": {"name": "N"}}, indent=1).encode(), "dark__a b.gt.json": json.dumps({"fields": {"name": "M"}}).encode()})
    (tmp_path / "index.jsonl").write_text("\n".join(json.dumps({"image": f"{c}/a.jpg", "gt": f"{c}/a b.gt.json", "condition": c, "document_type": "Y"}) for c in ("clean", "dark", "gone")))
    got = {r["condition"]: (r["document_type"], r["fields"] and r["fields"]["name"]) for r in tables.truth(spark, str(tmp_path / "index.jsonl"), str(tmp_path), "name string").collect()}
    assert got == {"clean": ("X", "N"), "dark": ("Y", "M"), "gone": ("Y", None)}


def test_lists_and_lexicons(spark, tmp_path):
    (tmp_path / "words.txt").write_text("가나　다라 x 마바\n가나\n", encoding="utf-8")
    assert sorted(r["word"] for r in tables.word_list(spark, str(tmp_path / "words.txt")).collect()) == ["가나", "다라", "마바"]
    districts = spark.createDataFrame([("경기도", "성남시분당구"), ("경기도", "여주시"), ("서울특별시", "중구")], "province string, district string")
    tables.write_lexicon(districts, str(tmp_path / "lexicon"))
    provinces, back = tables.lexicon(spark, str(tmp_path / "lexicon"))
    assert sorted(map(tuple, back.collect())) == [("경기도", "분당구"), ("경기도", "성남시"), ("경기도", "여주시"), ("서울특별시", "중구")] and provinces.count() == 2
    put(tmp_path, **{"pics__a_01.jpg": b"1", "pics__a_02.JPG": b"1", "pics__b.seal.png": b"1", "pics__sub__c.png": b"1", "pics__d.txt": b"1"})
    got = sorted(r["path"].rsplit("/", 1)[1] for r in tables.listing(spark, str(tmp_path / "pics")).collect())
    assert got == ["a_01.jpg", "c.png"]


def test_results_and_reports_are_written(spark, tmp_path):
    rows = spark.createDataFrame([Row(image=1, condition="clean", name=None), Row(image=2, condition="dark", name="x")], "image long, condition string, name string")
    tables.write_results(rows, str(tmp_path / "out"), ("condition",))
    back = [json.loads(line) for p in sorted((tmp_path / "out").glob("*/*.json")) for line in p.read_text().splitlines()]
    assert sorted(map(str, back)) == sorted(["{'image': 1, 'name': None}", "{'image': 2, 'name': 'x'}"])
    report = spark.createDataFrame([("b", "second"), ("a", "first"), ("c", "third")], "position string, line string").repartition(3)
    files.write_report(rows, report, str(tmp_path / "report"))
    assert [line for p in sorted((tmp_path / "report/report").glob("*.txt")) for line in p.read_text().splitlines()] == ["first", "second", "third"]
    shown = [r["p"] for r in spark.createDataFrame([(1, 3), (0, 0), (2, 2)], "a int, b int").select(evaluate.percent(F.col("a"), F.col("b")).alias("p")).collect()]
    assert shown == ["33.3%", "-", "100.0%"]


def test_two_micro_batches_equal_one_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    papers = synthetic.documents(synthetic.cards(spark.range(12)))
    every = synthetic.lines(papers).select(F.col("id").alias("image"), F.lit("original").alias("pass"), "idx", "text", "score", "box", "chars")
    ordered = lambda df: layout.reading_order(layout.bounds(df)).select("image", "idx", "place")
    both = str(tmp_path / "out")

    def arrive(name, some):
        for p in (tmp_path / name).glob("*.json") if some.coalesce(1).write.json(str(tmp_path / name)) is None else ():
            (folder / f"{name}.json").write_bytes(p.read_bytes())

    for name, part in (("first", "image < 5"), ("second", "image >= 5")):
        arrive(name, every.where(part))
        stream.by_image(stream.lines(spark, str(folder), 1), ordered, both, str(tmp_path / "state")).awaitTermination(120)
        stream.append(stream.redacted(stream.lines(spark, str(folder), 1)), str(tmp_path / "lines"), str(tmp_path / "state2")).awaitTermination(120)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(stream.read(spark, both)) == key(ordered(every))
    assert key(spark.read.parquet(str(tmp_path / "lines")).select("image", "idx", "text")) == key(every.select("image", "idx", text.redact("text")))


@pytest.mark.parametrize("seed", [1])
def test_levels_are_one_shuffle(spark, seed):
    images = spark.createDataFrame([(1, "A", "x", "A", "OK", 5), (2, "A", None, "B", "FAIL", 7), (3, "B", "x", None, "OK", 9)], "image long, document_type string, condition string, predicted_type string, status string, elapsed_ms long")
    fields = spark.createDataFrame([(1, True, True, True), (1, False, False, True), (2, True, None, None)], "image long, core boolean, correct boolean, accepted boolean")
    report = evaluate.level_report(images, fields)
    got = {(r["document_type"], r["condition"], r["by_condition"]): (r["n"], r["ok"], r["core_correct"], r["ok_wrong"], r["other_type"], r["p50"]) for r in report.collect()}
    assert got == {("A", "x", True): (1, 1, 1, 1, 0, 5.0), ("A", None, True): (1, 0, 0, 0, 1, 7.0), ("A", None, False): (2, 1, 1, 1, 1, 6.0), ("B", "x", True): (1, 1, 0, 0, 1, 9.0), ("B", None, False): (1, 1, 0, 0, 1, 9.0)}
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1
    lines = [r["line"] for r in evaluate.markdown(report, evaluate.field_report(fields.withColumns({"document_type": F.lit("A"), "field": F.lit("name"), "found": F.lit(True), "cer": F.lit(0.5)}), ["document_type", "field"])).orderBy("position").collect()]
    assert lines[:5] == ["## A (2)", "| OK / PARTIAL / FAIL | 50.0% / 0.0% / 50.0% |", "| taken for another type | 1 |", "| all fields correct | 0.0% |", "| OK with a wrong field | 1 (50.0%) |"]
    assert lines[5].startswith("| name | 100.0% |") and lines[6] == "| - | 1 | 0.0% | 0.0% | 0.0% | 7 ms |"


def test_strict_numbers_and_ranks(spark):
    empty = "array<string>"
    fields = spark.createDataFrame([(1, "name", 0.9, True, False, []), (1, "rrn", 0.95, True, False, ["CHECKSUM_MISMATCH:rrn"])], f"image long, field string, confidence double, valid boolean, verified boolean, warnings {empty}")
    types = spark.createDataFrame([(1, "RESIDENT_CARD"), (2, "DRIVER_LICENSE"), (3, "UNKNOWN")], "image long, document_type string")
    got = {r["image"]: tuple(r)[1:] for r in decide.ranks(fields, types).collect()}
    assert got == {1: ("PARTIAL", 2, pytest.approx(0.925)), 2: ("FAIL", 0, None)}
    assert {r["image"]: r["status"] for r in decide.ranks(decide.strict_checksum(fields), types).collect()}[1] == "FAIL"


def test_records_as_json(spark):
    box = [(1.0, 2.0), (3.0, 2.0), (3.0, 4.0), (1.0, 4.0)]
    quads = "array<array<struct<x:double,y:double>>>"
    data = [(1, "rrn", "800101-2345678", 0.95, True, True, ["W"], [box, box], {"gender": "F"}), (2, "license_types", "1종보통|2종소형", 0.9, True, False, [], [box], {}), (2, "aptitude_period", "2025-01-01~", 0.9, True, False, [], [None], None)]
    fields = spark.createDataFrame(data, f"image long, field string, value string, confidence double, valid boolean, verified boolean, warnings array<string>, boxes {quads}, derived map<string,string>")
    images = spark.createDataFrame([(1, "RESIDENT_CARD", 5, True), (2, "DRIVER_LICENSE", 5, True), (3, None, 0, True)], "image long, document_type string, n_lines int, decoded boolean")
    results = decide.assemble(fields, images).withColumns({"pass": F.lit("rot90"), "passes": F.lit(2)})
    got = {r["image"]: json.loads(r["document"]) for r in decide.documents(results, {"name": "m"}, request=F.col("image").cast("string"), elapsed_ms=F.lit(7)).collect()}
    corners = [[1, 2], [3, 2], [3, 4], [1, 4]]
    assert got[1]["field_meta"]["rrn"] == {"found": True, "confidence": 0.95, "bbox": [corners, corners], "valid": True, "accepted": True} and got[1]["derived"] == {"gender": "F"}
    assert got[2]["fields"]["license_types"] == ["1종보통", "2종소형"] and got[2]["fields"]["aptitude_period"] == {"start": "2025-01-01", "end": None, "kind": None} and got[2]["field_meta"]["license_types"]["bbox"] == corners
    assert set(got[2]["fields"]) == set(decide.SPECS["DRIVER_LICENSE"]["fields"]) and got[2]["fields"]["name"] is None
    assert got[3]["fields"] == {} and got[3]["document_side"] == "UNKNOWN" and got[3]["fail_reason"] == "NO_TEXT" and got[3]["request_id"] == "3"
    assert got[1]["preprocess"] == {"rotation": 90, "contrast_enhanced": False, "passes": 2} and got[1]["model"] == {"name": "m", "schema": "1"} and got[1]["elapsed_ms"] == 7

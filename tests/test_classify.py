from pyspark.sql import functions as F

from inkrow.operators import classify


def test_document_types(spark):
    said = [(1, 0, "주민등록증"), (2, 0, "x 주민등록중"), (3, 0, "자동차운전면허증"), (4, 0, "Driver's License"), (5, 0, None), (6, 0, "운전면허증 1종"), (7, 0, "")]
    got = classify.document_types(spark.createDataFrame(said, "image long, idx int, text string"))
    assert {r.image: r.document_type for r in got.collect()} == {1: "RESIDENT_CARD", 2: "RESIDENT_CARD", 3: "DRIVER_LICENSE", 4: "DRIVER_LICENSE", 5: "UNKNOWN", 6: "DRIVER_LICENSE", 7: "UNKNOWN"}


def test_snap_to_list(spark):
    names = ["서울경찰청장", "부산경찰청장"]
    df = spark.createDataFrame([("서울 경찰청장",), ("부신경찰청장",), ("시장",)], "t string")
    got = [tuple(r.s) for r in df.select(classify.snap_to_list(F.col("t"), names).alias("s")).collect()]
    assert got == [("서울경찰청장", False), ("부산경찰청장", True), ("시장", False)]

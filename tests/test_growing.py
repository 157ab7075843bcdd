"""Joins of tables that grow with the input are merged, however small Spark takes them for."""

import pytest
from pyspark.sql import functions as F

from inkrow import catalog
from inkrow.operators import decide, evaluate


def broadcast_rows(df) -> list[str]:
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastHashJoin" in x or "BroadcastNestedLoopJoin" in x]


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    own = str(tmp_path_factory.mktemp("orders"))
    key = F.col("id")
    rows = spark.range(300).select(key.alias("o_orderkey"), key.alias("o_custkey"), F.when(key % 2 == 0, "O").otherwise("F").alias("o_orderstatus"), F.concat(F.lit("P"), (key % 5).cast("string")).alias("o_orderpriority"))
    rows.write.parquet(f"{own}/orders.parquet")
    return own


@pytest.mark.parametrize("query", ["card_results", "card_documents", "truth_scores"])
def test_results_are_merged_by_image(spark, orders, query):
    df = catalog.QUERIES[query](spark, orders)
    assert broadcast_rows(df) == []
    assert df.count() == (1500 if query == "truth_scores" else 300)


def test_reports_join_images_by_merging(spark, orders):
    fields, images = catalog._scored(spark, orders)
    assert broadcast_rows(evaluate.level_report(images.withColumn("predicted_type", F.col("document_type")), fields)) == []
    assert broadcast_rows(catalog._levels(spark, orders)[1]) == []


def test_conditions_join_images_by_merging(spark, orders):
    # shares and times of a condition may be broadcast: there are few conditions
    assert len(broadcast_rows(catalog.condition_scores(spark, orders))) <= 1


def test_ranks_are_merged(spark, orders):
    fields, images = catalog._results(spark, orders)
    assert broadcast_rows(decide.ranks(fields, images)) == []


def test_report_lines_work_levels_out_once(spark, orders):
    plan = catalog.report_lines(spark, orders)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("by_condition#") and plan.count("Expand") == 1


@pytest.mark.parametrize("query", ["report_levels", "report_lines"])
def test_reports_take_results_that_were_worked_out_once(spark, orders, query):
    # the driver's plan holds what is made of the results, not the results themselves once for each use
    plan = catalog.QUERIES[query](spark, orders)._jdf.queryExecution().optimizedPlan().toString()
    assert "field_meta" in plan and "collect_list" not in plan


def test_cards_are_spread_over_tasks_whatever_their_files_bytes(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    tasks = catalog.QUERIES["card_addresses"](spark, str(tmp_path)).select("id", F.spark_partition_id().alias("task"))
    assert tasks.count() == 50 and tasks.select("task").distinct().count() > 1


def test_resident_cards_are_spread_over_tasks(spark, tmp_path, monkeypatch):
    from inkrow.operators import extract

    spark.range(40).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    seen = []
    own = extract.resident_fields
    monkeypatch.setattr(extract, "resident_fields", lambda lines, *rest: seen.append(lines) or own(lines, *rest))
    catalog.QUERIES["resident_fields"](spark, str(tmp_path))
    assert seen[0].select(F.spark_partition_id()).distinct().count() > 1


def test_no_letter_measures_the_letters_before_it(spark):
    from inkrow.operators import synthetic

    rows = spark.createDataFrame([("가 1(", 0.9, 10.0, 5.0, 20.0), ("", 0.9, 0.0, 0.0, 20.0)], "text string, score double, x double, y double, size double")
    out = synthetic.boxed(rows)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 0
    got = [[(c["text"], c["box"][0]["x"], c["box"][1]["x"]) for c in r["chars"]] for r in out.collect()]
    assert got == [[("가", 10.0, 30.0), ("1", 41.0, 52.0), ("(", 52.0, 63.0)], [("", 0.0, 0.0)]]


def test_extractors_write_no_lines_out(spark, tmp_path, monkeypatch):
    from inkrow.operators import extract

    spark.range(40).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    seen, own = [], extract.stored
    monkeypatch.setattr(extract, "stored", lambda df, name: seen.append((name, df.columns, df)) or own(df, name))
    out = catalog.QUERIES["document_results"](spark, str(tmp_path))
    assert [(name, columns) for name, columns, _ in seen if name == "pages"] == [("pages", ["image", "found", "address", "__address"])] * 2
    # steps take lines without their characters, which stand beside them
    assert all("letters" in df._jdf.queryExecution().analyzed().toString() for name, _, df in seen if name == "pages")
    assert out.count() == 40 and out.where("status = 'OK'").count() == 32


def test_numbers_are_looked_for_where_digits_may_be(spark):
    from inkrow.functions import text

    said = ["800101-l23456B", "2O20.01.02.", "12-l8-123456-78", "서울 18-123456-78", "12-18-●●3456-78", "가나다", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").select("i", text.find_rrns("t").alias("n"), text.find_dates("t").alias("d"), text.find_license_numbers("t").alias("l")).orderBy("i")
    got = [tuple(None if x is None else len(x) for x in (r.n, r.d, r.l)) for r in rows.collect()]
    assert got == [(1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 1), (0, 0, 1), (0, 0, 0), (0, 0, 0), (None, None, None)]

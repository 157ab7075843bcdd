import duckdb
import pytest

import __spark_entry__ as entry
from inkrow import catalog
from inkrow.operators import decide, layout

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(table):
    names = sorted(table.schema.names)
    return names, sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else repr(v) for v in r.values()) for r in table.select(names).to_pylist())


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toArrow()) == rows(duck.sql(catalog.SQL[name]).to_arrow_table())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rows_compare_with_all_members(spark):
    lines = spark.createDataFrame([(1, i, f"t{i}", 0.9, float(x), float(x + 5), float(y), float(y + 10)) for i, (x, y) in enumerate([(0, 0), (20, 4), (10, 8), (0, 40)])], "image int, idx int, text string, score double, x0 double, x1 double, y0 double, y1 double")
    got = layout.rows(lines.selectExpr("*", "y1 - y0 AS h", "(y0 + y1) / 2 AS cy")).orderBy("row").collect()
    assert [r["idxs"] for r in got] == [[0, 2, 1], [3]]
    assert got[0]["text"] == "t0 t2 t1"


def test_best_attempt_stops_at_the_first_ok(spark):
    tries = spark.createDataFrame([(1, 1, "FAIL", 1, 0.5), (1, 2, "OK", 2, 0.6), (1, 3, "OK", 9, 0.9), (2, 1, "PARTIAL", 1, None), (2, 2, "PARTIAL", 1, None)], "image int, position int, status string, n_accepted int, mean_confidence double")
    got = {r["image"]: (r["position"], r["passes"]) for r in decide.best_attempts(tries, "image", "position").collect()}
    assert got == {1: (2, 2), 2: (1, 2)}


def test_nearest_needs_a_single_best(spark):
    words, names = spark.createDataFrame([("abcd",), ("zz",), (None,)], "word string"), spark.createDataFrame([("abce",), ("abcf",), ("zzz",)], "candidate string")
    assert {r["word"]: r["found"] for r in decide.nearest(words, names, 1).collect()} == {"abcd": None, "zz": "zzz"}


def test_known_types_break_ties(spark):
    tries = spark.createDataFrame([(1, 1, "FAIL", None, None, False), (1, 2, "FAIL", 0, 0.0, True), (2, 1, None, 0, 0.5, True), (2, 2, "FAIL", 0, 0.1, None)], "image int, position int, status string, n_accepted int, mean_confidence double, known boolean")
    assert {r["image"]: r["position"] for r in decide.best_attempts(tries, "image", "position", "known").collect()} == {1: 2, 2: 2}

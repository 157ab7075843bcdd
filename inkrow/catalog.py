"""All queries of the library on the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkrow import card_queries, picture_queries
from inkrow.functions import jamo, text
from inkrow.operators import address, classify, decide, evaluate, extract, layout
from inkrow.sources.tables import growing, spread, stored, table

FLAGSHIP = "verdict_report"
TODAY = "2026-10-07"


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised fields taken from line items: an order is an image, a line a field."""
    kind = F.when(F.col("l_linenumber") % 3 == 0, "numeric").when(F.col("l_linenumber") % 3 == 1, "text").otherwise("address")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image"),
        F.col("l_linenumber").alias("field"),
        kind.alias("kind"),
        F.round(F.lit(0.99) - F.col("l_discount") * 4, 2).alias("confidence"),
        (F.col("l_returnflag") != "R").alias("valid"),
        (F.col("l_linestatus") == "F").alias("verified"),
        (F.col("l_linenumber") == 1).alias("core"),
        (F.col("l_linenumber") <= 3).alias("required"),
        (F.col("l_tax") > 0.01).alias("found"),
        (F.col("l_partkey") % 7 != 0).alias("correct"),
        F.col("l_suppkey").alias("other"),
    )


FIELDS_SQL = """fields AS (
  SELECT l_orderkey AS image, l_linenumber AS field, CASE l_linenumber % 3 WHEN 0 THEN 'numeric' WHEN 1 THEN 'text' ELSE 'address' END AS kind,
    round(0.99 - l_discount * 4, 2) AS confidence, l_returnflag <> 'R' AS valid, l_linestatus = 'F' AS verified, l_linenumber = 1 AS core,
    l_linenumber <= 3 AS required, l_tax > 0.01 AS found, l_partkey % 7 <> 0 AS correct, l_suppkey AS other FROM lineitem),
acc AS (
  SELECT *, valid AND confidence >= CASE WHEN verified THEN 0.60 WHEN kind = 'numeric' THEN 0.90 WHEN kind = 'text' THEN 0.85 ELSE 0.80 END AS accepted FROM fields),
verdict AS (
  SELECT image, CASE WHEN NOT coalesce(bool_and(accepted) FILTER (core), true) THEN 'FAIL' WHEN coalesce(bool_and(accepted) FILTER (required), true) THEN 'OK' ELSE 'PARTIAL' END AS status,
    count(*) FILTER (accepted) AS n_accepted, avg(confidence) AS mean_confidence, bool_and(correct) AS all_correct FROM acc GROUP BY image)"""


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    red = text.redact("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce(red, F.lit(""))).alias("redacted_md5"), F.coalesce(red != F.col("text"), F.lit(False)).alias("changed"))


def verdict_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = decide.accepted(_fields(spark, sf_dir))
    verdicts = decide.verdicts(fields, ["image"]).join(fields.groupBy("image").agg(F.bool_and("correct").alias("all_correct")), "image")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), F.col("o_orderpriority").alias("condition"))
    out = evaluate.group_report(verdicts.join(orders, "image"), ["condition"])
    return out.select("condition", "n", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decide.verdicts(decide.accepted(_fields(spark, sf_dir)), ["image"])
    return out.withColumn("mean_confidence", F.round("mean_confidence", 6))


def field_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = decide.accepted(_fields(spark, sf_dir)).withColumn("cer", F.col("other") % 5 / 5)
    out = evaluate.field_report(fields, ["field"])
    return out.select("field", "n", *[F.round(c, 6).alias(c) for c in out.columns[2:-1]], "false_accepts")


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.calibration(_fields(spark, sf_dir).where("found"), aim=0.857)
    return out.select("kind", F.round("threshold", 2).alias("threshold"), "n", F.round("precision", 6).alias("precision"), F.round("coverage", 6).alias("coverage"), "recommended")


def error_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.examples(_fields(spark, sf_dir), ["field"], ["image"]).select("field", "image", "k")


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("ms", F.floor(F.abs("value") * 10).cast("long"))
    return evaluate.latency(events, ["event_type"], "ms")


def best_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_partkey") % 11 == 0, "OK").when(F.col("l_partkey") % 3 == 0, "PARTIAL").otherwise("FAIL")
    tries = lines.select(F.col("l_orderkey").alias("image"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("position"), status.alias("status"), (F.col("l_suppkey") % 4).alias("n_accepted"), F.when(F.col("l_partkey") % 4 > 0, F.round(F.col("l_discount") * 30)).alias("mean_confidence"), (F.col("l_suppkey") % 3 > 0).alias("known"))
    return decide.best_attempts(tries, "image", "position", "known").select("image", "position", "status", "passes")


def cer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = F.concat(F.translate("c_name", "05", "O"), F.lit("  "), F.substring("c_mktsegment", 1, 2))
    rows = table(spark, sf_dir, "customer").select("c_custkey", evaluate.cer(read, F.concat("c_name", F.lit(" "), F.substring("c_mktsegment", 1, 3))).alias("cer"))
    return rows.withColumn("cer", F.round("cer", 6))


def nearest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("candidate"))
    words = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    words = words.select(F.concat(F.substring("n_name", 1, 2), F.when(F.col("s_suppkey") % 2 == 0, F.substring("n_name", 4, 30)).otherwise(F.concat(F.lit("X"), F.substring("n_name", 4, 30)))).alias("word"))
    return decide.nearest(words, nations, 2)


def rrn_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers made of customer keys, read from a noisy line and validated."""
    key = F.col("c_custkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    front = F.concat(pad(key % 100, 2), pad(key % 13, 2), pad(key % 31, 2))
    line = F.concat(F.lit("주민 "), front, F.lit(" - "), (key % 10).cast("string"), pad(key * 7919 % 1_000_000, 6), F.lit("번"))
    hit = text.find_rrns(line)
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.try_element_at(hit, F.lit(1)).alias("r"))
    part = [F.col(f"r.{c}") for c in ("front", "sex", "back")]
    return rows.select("c_custkey", text.rrn_formatted(*part).alias("rrn"), text.rrn_checksum_ok(*part).alias("checksum_ok"), text.rrn_birth(*part[:2]).cast("string").alias("birth"), text.rrn_is_valid(part[0], part[1], F.lit(TODAY).cast("date")).alias("valid"), text.rrn_derived(*part[:2])["gender"].alias("gender"), text.rrn_derived(*part[:2])["is_foreigner"].alias("is_foreigner"))


def order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders with different signs between their parts, the day of every fifth made the 31st, and issuers after them that are whole or cut off."""
    key = F.col("o_orderkey")
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))
    sign, day = pick(". ", "-", "/", " . "), F.when(key % 5 == 0, "31").otherwise(F.date_format("o_orderdate", "d"))
    line = F.concat(F.date_format("o_orderdate", "yyyy"), sign, F.date_format("o_orderdate", "M"), sign, day, pick(".", " "), pick("서울특별시장", "가람구청", "다솔군"))
    # a text that several expressions read is made once
    own = table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))
    found = F.try_element_at(text.find_dates("line"), F.lit(1))
    return own.select("o_orderkey", found["value"].cast("string").alias("iso"), text.repair_issuer(text.text_after_numbers("line"))["value"].alias("issuer"))


def license_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    line = F.concat(F.lit("번호 "), pad(key % 30, 2), F.lit("-"), pad(key % 100, 2), F.lit("-"), pad(key * 31 % 1_000_000, 6), F.lit(" - "), F.when(key % 5 == 0, F.lit("XX")).otherwise(pad(key % 97, 2)))
    number = F.try_element_at(text.find_license_numbers("line"), F.lit(1))
    own = table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line")).select("o_orderkey", number.alias("number"))
    number = F.col("number")
    return own.select("o_orderkey", text.license_formatted(number).alias("number"), text.license_is_masked(number).alias("masked"), text.license_number_is_valid(number).alias("valid"))


def serial_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = text.find_serial_code(F.concat(F.substring(F.upper(F.md5(F.col("p_partkey").cast("string"))), 1, 3), F.lit(" "), F.substring(F.upper(F.md5(F.col("p_partkey").cast("string"))), 4, 3)))
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code"), text.has_lookalike(code).alias("has_lookalike"), F.size(text.serial_alternatives(code)).cast("long").alias("n_alternatives"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("l_partkey") % 40 * 10).cast("double"), (F.col("l_suppkey") % 20 * 8).cast("double")
    w, h = (F.col("l_quantity") + 30).cast("double"), (F.col("l_linenumber") * 3 + 10).cast("double")
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    box = F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_linenumber") * 100 + F.col("l_quantity")).cast("long").alias("idx"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("text"), F.col("l_tax").alias("score"), box.alias("box"))


LINES_SQL = """lines AS (
  SELECT l_orderkey AS image, CAST(l_linenumber * 100 + l_quantity AS BIGINT) AS idx, CAST(l_partkey % 40 * 10 AS DOUBLE) AS x0, CAST(l_partkey % 40 * 10 + l_quantity + 30 AS DOUBLE) AS x1,
    CAST(l_suppkey % 20 * 8 AS DOUBLE) AS y0, CAST(l_suppkey % 20 * 8 + l_linenumber * 3 + 10 AS DOUBLE) AS y1, CAST(l_linenumber * 3 + 10 AS DOUBLE) AS h FROM lineitem),
cl AS (SELECT *, (y0 + y1) / 2 AS cy FROM lines)"""


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(layout.bounds(_lines(spark, sf_dir))).select("image", "idx", "x0", "x1", "y0", "y1", F.col("place").cast("long").alias("place"))


def row_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per image: pairs of lines in a row and pairs where one is below the other. An image has a handful of lines."""
    own = layout.bounds(_lines(spark, sf_dir))
    a, b = own.alias("a"), own.alias("b")
    both = a.join(b, (F.col("a.image") == F.col("b.image")) & (F.col("a.idx") != F.col("b.idx")))
    return both.groupBy(F.col("a.image").alias("image")).agg(F.count_if(layout.same_row("a", "b")).alias("same_row"), F.count_if(layout.is_below("a", "b")).alias("below"))


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = layout.rows(layout.bounds(_lines(spark, sf_dir)))
    return own.withColumns({"row": F.col("row").cast("long"), "idxs": F.array_join(F.col("idxs").cast("array<string>"), ",")})


def page_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.page_shape(layout.bounds(_lines(spark, sf_dir)))


def _syllable(code) -> DataFrame:
    return F.decode(F.unhex(F.lpad(F.hex(code + 0xAC00), 4, "0")), "UTF-16BE")


def jamo_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of two words of two syllables made of each customer's key; the second has one letter or a whole syllable changed, or none."""
    key = F.col("c_custkey")
    first, second = key * 7919 % 11172, key * 104729 % 11172
    changed = F.when(key % 4 == 0, second).when(key % 4 == 1, F.floor(second / 28) * 28 + (second + 1) % 28).when(key % 4 == 2, (second + 588) % 11172).otherwise(key * 31 % 11172).cast("long")
    words = table(spark, sf_dir, "customer").select("c_custkey", F.concat(_syllable(first), _syllable(second)).alias("a"), F.concat(_syllable(first), _syllable(changed)).alias("b"))
    return words.select("c_custkey", jamo.jamo_distance(F.col("a"), F.col("b")).cast("long").alias("distance"))


def document_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of documents made of orders: a title in full or with a letter wrong, in another text, in English, or none."""
    titles = ["주민등록증", "x 주민등록중 1", "자동차운전면허증", "운전면허증 1종", "Driver's License", "여권", ""]
    key = F.col("o_orderkey")
    lines = table(spark, sf_dir, "orders").select(key.alias("image"), F.lit(0).alias("idx"), F.element_at(F.array(*map(F.lit, titles)), (key % 7 + 1).cast("int")).alias("text"))
    return classify.document_types(lines)


def police_offices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Police offices made of suppliers, snapped to the closed list: exact, spaced, with a letter wrong, or none."""
    said = ["서울지방경찰청장", "부산 경찰청장", "경기남부경찰청잠", "동장"]
    own = table(spark, sf_dir, "supplier").select("s_suppkey", classify.snap_to_list(F.element_at(F.array(*map(F.lit, said)), (F.col("s_suppkey") % 4 + 1).cast("int")), text.POLICE_ISSUERS).alias("s"))
    return own.select("s_suppkey", F.col("s.value").alias("value"), F.col("s.changed").alias("changed"))


def line_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angle of each order's lines, made of part keys as slopes."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    rise = (F.col("l_partkey") % 21 - 10).cast("double")
    w = F.col("l_quantity") * 4
    box = F.array(point(F.lit(0), F.lit(0)), point(w, rise), point(w, rise + 20), point(F.lit(0), F.lit(20)))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("text"), box.alias("box"))
    return layout.text_angle(lines).withColumn("angle", F.round("angle", 9))


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(fields, images) of resident cards made of orders: five fields with confidences and validity from the order's numbers, some left out."""
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    names = ["name", "rrn", "address", "issue_date", "issuer"]
    confidence = lambda i: F.lit(0.99) - ((key * (7 + i)) % 23) / 100
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    warning = lambda n: F.when(F.lit(n == "rrn") & (key % 6 == 0), F.array(F.lit("CHECKSUM_MISMATCH:rrn"))).otherwise(F.array().cast("array<string>"))
    value = lambda n: F.concat(F.lit(f"{n} "), (key % 100).cast("string"), F.lit("-1234567"))
    rows = [F.struct(F.lit(n).alias("field"), value(n).alias("value"), confidence(i).cast("double").alias("confidence"), ((key + i) % 9 != 0).alias("valid"), (F.lit(n == "rrn") & (key % 2 == 0)).alias("verified"), warning(n).alias("warnings"), none.alias("boxes"), F.create_map().cast("map<string,string>").alias("derived"), ((key + i) % 8 != 0).alias("there")) for i, n in enumerate(names)]
    fields = orders.select(key.alias("image"), F.inline(F.array(*rows))).where("there").drop("there")
    kind = F.when(key % 17 == 0, "UNKNOWN").otherwise("RESIDENT_CARD")
    images = orders.select(key.alias("image"), kind.alias("document_type"), (key % 13).alias("n_lines"), (key % 19 != 0).alias("decoded"), F.col("o_orderpriority").alias("condition"), (key % 700).alias("elapsed_ms"))
    return decide.strict_checksum(fields), images


RESULTS_SQL = """f AS (
  SELECT o_orderkey AS k, n AS field, n || ' ' || CAST(o_orderkey % 100 AS VARCHAR) || '-1234567' AS value, 0.99 - ((o_orderkey * (7 + i)) % 23) / 100 AS confidence,
    (o_orderkey + i) % 9 <> 0 AND NOT (n = 'rrn' AND o_orderkey % 6 = 0) AS valid, n = 'rrn' AND o_orderkey % 2 = 0 AS verified, i
  FROM orders, (VALUES (0, 'name', 0.85), (1, 'rrn', 0.9), (2, 'address', 0.8), (3, 'issue_date', 0.9), (4, 'issuer', 0.85)) AS s(i, n, least) WHERE (o_orderkey + i) % 8 <> 0),
a AS (SELECT *, valid AND confidence >= CASE WHEN verified THEN 0.6 WHEN field IN ('rrn', 'issue_date') THEN 0.9 WHEN field = 'address' THEN 0.8 ELSE 0.85 END AS accepted FROM f),
g AS (SELECT k, count(*) FILTER (accepted AND field IN ('name', 'rrn')) AS n_core, count(*) FILTER (accepted) AS n_all, max(value) FILTER (field = 'rrn') AS rrn, bool_or(field = 'rrn') AS has_rrn FROM a GROUP BY k),
res AS (
  SELECT o_orderkey AS image, CASE WHEN o_orderkey % 19 = 0 THEN 'IMAGE_DECODE_ERROR' WHEN o_orderkey % 13 = 0 THEN 'NO_TEXT' WHEN o_orderkey % 17 = 0 THEN 'UNSUPPORTED_DOCUMENT' WHEN coalesce(n_core, 0) < 2 THEN 'LOW_CONFIDENCE' END AS fail_reason,
    coalesce(n_all, 0) AS n_all, rrn, coalesce(has_rrn, false) AS has_rrn, o_orderpriority AS condition, o_orderkey % 700 AS elapsed_ms FROM orders LEFT JOIN g ON k = o_orderkey),
st AS (SELECT *, CASE WHEN fail_reason IS NOT NULL THEN 'FAIL' WHEN n_all = 5 THEN 'OK' ELSE 'PARTIAL' END AS status, fail_reason IS NULL OR fail_reason = 'LOW_CONFIDENCE' AS read FROM res)"""


def card_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decide.assemble(*_results(spark, sf_dir), mask=True)
    return out.select("image", "status", "fail_reason", F.col("fields")["rrn"].alias("rrn"), F.size("fields").cast("long").alias("n_fields"), F.array_join("warnings", "|").alias("warnings"))


def card_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of cards made of orders as JSON."""
    return decide.documents(decide.assemble(*_results(spark, sf_dir), mask=True), {"name": "none"})


def _scored(spark: SparkSession, sf_dir: str, held: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scores, images) of the cards made of orders; held writes the results out, for reports that use them several times."""
    fields, images = _results(spark, sf_dir)
    results = decide.assemble(fields, images).select("image", "document_type", "status", "fields", "field_meta")
    results = stored(results, "results") if held else results
    key = F.col("o_orderkey")
    right = lambda n, i: F.concat(F.lit(n), ((key + F.when((key + i) % 5 == 0, 1).otherwise(0)) % 100).cast("string"), F.lit("-1234567"))
    entries = [x for i, n in enumerate(["name", "rrn", "address", "issue_date", "issuer"]) for x in (F.lit(n), right(n, i))]
    truth = table(spark, sf_dir, "orders").select(key.alias("image"), F.lit("RESIDENT_CARD").alias("document_type"), F.create_map(*entries).alias("fields"))
    return evaluate.scored(truth, results), results.join(growing(images.select("image", "condition", "elapsed_ms")), "image")


SCORED_SQL = RESULTS_SQL + """, sc AS (
  SELECT st.image, s.field, s.i, condition, st.status, elapsed_ms, a.value AS pred, s.field || CAST((image + CASE WHEN (image + s.i) % 5 = 0 THEN 1 ELSE 0 END) % 100 AS VARCHAR) || '-1234567' AS gt, image % 17 <> 0 AS same, read
  FROM st, (VALUES (0, 'name'), (1, 'rrn'), (2, 'address'), (3, 'issue_date'), (4, 'issuer')) AS s(i, field) LEFT JOIN a ON a.k = st.image AND a.field = s.field),
sd AS (SELECT *, CASE WHEN read THEN pred END AS p FROM sc),
se AS (SELECT *, CASE WHEN same THEN replace(coalesce(p, ''), ' ', '') = gt END AS correct FROM sd)"""


LEVELS_SQL = SCORED_SQL + """, lf AS (
  SELECT se.*, a.accepted AND read AS taken, o_orderstatus FROM se JOIN orders ON o_orderkey = se.image LEFT JOIN a ON a.k = se.image AND a.field = se.field),
li AS (
  SELECT image, any_value(o_orderstatus) AS document_type, any_value(condition) AS condition, any_value(status) AS status, any_value(elapsed_ms) AS ms, bool_and(coalesce(correct, false)) AS every, bool_and(coalesce(correct, false)) FILTER (field IN ('name', 'rrn')) AS core,
    bool_or(same AND coalesce(taken, false) AND NOT coalesce(correct, false)) AS wrong FROM lf GROUP BY image),
lv AS (
  SELECT document_type, condition, grouping(condition) = 0 AS by_condition, count(*) AS n, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status = 'PARTIAL') AS partial, count(*) FILTER (status = 'FAIL') AS fail, count(*) FILTER (every) AS all_correct, count(*) FILTER (core) AS core_correct,
    count(*) FILTER (status = 'OK' AND wrong) AS ok_wrong, count(*) FILTER (image % 4 = 0) AS other_type, median(ms) AS p50 FROM li GROUP BY GROUPING SETS ((document_type, condition), (document_type)))"""


def truth_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)[0].select("image", "field", "found", "correct", F.round("cer", 6).alias("cer"))


def condition_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields, images = _scored(spark, sf_dir)
    out = evaluate.condition_report(images, fields, ["condition"])
    return out.withColumns({c: F.round(c, 6) for c in ("share_ok", "core_correct", "all_correct")})


def _levels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    fields, images = _scored(spark, sf_dir, held=True)
    kinds = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), F.col("o_orderstatus").alias("kind"))
    own = images.join(growing(kinds), "image").select("image", F.col("kind").alias("document_type"), "condition", F.when(F.col("image") % 4 > 0, F.col("kind")).alias("predicted_type"), "status", "elapsed_ms")
    return evaluate.level_report(own, fields), evaluate.field_report(fields.drop("document_type").join(growing(kinds.withColumnRenamed("kind", "document_type")), "image"), ["document_type", "field"])


def report_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports on orders by status, and by status and priority, in one aggregation."""
    return _levels(spark, sf_dir)[0]


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.markdown(*_levels(spark, sf_dir))


def calibration_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.calibration_report(_fields(spark, sf_dir).where("found"), aim=0.8571)
    return out.select("kind", F.round("threshold", 2).alias("threshold"), "n", F.round("precision", 6).alias("precision"), F.round("coverage", 6).alias("coverage"), "recommended")


def document_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces, ratios and colours made of line items, judged."""
    key, part = F.col("l_orderkey"), F.col("l_partkey")
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    x0, h = (part % 200).cast("double"), F.col("l_quantity") * 3
    faces = F.when(part % 5 > 0, F.array(F.struct(x0.alias("x0"), F.lit(0.0).alias("y0"), (x0 + 40).alias("x1"), h.alias("y1"), F.col("l_tax").alias("score")))).otherwise(F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double,score:double>>"))
    box = F.when(key % 7 > 0, F.array(point(100, 10), point(150, 10), point(150, 20), point(100, 20)))
    kind = F.when(key % 2 == 0, "RESIDENT_CARD").otherwise("DRIVER_LICENSE")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("document_type"), box.alias("rrn_box"), faces.alias("faces"), (part % 11 > 0).alias("detector"), F.when(part % 3 > 0, F.lit(1.3) + F.col("l_discount") * 6).alias("ratio"), F.when(part % 4 == 0, "frame").otherwise("contour").alias("method"), F.when(part % 6 > 0, F.col("l_quantity")).alias("colour"), (F.col("l_discount") * 8).alias("clipped"))
    out = decide.document_checks(rows)
    return out.select("l_orderkey", "l_linenumber", F.col("face.ok").alias("face_ok"), F.array_join("reasons", "|").alias("reasons"), F.array_join("inconclusive", "|").alias("inconclusive"), "suspicious")


def license_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of licence made of part keys, half of them with a letter wrong."""
    key = F.col("p_partkey")
    kind = F.when(key % 3 == 0, "보통").when(key % 3 == 1, "보퉁").otherwise("대형")
    line = F.concat((key % 2 + 1).cast("string"), F.lit(" 종 "), kind, F.lit(" 소형 특수(구난,소형견인) 원동기"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.find_license_types(line), "|").alias("kinds"))


def address_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made of customer keys: province, city or district misread, a space lost, province unreadable; all can be set right."""
    provinces = spark.createDataFrame([(p,) for p in text.PROVINCES], "province string")
    pairs = [("서울특별시", "송파구"), ("서울특별시", "종로구"), ("서울특별시", "중구"), ("부산광역시", "중구"), ("경기도", "성남시"), ("경기도", "분당구")]
    districts = spark.createDataFrame(pairs, "province string, district string")
    read = ["서울특별지 송파규 올림픽로1", "서올특벌지 종로구 은천로93", "경기도 성남시 분당규 정자로 12", "서울시 중구 세종대로 1(정동)"]
    key = F.col("c_custkey")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    province, district, place = pick(["서울특별시", "서울특별시", "경기도"], key), pick(["송파구", "종로구", "성남시"], key), key % 8
    made = F.concat(F.when(place == 5, F.translate(province, "시도", "세토")).otherwise(province), F.lit(" "), F.when(place == 6, F.translate(district, "구시", "규세")).otherwise(district), F.lit(" 중앙로"), F.when(place == 7, "").otherwise(" "), (key % 300).cast("string"))
    own = table(spark, sf_dir, "customer").select(key.alias("id"), F.when(place < 4, pick(read, key)).otherwise(made).alias("address"))
    out = address.correct(own, provinces, districts, spark.createDataFrame([("올림픽로",), ("은전로",)], "word string"))
    return out.select("id", "corrected", F.size("changed").cast("long").alias("n_changed"), "valid")


def resident_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of customers as lines, the number of every third in two boxes, read back as fields."""
    key, pad = F.col("c_custkey"), lambda c: F.lpad(c.cast("string"), 6, "0")
    front = F.concat(F.lpad((key % 90 + 10).cast("string"), 2, "0"), F.lpad((key % 12 + 1).cast("string"), 2, "0"), F.lit("15"))
    back = F.concat(F.lit("1"), pad(key * 7919 % 1_000_000))
    day = F.concat_ws(".", (key % 20 + 2000).cast("string"), (key % 12 + 1).cast("string"), (key % 28 + 1).cast("string"))
    split = key % 3 == 0
    row = lambda text_, x, y, w: F.struct(text_.alias("text"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(float(w)).alias("w"))
    first = row(F.when(split, front).otherwise(F.concat(front, F.lit("-"), back)), 10, 100, 80)
    address, issuer = [F.lit("서울특별시 종로규"), F.concat(F.lit("세종대로"), (key % 300).cast("string"))], F.concat(F.lit("서울특별시 종로구"), F.when(key % 2 == 0, "청").otherwise("청장"))
    said = F.array(row(F.lit("주민등록중"), 20, 0, 80), row(F.lit("홍길동(洪吉童)"), 12, 50, 60), first, row(F.when(split, F.concat(F.lit("-"), back)), 100, 101, 60), row(address[0], 10, 130, 90), row(address[1], 12, 155, 70), row(day, 40, 200, 50), row(issuer, 40, 230, 90))
    # one card in five lies askew by four degrees
    turn = F.when(key % 5 == 0, 0.0698).otherwise(0.0)
    point = lambda x, y: F.struct((x * F.cos(turn) - y * F.sin(turn)).alias("x"), (x * F.sin(turn) + y * F.cos(turn)).alias("y"))
    x, y, w = F.col("l.x"), F.col("l.y"), F.col("l.w")
    own = spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(key.alias("image"), turn.alias("turn"), F.posexplode(said).alias("idx", "l"))
    turn = F.col("turn")
    box = F.array(point(x, y), point(x + w, y), point(x + w, y + 20), point(x, y + 20))
    # some numbers have characters, the third of which is unsure
    sure = lambda c, i: F.struct(c.alias("text"), F.when(i == 2, 0.7).otherwise(0.95).alias("score"), F.lit(None).cast("array<struct<x:double,y:double>>").alias("box"))
    chars = F.when((F.col("image") % 4 == 0) & (F.col("image") % 3 != 0) & (F.col("idx") == 2), F.transform(F.split("l.text", ""), sure))
    lines = own.select("image", "idx", F.col("l.text").alias("text"), F.lit(0.9).alias("score"), box.alias("box"), chars.alias("chars")).where("text IS NOT NULL")
    districts = spark.createDataFrame([("서울특별시", "종로구"), ("서울특별시", "중구")], "province string, district string")
    dictionary = {"provinces": districts.select("province").distinct(), "districts": districts}
    out = extract.resident_fields(lines, classify.title_lines(lines, classify.RESIDENT), F.lit(TODAY).cast("date"), dictionary)
    return out.select("image", "field", "value", "confidence", F.array_join("warnings", "|").alias("warnings"))


def license_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of suppliers as lines, kinds in one or two lines, read back as fields."""
    key, pad = F.col("s_suppkey"), lambda c, n: F.lpad(c.cast("string"), n, "0")
    number = F.concat(F.lit("11-"), pad(key % 90 + 10, 2), F.lit("-"), pad(key * 7919 % 1_000_000, 6), F.lit("-61"))
    rrn = F.concat(F.lit("80"), pad(key % 12 + 1, 2), F.lit("15-1"), pad(key * 7907 % 1_000_000, 6))
    begin = F.concat(F.lit("2025."), (key % 12 + 1).cast("string"), F.lit(".1"))
    row = lambda text_, x, y, w: F.struct(text_.alias("text"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(float(w)).alias("w"))
    said = [(F.lit("1종보통"), 10, 30, 60), (F.when(key % 2 == 0, "원동기"), 10, 60, 60), (number, 200, 60, 150), (F.lit("홍길동"), 200, 90, 60), (rrn, 200, 120, 140), (F.lit("적성검사기간"), 200, 190, 100), (begin, 310, 190, 70), (F.lit("~2025.12.31"), 310, 215, 70), (F.when(key % 5 == 0, "조건: A,B"), 200, 250, 60), (F.lit("ABCDE7"), 420, 230, 60), (F.concat(F.lit("경기도 성남시 정자로"), (key % 90 + 1).cast("string")), 200, 150, 180), (F.concat(F.lit("2015.3."), (key % 28 + 1).cast("string")), 220, 300, 70), (F.when(key % 2 == 0, "경기남부경찰청잠").otherwise("경기남부 경찰청장"), 300, 300, 120)]
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w = F.col("l.x"), F.col("l.y"), F.col("l.w")
    box = F.array(point(x, y), point(x + w, y), point(x + w, y + 20), point(x, y + 20))
    own = table(spark, sf_dir, "supplier").select(key.alias("image"), F.posexplode(F.array(*[row(*s) for s in said])).alias("idx", "l"))
    chars = F.lit(None).cast("array<struct<text:string,score:double,box:array<struct<x:double,y:double>>>>")
    lines = own.select("image", "idx", F.col("l.text").alias("text"), F.lit(0.9).alias("score"), box.alias("box"), chars.alias("chars")).where("text IS NOT NULL")
    out = extract.license_fields(lines, classify.title_lines(lines, classify.LICENSE), F.lit(TODAY).cast("date"))
    return out.select("image", "field", "value", "valid")


def number_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decide.accepted(_fields(spark, sf_dir)).withColumn("correct", F.col("found") & F.col("correct")).withColumn("warned", F.col("other") % 3 == 0)
    out = evaluate.number_safety(rows, ["kind"])
    return out.withColumns({c: F.round(c, 6) for c in ("found_rate", "correct_rate")})


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals made of line items: reasons follow from part, supplier and quantity."""
    codes = list(evaluate.REASONS.values())
    reasons = F.array_compact(F.array(F.when(F.col("l_partkey") % 3 == 0, codes[0]), F.when(F.col("l_suppkey") % 4 == 0, codes[1]), F.when(F.col("l_quantity") > 40, codes[2])))
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", F.when(F.col("l_returnflag") == "A", "OK").otherwise("FAIL").alias("status"), F.when(F.col("l_linenumber") > 1, reasons).alias("reasons"))
    return evaluate.signal_report(rows, ["l_linestatus"])


def signal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _signals(spark, sf_dir)
    return out.withColumns({c: F.round(c, 6) for c in out.columns[2:]})


def signal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.signal_markdown(_signals(spark, sf_dir), missed_signals(spark, sf_dir), ["l_linestatus"])


def attempt_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Further attempts at images made of orders, whose first attempt looks upright or not, of a known kind or not, or wasn't measured."""
    key = F.col("o_orderkey")
    looks = [F.when(key % 11 > 0, key % 5 == 0), key % 3 == 0, F.when(key % 7 > 0, key % 2 == 0)]
    return table(spark, sf_dir, "orders").select(key.alias("image"), F.array_join(decide.attempt_order(*looks), "|").alias("passes"))


def turned_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of line items found on pictures that were turned and scaled, back in the upright picture's coordinates."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    box = F.array(point(F.col("l_partkey") % 640, F.col("l_suppkey") % 480), point(F.col("l_partkey") % 640 + F.col("l_quantity"), F.col("l_suppkey") % 480 + F.col("l_linenumber")))
    back = layout.turned_back(box, F.col("l_linenumber") % 4 * 90, F.lit(700), F.lit(500), F.when(F.col("l_orderkey") % 2 == 0, 0.5).otherwise(2.0))
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", back.alias("b"))
    return own.select("l_orderkey", "l_linenumber", *[F.col("b")[i][k].alias(f"{k}{i}") for i in (0, 1) for k in "xy"])


def missed_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fakes that passed and genuine cards that didn't, made of line items."""
    reasons = F.when(F.col("l_partkey") % 5 > 0, F.array_compact(F.array(F.when(F.col("l_quantity") > 40, "CARD_ASPECT"))))
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("image"), F.when(F.col("l_suppkey") % 2 == 0, "fake").otherwise("genuine").alias("label"), F.when(F.col("l_linestatus") == "O", "OK").otherwise("FAIL").alias("status"), reasons.alias("reasons"))
    return evaluate.missed(rows).select("error", "image", F.col("k").cast("long").alias("k"))


ISSUER_ENDS = ["구청장", "구청", "경찰", "경찰청", "시 장", "구청징", "군 수", "군청", "시청", "구", "군", "읍장", "시징", "소장", " 청장"]


def issuer_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issuers made of customers: a province, a place and an ending that is whole, apart, misread, cut off or none."""
    key = F.col("c_custkey")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    said = F.concat(pick(text.PROVINCES, key), F.when(key % 2 == 0, "  ").otherwise(""), pick(["가람", "누리", "다솔"], key), pick(ISSUER_ENDS, F.floor(key / 3)))
    own = table(spark, sf_dir, "customer").select("c_custkey", text.repair_issuer(said).alias("r"))
    return own.select("c_custkey", F.col("r.value").alias("value"), F.col("r.repaired").alias("repaired"), text.issuer_is_valid("r.value").alias("valid"))


def token_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens made of numbers of customers with look-alike letters for some digits, repaired where digits prevail; and the numbers masked."""
    number = F.concat(F.lpad((F.col("c_custkey") * 7919 % 1_000_000).cast("string"), 6, "0"), F.lit("-"), F.lpad((F.col("c_custkey") * 104_729 % 10_000_000).cast("string"), 7, "0"))
    read = F.when(F.col("c_custkey") % 3 == 0, F.translate(number, "0158", "OlSB")).when(F.col("c_custkey") % 3 == 1, F.translate(number, "0123", "DxyZ")).otherwise(number)
    token = F.concat(read, F.left("c_mktsegment", (F.col("c_custkey") % 9).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", text.fix_digits(token).alias("repaired"), text.mask_number(number).alias("masked"))


def address_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made of customers: a province in full, short or none, set apart from what follows; validity; and the district as one name or two."""
    key = F.col("c_custkey")
    names = [*text.PROVINCES, *text.PROVINCE_STEMS, "한양", ""]
    district = F.element_at(F.array(*map(F.lit, ["성남시분당구", "종로구", "수원시", "양평군"])), (key % 4 + 1).cast("int"))
    said = F.concat(F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int")), F.when(key % 3 == 0, " ").otherwise(""), F.when(key % 5 > 0, F.concat(district, F.lit(" "), key.cast("string"))).otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", text.space_after_province(said).alias("spaced"), text.address_is_valid(said).alias("valid"), F.array_join(address.split_district(district), "|").alias("district"))


QUERIES = {f.__name__: f for f in (redact_documents, verdict_report, verdicts, field_report, calibration, error_examples, latency, best_attempts, cer_names, nearest_names, rrn_checks, order_dates, license_numbers, serial_codes, reading_order, row_pairs, line_rows, page_shapes, jamo_distances, license_kinds, address_corrections, resident_fields, license_fields, number_safety, signal_report, signal_lines, document_kinds, police_offices, line_angles, card_results, card_documents, truth_scores, condition_scores, report_levels, report_lines, calibration_choice, document_signals, attempt_orders, turned_boxes, missed_signals, issuer_repairs, token_repairs, address_checks)}
QUERIES |= card_queries.QUERIES | picture_queries.QUERIES


def _letters_sql(n: str) -> str:
    """Letters of the n-th syllable, each as one ASCII sign, since the distance of the SQL engine counts bytes."""
    every = "".join(dict.fromkeys(jamo.INITIALS + jamo.MEDIALS + jamo.FINALS.strip()))
    parts = [(jamo.INITIALS, f"{n} // 588"), (jamo.MEDIALS, f"{n} % 588 // 28"), (jamo.FINALS, f"{n} % 28")]
    signs = [f"CASE WHEN substr('{letters}', CAST({at} + 1 AS INT), 1) = ' ' THEN '' ELSE chr(CAST(47 + instr('{every}', substr('{letters}', CAST({at} + 1 AS INT), 1)) AS INT)) END" for letters, at in parts]
    return " || ".join(signs)


SQL = {
    "redact_documents": r"""SELECT doc_id, md5(coalesce(r, '')) AS redacted_md5, coalesce(r <> text, false) AS changed
      FROM (SELECT doc_id, text, regexp_replace(text, '\p{Nd}(?:[\t\n\x0B\f\r \x{85}\p{Z}\-.]*\p{Nd}){5,}', '[REDACTED]', 'g') AS r FROM documents)""",
    "verdict_report": f"""WITH {FIELDS_SQL}
      SELECT o_orderpriority AS condition, count(*) AS n, round(avg(CAST(status = 'OK' AS INT)), 6) AS share_ok, round(avg(CAST(status = 'PARTIAL' AS INT)), 6) AS share_partial,
        round(avg(CAST(status = 'FAIL' AS INT)), 6) AS share_fail, round(avg(CAST(all_correct AS INT)), 6) AS share_correct, round(avg(CAST(status = 'OK' AND NOT all_correct AS INT)), 6) AS share_ok_wrong
      FROM verdict JOIN orders ON image = o_orderkey GROUP BY 1""",
    "verdicts": f"WITH {FIELDS_SQL} SELECT image, status, n_accepted, round(mean_confidence, 6) AS mean_confidence FROM verdict",
    "field_report": f"""WITH {FIELDS_SQL}
      SELECT field, count(*) AS n, round(avg(CAST(found AS INT)), 6) AS found_rate, round(avg(CAST(correct AS INT)), 6) AS correct_rate, round(avg(other % 5 / 5.0), 6) AS mean_cer,
        round(avg(CAST(accepted AS INT)), 6) AS accept_rate, round(avg(CAST(correct AS INT)) FILTER (accepted), 6) AS accept_precision, count(*) FILTER (accepted AND NOT correct) AS false_accepts
      FROM acc GROUP BY field""",
    "calibration": f"""WITH {FIELDS_SQL},
      f AS (SELECT * FROM fields WHERE found), g AS (
        SELECT kind, t, count(*) FILTER (confidence >= t / 100.0 - 1e-9) AS n, avg(CAST(correct AS INT)) FILTER (confidence >= t / 100.0 - 1e-9) AS p, count(*) AS total
        FROM f, (SELECT unnest(range(50, 100)) AS t) GROUP BY kind, t)
      SELECT kind, round(t / 100.0, 2) AS threshold, n, round(p, 6) AS precision, round(n / total, 6) AS coverage,
        coalesce(t = min(t) FILTER (p >= 0.857) OVER (PARTITION BY kind), false) AS recommended FROM g""",
    "error_examples": f"WITH {FIELDS_SQL} SELECT field, image, k FROM (SELECT field, image, CAST(row_number() OVER (PARTITION BY field ORDER BY image) AS INT) AS k FROM fields WHERE found AND NOT correct) WHERE k <= 4",
    "latency": """WITH v AS (SELECT event_type, CAST(floor(abs(value) * 10) AS BIGINT) AS ms, row_number() OVER (PARTITION BY event_type ORDER BY floor(abs(value) * 10)) - 1 AS i,
        count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
      SELECT event_type, any_value(n) AS n, avg(ms) FILTER (i IN ((n - 1) // 2, n // 2)) AS p50, max(ms) FILTER (i = CAST(floor(0.95 * (n - 1)) AS BIGINT)) AS p95 FROM v GROUP BY event_type""",
    "best_attempts": """WITH t AS (
        SELECT l_orderkey AS image, l_linenumber * 1000000 + l_partkey AS position, CASE WHEN l_partkey % 11 = 0 THEN 'OK' WHEN l_partkey % 3 = 0 THEN 'PARTIAL' ELSE 'FAIL' END AS status, l_suppkey % 4 AS a, CASE WHEN l_partkey % 4 > 0 THEN round(l_discount * 30) ELSE 0 END AS c, l_suppkey % 3 > 0 AS known FROM lineitem),
      s AS (SELECT *, coalesce(max(CAST(status = 'OK' AS INT)) OVER (PARTITION BY image ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM t),
      r AS (SELECT *, count(*) OVER (PARTITION BY image) AS passes, row_number() OVER (PARTITION BY image ORDER BY CASE status WHEN 'OK' THEN 3 WHEN 'PARTIAL' THEN 2 ELSE 1 END DESC, a DESC, c DESC, known DESC, position) AS k FROM s WHERE stopped = 0)
      SELECT image, position, status, passes FROM r WHERE k = 1""",
    "cer_names": """WITH v AS (SELECT c_custkey, replace(translate(c_name, '05', 'O') || substr(c_mktsegment, 1, 2), ' ', '') AS p, replace(c_name || substr(c_mktsegment, 1, 3), ' ', '') AS t FROM customer)
      SELECT c_custkey, round(least(1.0, levenshtein(p, t) / CAST(length(t) AS DOUBLE)), 6) AS cer FROM v""",
    "nearest_names": """WITH w AS (
        SELECT DISTINCT substr(n_name, 1, 2) || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'X' END || substr(n_name, 4) AS word FROM supplier JOIN nation ON s_nationkey = n_nationkey),
      d AS (SELECT word, n_name, levenshtein(word, n_name) AS d FROM w JOIN (SELECT DISTINCT n_name FROM nation) ON abs(length(word) - length(n_name)) <= 1),
      b AS (SELECT word, n_name, count(*) OVER (PARTITION BY word) AS ties FROM (SELECT *, min(d) OVER (PARTITION BY word) AS low FROM d WHERE d <= 2) WHERE d = low)
      SELECT DISTINCT w.word, CASE WHEN ties = 1 THEN n_name END AS found FROM w LEFT JOIN b ON w.word = b.word""",
    "rrn_checks": f"""WITH v AS (SELECT c_custkey, lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 13 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 31 AS VARCHAR), 2, '0') AS f,
        CAST(c_custkey % 10 AS VARCHAR) AS s, lpad(CAST(c_custkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS b FROM customer),
      n AS (SELECT *, f || s || b AS a, TRY_CAST((CASE WHEN s IN ('1', '2', '5', '6') THEN '19' WHEN s IN ('9', '0') THEN '18' ELSE '20' END) || substr(f, 1, 2) || '-' || substr(f, 3, 2) || '-' || substr(f, 5, 2) AS DATE) AS d FROM v)
      SELECT c_custkey, f || '-' || s || b AS rrn, (11 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr(a, i, 1) AS INT) * (2 + (i - 1) % 8))) % 11) % 10 = CAST(substr(a, 13, 1) AS INT) AS checksum_ok,
        CAST(d AS VARCHAR) AS birth, coalesce(s NOT IN ('9', '0') AND d <= DATE '{TODAY}' AND year(DATE '{TODAY}') - year(d) <= 120, false) AS valid,
        CASE WHEN CAST(s AS INT) % 2 = 1 THEN 'M' ELSE 'F' END AS gender, CAST(s AS INT) BETWEEN 5 AND 8 AS is_foreigner FROM n""",
    "order_dates": """SELECT o_orderkey, CAST(try_cast(strftime(o_orderdate, '%Y-%m-') || CASE WHEN o_orderkey % 5 = 0 THEN '31' ELSE strftime(o_orderdate, '%d') END AS DATE) AS VARCHAR) AS iso,
        CASE o_orderkey % 3 WHEN 0 THEN '서울특별시' || '장' WHEN 1 THEN '가람구' || '청장' ELSE '다솔군' || '수' END AS issuer FROM orders""",
    "license_numbers": """SELECT o_orderkey, lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey * 31 % 1000000 AS VARCHAR), 6, '0') || '-'
        || CASE WHEN o_orderkey % 5 = 0 THEN 'XX' ELSE lpad(CAST(o_orderkey % 97 AS VARCHAR), 2, '0') END AS number, o_orderkey % 5 = 0 AS masked, o_orderkey % 30 BETWEEN 11 AND 28 AND o_orderkey % 30 <> 27 AS valid FROM orders""",
    "serial_codes": """WITH c AS (SELECT p_partkey, substr(upper(md5(CAST(p_partkey AS VARCHAR))), 1, 6) AS code FROM part),
      k AS (SELECT *, length(regexp_replace(code, '[^0OQ]', '', 'g')) AS a, length(regexp_replace(code, '[^1I]', '', 'g')) AS b FROM c)
      SELECT p_partkey, code, a + b > 0 AS has_lookalike, CAST(CASE WHEN pow(3, a) * pow(2, b) - 1 <= 16 THEN pow(3, a) * pow(2, b) - 1 ELSE 0 END AS BIGINT) AS n_alternatives FROM k""",
    "reading_order": f"WITH {LINES_SQL} SELECT image, idx, x0, x1, y0, y1, row_number() OVER (PARTITION BY image ORDER BY y0, x0, idx) AS place FROM cl",
    "row_pairs": f"""WITH {LINES_SQL} SELECT a.image, count(*) FILTER (abs(a.cy - b.cy) <= 0.5 * least(a.h, b.h)) AS same_row, count(*) FILTER (a.cy > b.cy + 0.5 * least(a.h, b.h)) AS below
      FROM cl a JOIN cl b ON a.image = b.image AND a.idx <> b.idx GROUP BY a.image""",
    "page_shapes": f"""WITH {LINES_SQL} SELECT image, list_sort(list(cy))[len(list(cy)) // 2 + 1] AS middle, 2 * count(*) FILTER (h > 1.5 * (x1 - x0)) > count(*) AS vertical FROM cl GROUP BY image""",
    "license_kinds": """SELECT p_partkey, g || '종' || CASE WHEN p_partkey % 3 = 2 THEN '대형' ELSE '보통' END || '|' || g || '종소형|1종특수(구난)|1종특수(소형견인)|2종원동기' AS kinds
      FROM (SELECT p_partkey, CAST(p_partkey % 2 + 1 AS VARCHAR) AS g FROM part)""",
    "address_corrections": """SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN '서울특별시 송파구 올림픽로 1' WHEN 1 THEN '서울특별시 종로구 은전로 93' WHEN 2 THEN '경기도 성남시 분당구 정자로 12' WHEN 3 THEN '서울시 중구 세종대로 1 (정동)'
        ELSE (['서울특별시 송파구', '서울특별시 종로구', '경기도 성남시'])[c_custkey % 3 + 1] || ' 중앙로 ' || c_custkey % 300 END AS corrected,
      CAST(CASE WHEN c_custkey % 8 IN (0, 1) THEN 2 WHEN c_custkey % 8 IN (2, 5, 6) THEN 1 ELSE 0 END AS BIGINT) AS n_changed, true AS valid FROM customer""",
    "resident_fields": """WITH c AS (SELECT c_custkey AS image, lpad(CAST(c_custkey % 90 + 10 AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || '15-1' || lpad(CAST(c_custkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS rrn,
        CAST(make_date(c_custkey % 20 + 2000, c_custkey % 12 + 1, c_custkey % 28 + 1) AS VARCHAR) AS day FROM customer)
      , n AS (SELECT c.*, image % 2 AS odd, CAST(image % 300 AS VARCHAR) AS house, replace(rrn, '-', '') AS d FROM c),
      m AS (SELECT *, (11 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr(d, i, 1) AS INT) * (2 + (i - 1) % 8))) % 11) % 10 = CAST(substr(d, 13, 1) AS INT) AS sound FROM n)
      SELECT image, f.field, f.value, CAST(f.c AS DOUBLE) AS confidence, f.w AS warnings FROM (SELECT image, unnest([{'field': 'rrn', 'value': rrn, 'c': CASE WHEN image % 4 = 0 AND image % 3 <> 0 THEN 0.7 ELSE 0.9 END, 'w': CASE WHEN sound THEN '' ELSE 'CHECKSUM_MISMATCH:rrn' END},
        {'field': 'name', 'value': '홍길동', 'c': 0.9, 'w': ''}, {'field': 'name_hanja', 'value': '洪吉童', 'c': 0.9, 'w': ''}, {'field': 'address', 'value': '서울특별시 종로구 세종대로 ' || house, 'c': 0.9, 'w': 'REPAIRED:address'},
        {'field': 'address_lines', 'value': '서울특별시 종로구|세종대로 ' || house, 'c': 0.9, 'w': ''}, {'field': 'issue_date', 'value': day, 'c': 0.9, 'w': ''},
        {'field': 'issuer', 'value': '서울특별시 종로구청장', 'c': 0.9, 'w': CASE WHEN odd = 0 THEN 'REPAIRED:issuer' ELSE '' END}]) AS f FROM m)""",
    "license_fields": """WITH c AS (SELECT s_suppkey AS image, s_suppkey AS k FROM supplier)
      SELECT image, f.field, f.value, true AS valid FROM (SELECT image, unnest([{'field': 'rrn', 'value': '80' || lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') || '15-1' || lpad(CAST(k * 7907 % 1000000 AS VARCHAR), 6, '0')},
        {'field': 'license_number', 'value': '11-' || CAST(k % 90 + 10 AS VARCHAR) || '-' || lpad(CAST(k * 7919 % 1000000 AS VARCHAR), 6, '0') || '-61'},
        {'field': 'license_types', 'value': CASE WHEN k % 2 = 0 THEN '1종보통|2종원동기' ELSE '1종보통' END}, {'field': 'name', 'value': '홍길동'},
        {'field': 'aptitude_period', 'value': '2025-' || lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') || '-01~2025-12-31'}, {'field': 'issue_date', 'value': '2015-03-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0')},
        {'field': 'serial_code', 'value': 'ABCDE7'}, {'field': 'address', 'value': '경기도 성남시 정자로 ' || CAST(k % 90 + 1 AS VARCHAR)}, {'field': 'address_lines', 'value': '경기도 성남시 정자로 ' || CAST(k % 90 + 1 AS VARCHAR)}, {'field': 'issuer', 'value': '경기남부경찰청장'}, {'field': 'conditions', 'value': CASE WHEN k % 5 = 0 THEN 'A|B' END}]) AS f FROM c) WHERE f.value IS NOT NULL""",
    "number_safety": f"""WITH {FIELDS_SQL}, r AS (SELECT kind, found, found AND correct AS correct, accepted, other % 3 = 0 AS warned FROM acc)
      SELECT kind, count(*) AS n, round(avg(CAST(found AS INT)), 6) AS found_rate, round(avg(CAST(correct AS INT)), 6) AS correct_rate, count(*) FILTER (found AND NOT correct) AS n_wrong,
        count(*) FILTER (found AND NOT correct AND accepted) AS false_accepts, count(*) FILTER (found AND NOT correct AND warned) AS wrong_warned, count(*) FILTER (correct AND warned) AS correct_warned FROM r GROUP BY kind""",
    "signal_report": """SELECT l_linestatus, count(*) AS n, round(avg(CAST(l_linenumber = 1 AS INT)), 6) AS unchecked, round(avg(CAST(l_returnflag = 'A' AS INT)), 6) AS share_ok,
        round(avg(CAST(l_partkey % 3 = 0 OR l_suppkey % 4 = 0 OR l_quantity > 40 AS INT)) FILTER (l_linenumber > 1), 6) AS suspicious, round(avg(CAST(l_partkey % 3 = 0 AS INT)) FILTER (l_linenumber > 1), 6) AS no_face,
        round(avg(CAST(l_suppkey % 4 = 0 AS INT)) FILTER (l_linenumber > 1), 6) AS card_aspect, round(avg(CAST(l_quantity > 40 AS INT)) FILTER (l_linenumber > 1), 6) AS plain_background FROM lineitem GROUP BY l_linestatus""",
    "line_rows": """WITH RECURSIVE li AS (SELECT l_orderkey AS image, CAST(l_linenumber * 100 + l_quantity AS BIGINT) AS idx, CAST(l_partkey % 40 * 10 AS DOUBLE) AS x0, CAST(l_suppkey % 20 * 8 AS DOUBLE) AS y0, l_quantity + 30 AS w, l_linenumber * 3 + 10 AS h, l_linenumber, l_tax FROM lineitem),
      o AS (SELECT *, x0 + w AS x1, y0 + h AS y1, (y0 + y0 + h) / 2 AS cy, row_number() OVER (PARTITION BY image ORDER BY (y0 + y0 + h) / 2, idx, x0, w, l_tax) AS rn FROM li),
      r AS (
        SELECT image, rn, 0 AS row, [{'cy': cy, 'h': h}] AS held FROM o WHERE rn = 1
        UNION ALL
        SELECT o.image, o.rn, CASE WHEN joins THEN row ELSE row + 1 END, CASE WHEN joins THEN list_append(held, {'cy': o.cy, 'h': o.h}) ELSE [{'cy': o.cy, 'h': o.h}] END
        FROM r JOIN (SELECT * FROM o) o ON o.image = r.image AND o.rn = r.rn + 1, LATERAL (SELECT len(list_filter(r.held, lambda m: abs(m.cy - o.cy) <= 0.5 * least(m.h, o.h))) > 0 AS joins))
      SELECT o.image, CAST(row AS BIGINT) AS row, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY x0, o.rn) AS idxs, string_agg('line ' || CAST(l_linenumber AS VARCHAR), ' ' ORDER BY x0, o.rn) AS text, min(l_tax) AS score,
        min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM r JOIN o ON o.image = r.image AND o.rn = r.rn GROUP BY o.image, row""",
    "jamo_distances": f"""WITH k AS (
        SELECT c_custkey, c_custkey * 7919 % 11172 AS f, c_custkey * 104729 % 11172 AS s FROM customer),
      w AS (SELECT c_custkey, [f, s] AS a, [f, CASE c_custkey % 4 WHEN 0 THEN s WHEN 1 THEN s // 28 * 28 + (s + 1) % 28 WHEN 2 THEN (s + 588) % 11172 ELSE c_custkey * 31 % 11172 END] AS b FROM k),
      e AS (SELECT c_custkey, array_to_string(list_transform(a, lambda n: {_letters_sql("n")}), '') AS a, array_to_string(list_transform(b, lambda n: {_letters_sql("n")}), '') AS b FROM w)
      SELECT c_custkey, levenshtein(a, b) AS distance FROM e""",
    "document_kinds": "SELECT o_orderkey AS image, CASE WHEN o_orderkey % 7 IN (0, 1) THEN 'RESIDENT_CARD' WHEN o_orderkey % 7 IN (2, 3, 4) THEN 'DRIVER_LICENSE' ELSE 'UNKNOWN' END AS document_type FROM orders",
    "police_offices": "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN '서울지방경찰청장' WHEN 1 THEN '부산경찰청장' WHEN 2 THEN '경기남부경찰청장' ELSE '동장' END AS value, s_suppkey % 4 = 2 AS changed FROM supplier",
    "line_angles": """SELECT l_orderkey AS image, round(coalesce(median(atan2(l_partkey % 21 - 10, l_quantity * 4)) FILTER (sqrt((l_quantity * 4) * (l_quantity * 4) + (l_partkey % 21 - 10) * (l_partkey % 21 - 10)) > 40), 0), 9) AS angle FROM lineitem GROUP BY 1""",
    "card_results": f"""WITH {RESULTS_SQL} SELECT image, status, fail_reason, CASE WHEN read THEN substr(rrn, 1, 8) || '******' END AS rrn, CAST(CASE WHEN read THEN 7 ELSE 0 END AS BIGINT) AS n_fields,
        CASE WHEN read AND has_rrn AND image % 6 = 0 THEN 'CHECKSUM_MISMATCH:rrn' ELSE '' END AS warnings FROM st""",
    "card_documents": f"""WITH {RESULTS_SQL},
      n(field) AS (VALUES ('address'), ('address_lines'), ('issue_date'), ('issuer'), ('name'), ('name_hanja'), ('rrn')),
      e AS (
        SELECT image, n.field, CASE WHEN value IS NULL THEN 'null' ELSE '"' || CASE WHEN n.field = 'rrn' THEN substr(value, 1, 8) || '******' ELSE value END || '"' END AS v,
          CASE WHEN value IS NULL THEN '{{"found":false,"confidence":null,"bbox":null,"valid":null,"accepted":false}}' ELSE '{{"found":true,"confidence":' || round(confidence, 4) || ',"bbox":[],"valid":' || valid || ',"accepted":' || accepted || '}}' END AS m
        FROM st CROSS JOIN n LEFT JOIN a ON a.k = image AND a.field = n.field WHERE read),
      j AS (SELECT image, string_agg('"' || field || '":' || v, ',' ORDER BY field) AS f, string_agg('"' || field || '":' || m, ',' ORDER BY field) AS m FROM e GROUP BY image)
      SELECT st.image, '{{"request_id":"' || md5('{{"image":' || st.image || '}}') || '","status":"' || status || '","document_type":"' || CASE WHEN st.image % 17 = 0 THEN 'UNKNOWN","document_side":"UNKNOWN' ELSE 'RESIDENT_CARD","document_side":"FRONT' END || '","fields":{{' || coalesce(f, '') || '}},"derived":{{}},"field_meta":{{' || coalesce(m, '')
        || '}},"warnings":[' || CASE WHEN read AND has_rrn AND st.image % 6 = 0 THEN '"CHECKSUM_MISMATCH:rrn"' ELSE '' END || '],"fail_reason":' || coalesce('"' || fail_reason || '"', 'null') || ',"preprocess":{{"rotation":0,"contrast_enhanced":false,"passes":null}},"model":{{"name":"none","schema":"1"}},"elapsed_ms":null}}' AS document
      FROM st LEFT JOIN j ON j.image = st.image""",
    "truth_scores": f"""WITH {SCORED_SQL} SELECT image, field, CASE WHEN same THEN p IS NOT NULL END AS found, correct,
        CASE WHEN same THEN round(least(1.0, levenshtein(replace(coalesce(p, ''), ' ', ''), gt) / CAST(length(gt) AS DOUBLE)), 6) END AS cer FROM se""",
    "condition_scores": f"""WITH {SCORED_SQL}, im AS (SELECT image, any_value(condition) AS condition, any_value(status) AS status, any_value(elapsed_ms) AS ms, bool_and(coalesce(correct, false)) AS every, bool_and(coalesce(correct, false)) FILTER (field IN ('name', 'rrn')) AS core FROM se GROUP BY image)
      SELECT condition, count(*) AS n, round(avg(CAST(status = 'OK' AS INT)), 6) AS share_ok, round(avg(CAST(core AS INT)), 6) AS core_correct, round(avg(CAST(every AS INT)), 6) AS all_correct, median(ms) AS p50 FROM im GROUP BY condition""",
    "report_levels": f"WITH {LEVELS_SQL} SELECT * FROM lv",
    "report_lines": f"""WITH {LEVELS_SQL},
      fr AS (
        SELECT o_orderstatus AS document_type, field, count(*) AS n, count(*) FILTER (same AND p IS NOT NULL) / count(*) AS found, count(*) FILTER (correct) / count(*) AS correct, count(*) FILTER (same AND p IS NOT DISTINCT FROM gt) / count(*) AS exact, avg(least(1.0, levenshtein(replace(coalesce(p, ''), ' ', ''), gt) / CAST(length(gt) AS DOUBLE))) FILTER (same) AS cer,
          count(*) FILTER (same AND taken) / count(*) AS accept, count(*) FILTER (same AND taken AND correct) / nullif(CAST(count(*) FILTER (same AND taken) AS DOUBLE), 0) AS precision, count(*) FILTER (same AND taken AND NOT correct) AS false_accepts FROM lf GROUP BY ALL)
      SELECT document_type || ':0:' AS position, '## ' || document_type || ' (' || n || ')' AS line FROM lv WHERE NOT by_condition
      UNION ALL SELECT document_type || ':1:', printf('| OK / PARTIAL / FAIL | %.1f%% / %.1f%% / %.1f%% |', 100 * ok / n, 100 * partial / n, 100 * fail / n) FROM lv WHERE NOT by_condition
      UNION ALL SELECT document_type || ':2:', '| taken for another type | ' || other_type || ' |' FROM lv WHERE NOT by_condition
      UNION ALL SELECT document_type || ':3:', printf('| all fields correct | %.1f%% |', 100 * all_correct / n) FROM lv WHERE NOT by_condition
      UNION ALL SELECT document_type || ':4:', printf('| OK with a wrong field | %d (%.1f%%) |', ok_wrong, 100 * ok_wrong / n) FROM lv WHERE NOT by_condition
      UNION ALL SELECT document_type || ':5:' || field, printf('| %s | %.1f%% | %.1f%% | %.1f%% | %.3f | %.1f%% | %.1f%% | %d |', field, 100 * found, 100 * correct, 100 * exact, cer, 100 * accept, 100 * precision, false_accepts) FROM fr
      UNION ALL SELECT document_type || ':6:' || condition, printf('| %s | %d | %.1f%% | %.1f%% | %.1f%% | %.0f ms |', condition, n, 100 * ok / n, 100 * core_correct / n, 100 * all_correct / n, p50) FROM lv WHERE by_condition""",
    "calibration_choice": f"""WITH {FIELDS_SQL},
      f AS (SELECT * FROM fields WHERE found), g AS (
        SELECT kind, t, count(*) FILTER (confidence >= t / 100.0 - 1e-9) AS n, avg(CAST(correct AS INT)) FILTER (confidence >= t / 100.0 - 1e-9) AS p, count(*) AS total
        FROM f, (SELECT unnest(range(50, 100)) AS t) GROUP BY kind, t),
      c AS (SELECT *, coalesce(t = min(t) FILTER (p >= 0.8571) OVER (PARTITION BY kind), false) AS recommended FROM g WHERE n > 0)
      SELECT kind, round(t / 100.0, 2) AS threshold, n, round(p, 6) AS precision, round(n / total, 6) AS coverage, recommended FROM c WHERE recommended OR t IN (50, 70, 80, 85, 90, 95)
      UNION ALL SELECT kind, NULL, NULL, NULL, NULL, false FROM c GROUP BY kind HAVING NOT bool_or(recommended)""",
    "document_signals": """WITH v AS (
        SELECT l_orderkey, l_linenumber, l_partkey % 11 > 0 AS detector, l_orderkey % 7 > 0 AS boxed,
          l_partkey % 5 > 0 AND l_quantity * 3 BETWEEN 20 AND 120 AND CASE WHEN l_orderkey % 2 = 0 THEN l_partkey % 200 + 20 > 150 ELSE l_partkey % 200 + 20 < 100 END AS good,
          CASE WHEN l_partkey % 3 > 0 THEN 1.3 + l_discount * 6 END AS ratio, l_partkey % 4 <> 0 AS contour, CASE WHEN l_partkey % 6 > 0 THEN l_quantity END AS colour, l_discount * 8 AS clipped FROM lineitem),
      r AS (SELECT *, CASE WHEN detector AND boxed THEN good END AS face_ok,
          concat_ws('|', CASE WHEN detector AND boxed AND NOT good THEN 'NO_FACE_IN_PHOTO_AREA' END, CASE WHEN contour AND abs(ratio / (85.6 / 54.0) - 1) > 0.1 THEN 'CARD_ASPECT' END, CASE WHEN clipped <= 0.5 AND colour < 12 THEN 'PLAIN_BACKGROUND' END) AS reasons,
          concat_ws('|', CASE WHEN detector AND NOT boxed THEN 'FACE_NOT_CHECKED' END, CASE WHEN ratio IS NOT NULL AND NOT contour THEN 'CARD_EDGES_NOT_VISIBLE' END, CASE WHEN colour IS NOT NULL AND clipped > 0.5 THEN 'BACKGROUND_OVEREXPOSED' END) AS inconclusive FROM v)
      SELECT l_orderkey, l_linenumber, face_ok, reasons, inconclusive, reasons <> '' AS suspicious FROM r""",
    "attempt_orders": """SELECT o_orderkey AS image, CASE WHEN o_orderkey % 11 > 0 AND o_orderkey % 5 = 0 THEN 'rot90|rot270|contrast|rot180' WHEN o_orderkey % 3 = 0 THEN 'rot180|rot90|rot270|contrast'
        WHEN o_orderkey % 7 > 0 AND o_orderkey % 2 = 0 THEN 'rot180|contrast|rot90|rot270' ELSE 'contrast|rot90|rot270|rot180' END AS passes FROM orders""",
    "turned_boxes": """WITH p AS (
        SELECT l_orderkey, l_linenumber, l_linenumber % 4 * 90 AS r, CASE WHEN l_orderkey % 2 = 0 THEN 0.5 ELSE 2.0 END AS s, CAST(l_partkey % 640 AS DOUBLE) AS x, CAST(l_suppkey % 480 AS DOUBLE) AS y,
          CAST(l_partkey % 640 + l_quantity AS DOUBLE) AS u, CAST(l_suppkey % 480 + l_linenumber AS DOUBLE) AS v FROM lineitem)
      SELECT l_orderkey, l_linenumber, round(CASE r WHEN 0 THEN x WHEN 90 THEN y WHEN 180 THEN 699 - x ELSE 699 - y END / s, 1) AS x0, round(CASE r WHEN 0 THEN y WHEN 90 THEN 499 - x WHEN 180 THEN 499 - y ELSE x END / s, 1) AS y0,
        round(CASE r WHEN 0 THEN u WHEN 90 THEN v WHEN 180 THEN 699 - u ELSE 699 - v END / s, 1) AS x1, round(CASE r WHEN 0 THEN v WHEN 90 THEN 499 - u WHEN 180 THEN 499 - v ELSE u END / s, 1) AS y1 FROM p""",
    "missed_signals": """WITH r AS (
        SELECT l_orderkey * 10 + l_linenumber AS image, CASE WHEN l_suppkey % 2 = 0 AND l_linestatus = 'O' AND l_quantity <= 40 THEN 'missed' WHEN l_suppkey % 2 = 1 AND l_quantity > 40 THEN 'false_positive' END AS error FROM lineitem WHERE l_partkey % 5 > 0)
      SELECT error, image, k FROM (SELECT error, image, row_number() OVER (PARTITION BY error ORDER BY image) AS k FROM r WHERE error IS NOT NULL) WHERE k <= 20""",
    "issuer_repairs": f"""WITH t AS (
        SELECT c_custkey, ({text.PROVINCES})[c_custkey % {len(text.PROVINCES)} + 1] || CASE WHEN c_custkey % 2 = 0 THEN '  ' ELSE '' END || (['가람', '누리', '다솔'])[c_custkey % 3 + 1] || ({ISSUER_ENDS})[c_custkey // 3 % {len(ISSUER_ENDS)} + 1] AS t FROM customer),
      a AS (SELECT c_custkey, regexp_replace(regexp_replace(t, ' +', ' ', 'g'), '^({"|".join(text.PROVINCES)})([^ ])', '\\1 \\2') AS a FROM t),
      s AS (SELECT c_custkey, regexp_replace(a, ' (장|청장|시장|군수)$', '\\1') AS s FROM a),
      r AS (SELECT c_custkey, s, CASE WHEN regexp_matches(s, '(청장|시장|군수|읍장|면장|동장)$') THEN s WHEN regexp_matches(s, '.[청시][가-힣]$') THEN left(s, length(s) - 1) || '장' WHEN regexp_matches(s, '.군[가-힣]$') THEN left(s, length(s) - 1) || '수'
          WHEN s LIKE '%경찰' THEN s || '청장' WHEN s LIKE '%청' THEN s || '장' WHEN s LIKE '%구' THEN s || '청장' WHEN s LIKE '%군' THEN s || '수' ELSE s END AS value FROM s)
      SELECT c_custkey, value, value <> s AS repaired, regexp_matches(value, '(청장|시장|군수|읍장|면장|동장)$') AND length(value) >= 4 AS valid FROM r""",
    "token_repairs": """WITH n AS (SELECT c_custkey, c_mktsegment, lpad(CAST(c_custkey * 7919 % 1000000 AS VARCHAR), 6, '0') || '-' || lpad(CAST(c_custkey * 104729 % 10000000 AS VARCHAR), 7, '0') AS number FROM customer),
      t AS (SELECT c_custkey, number, CASE c_custkey % 3 WHEN 0 THEN translate(number, '0158', 'OlSB') WHEN 1 THEN translate(number, '0123', 'DxyZ') ELSE number END || left(c_mktsegment, c_custkey % 9) AS t FROM n)
      SELECT c_custkey, CASE WHEN length(regexp_replace(t, '[^0-9]', '', 'g')) * 10 >= length(regexp_replace(t, '[^0-9A-Za-z]', '', 'g')) * 6 THEN translate(t, 'OoDQIl|i!SBZz', '0000111115822') ELSE t END AS repaired, substr(number, 1, 8) || '******' AS masked FROM t""",
    "address_checks": f"""WITH t AS (SELECT c_custkey, (['성남시분당구', '종로구', '수원시', '양평군'])[c_custkey % 4 + 1] AS d FROM customer),
      s AS (SELECT c_custkey, d, ({[*text.PROVINCES, *text.PROVINCE_STEMS, "한양", ""]})[c_custkey % {len(text.PROVINCES) + len(text.PROVINCE_STEMS) + 2} + 1] || CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE '' END || CASE WHEN c_custkey % 5 > 0 THEN d || ' ' || c_custkey ELSE '' END AS s FROM t)
      SELECT c_custkey, regexp_replace(s, '^({"|".join(text.PROVINCES)})([^ ])', '\\1 \\2') AS spaced, regexp_matches(s, '^({"|".join(text.PROVINCE_STEMS)})') AND length(s) >= 8 AS valid, replace(d, '시분당', '시|분당') AS district FROM s""",
}
SQL |= card_queries.SQL | picture_queries.SQL
SQL["signal_lines"] = f"""WITH r AS ({SQL["signal_report"]}), m AS ({SQL["missed_signals"]}),
  c AS (SELECT *, [unchecked, share_ok, suspicious, no_face, card_aspect, plain_background] AS v FROM r)
  SELECT '1:' || l_linestatus AS position, '| ' || l_linestatus || ' | ' || n || ' | ' || array_to_string(list_transform(v, lambda x: coalesce(printf('%.1f%%', 100 * x), '-')), ' | ') || ' |' AS line FROM c
  UNION ALL SELECT '2:' || error, '## ' || error || ' (' || count(*) || ')' FROM m GROUP BY error
  UNION ALL SELECT '2:' || error || ':' || lpad(CAST(k AS VARCHAR), 6, '0'), '- ' || image FROM m"""

"""Queries on generated cards: their values, their lines read back, and the reading of worse ones; the SQL works the values out by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkrow.functions import text
from inkrow.operators import classify, evaluate, read, synthetic
from inkrow.sources.tables import spread, stored, table

TODAY = "2026-10-07"


def _d(what: str, below: int | str, key: str = "id") -> str:
    """A draw as the generator takes it."""
    return f"CAST(CAST('0x' || substr(md5('1:{what}:' || {key}), 1, 7) AS BIGINT) % {below} AS INT)"


def _list(values: list) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def _of(values: list, place: str) -> str:
    return f"({_list(values)})[{place} + 1]"


def _weighted(what: str, weights: list[int]) -> str:
    steps = [sum(weights[: i + 1]) for i in range(len(weights))]
    return f"len(list_filter({_list(steps)}, lambda s: s <= {_d(what, steps[-1])}))"


def cards_sql(source: str) -> str:
    """CTEs ending in cards(id, ...) with a card for each id of source."""
    s = synthetic
    names = lambda letters: " || ".join(f"CASE WHEN size > {i} THEN substr('{letters}', {_d(f'given{i}', len(s.GIVEN))} + 1, 1) ELSE '' END" for i in range(3))
    first_day = lambda months, day: f"greatest(birth + INTERVAL {months} MONTH, TIMESTAMP '{day}')"
    dated = lambda what, first: f"CAST({first} + to_days({_d(what, 1 << 28)} % (greatest(date_diff('day', {first}, DATE '{TODAY}'), 0) + 1)) AS DATE)"
    offices = " ".join(f"WHEN '{p}' THEN '{o}'" for p, o in s.OFFICES.items())
    codes = " ".join(f"WHEN '{o}' THEN '{c}'" for o, c in s.CODES.items())
    districts = " ".join(f"WHEN '{p}' THEN {_list(d)}" for p, d in s.DISTRICTS.items())
    return f"""g1 AS (
  SELECT id, DATE '{s.FIRST_BIRTH}' + {_d("birth", s.BIRTH_DAYS)} AS birth, {_weighted("surname", [w for *_, w in s.SURNAMES])} AS sur, {_weighted("syllables", s.GIVEN_SIZES)} + 1 AS size, {_of(list(s.DISTRICTS), _d("province", len(s.DISTRICTS)))} AS province FROM ({source})),
g2 AS (
  SELECT *, {_of([n for n, *_ in s.SURNAMES], "sur")} || {names(s.GIVEN)} AS name, {_of([h for _, h, _ in s.SURNAMES], "sur")} || {names(s.HANJA)} AS name_hanja, CASE province {districts} END AS named,
    CAST({_d("sex", 2)} + CASE WHEN year(birth) >= 2000 THEN 3 ELSE 1 END + CASE WHEN {_d("foreign", 20)} = 0 THEN 4 ELSE 0 END AS VARCHAR) AS sex FROM g1),
g3 AS (SELECT *, named[{_d("district", 60)} % len(named) + 1] AS district, strftime(birth, '%y%m%d') || sex || lpad(CAST({_d("back", 100_000)} AS VARCHAR), 5, '0') AS digits FROM g2),
g4 AS (
  SELECT *, substr(digits, 1, 6) || '-' || substr(digits, 7) || CAST((11 - list_sum(list_transform(range(1, 13), lambda i: CAST(substr(digits, CAST(i AS INT), 1) AS INT) * (2 + (i - 1) % 8))) % 11) % 10 AS VARCHAR) AS rrn,
    list_filter([province, CASE WHEN district <> '' THEN district END, {_of(s.ROADS, _d("road", len(s.ROADS)))} || {_of(s.ROAD_KINDS, _d("road kind", len(s.ROAD_KINDS)))} || CASE WHEN {_d("side", 10)} < 3 THEN {_d("side number", 40)} + 1 || '번길' ELSE '' END, CAST({_d("house", 290)} + 10 AS VARCHAR),
      CASE WHEN {_d("building", 2)} = 0 THEN '(' || {_of(s.BUILDINGS, _d("building name", len(s.BUILDINGS)))} || CASE WHEN {_d("block", 10)} < 3 THEN '' ELSE ')' END END, CASE WHEN {_d("building", 2)} = 0 AND {_d("block", 10)} < 3 THEN {_d("block number", 30)} + 1 || '차)' END,
      CASE WHEN {_d("unit", 10)} < 4 THEN {_d("house block", 20)} + 101 || '동' END, CASE WHEN {_d("unit", 10)} < 4 THEN {_d("floor", 25)} + 1 || '0' || {_d("door", 8)} + 1 || '호' END], lambda w: w IS NOT NULL) AS words,
    {dated("resident", first_day(204, "1999-01-01"))} AS resident_issued, {dated("license", first_day(216, "1985-01-01"))} AS license_issued,
    province || CASE right(district, 1) WHEN '구' THEN ' ' || district || '청장' WHEN '시' THEN ' ' || district || '장' WHEN '군' THEN ' ' || district || '수' ELSE '장' END AS resident_issuer,
    CASE WHEN province = '경기도' THEN CASE WHEN list_contains({_list(s.NORTH)}, district) THEN '{s.GYEONGGI[0]}' ELSE '{s.GYEONGGI[1]}' END ELSE CASE province {offices} ELSE substr(province, 1, 2) END END AS police,
    {_weighted("kind", [w for _, w in s.KINDS])} AS kind FROM g3),
g5 AS (SELECT *, greatest(year(birth) + 18, 1985) AS earliest, year(license_issued) + {_of(s.PERIODS, _d("period", len(s.PERIODS)))} AS period FROM g4),
cards AS (
  SELECT id, birth, name, name_hanja, sex, rrn, words, array_to_string(words, ' ') AS address, resident_issued, resident_issuer, license_issued,
    CASE police {codes} END || '-' || lpad(CAST((earliest + {_d("first year", 1 << 28)} % (greatest(year(license_issued) - earliest, 0) + 1)) % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST({_d("serial", 1_000_000)} AS VARCHAR), 6, '0') || '-' || {_d("check", 90)} + 10 AS license_number,
    {_of([k for k, _ in s.KINDS], "kind")} || CASE WHEN {_d("second", 25)} < 3 THEN '|' || {_of([k for k, _ in s.KINDS], f"(kind + 1 + {_d('second kind', len(s.KINDS) - 1)}) % {len(s.KINDS)}")} ELSE '' END AS license_types,
    police || CASE WHEN year(license_issued) < 2021 THEN '지방' ELSE '' END || '경찰청장' AS license_issuer, make_date(period, 1, 1) AS period_start, make_date(period, 12, 31) AS period_end,
    {" || ".join(f"substr('{s.SIGNS}', {_d(f'sign{i}', len(s.SIGNS))} + 1, 1)" for i in range(6))} AS serial_code FROM g5)"""


#: Lines of an address wrapped by a list's fold, the open line last; widths in hundredths, so that they are whole numbers.
def _wrap_sql(x: int, size: int, end: int, percent: str) -> str:
    narrow = synthetic.NARROW
    width = lambda t: f"(length({t}) * {narrow} + length(regexp_replace({t}, '[^가-힣一-鿿]', '', 'g')) * {100 - narrow}) * {size} * {percent}"
    return f"list_reduce(words, lambda a, w: CASE WHEN {width("(split_part(a, '|', -1) || ' ' || w)")} > {(end - x) * 10_000} THEN a || '|' || w ELSE a || ' ' || w END)"


def papers_sql(source: str) -> str:
    """cards_sql and papers(id, document_type, address_lines, shown, ...)."""
    fits, percents = [], []
    for slots in (synthetic.RESIDENT_SLOTS, synthetic.LICENSE_SLOTS):
        x, _, size = slots["address"][0]
        tries = [_wrap_sql(x, size, slots["address_end"], str(p)) for p in synthetic.SHRINKS]
        n = len(slots["address"])
        fits.append(f"array_to_string(list_filter([{', '.join(tries)}], lambda t, i: len(string_split(t, '|')) <= {n} OR i = {len(tries)})[1:1], '')")
        percents.append(f"({synthetic.SHRINKS})[coalesce(list_position(list_transform([{', '.join(tries)}], lambda t: len(string_split(t, '|')) <= {n}), true), {len(tries)})]")
        fits[-1] = f"array_to_string(string_split({fits[-1]}, '|')[1:{n}], '|')"
    return f"""{cards_sql(source)},
typed AS (SELECT *, CASE WHEN sex >= '5' OR {_d("paper", 2)} = 0 THEN 'DRIVER_LICENSE' ELSE 'RESIDENT_CARD' END AS document_type FROM cards),
papers AS (SELECT *, CASE WHEN document_type = 'RESIDENT_CARD' THEN {fits[0]} ELSE {fits[1]} END AS address_lines, CASE WHEN document_type = 'RESIDENT_CARD' THEN {percents[0]} ELSE {percents[1]} END AS percent, document_type = 'RESIDENT_CARD' AND {_d("hanja", 5)} < 4 AS shown FROM typed)"""


CUSTOMERS = "SELECT c_custkey AS id FROM customer"


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.cards(spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id"))


def synthetic_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card for every customer, every value drawn from a digest of its key."""
    days = ["birth", "resident_issued", "license_issued", "period_start", "period_end"]
    return _cards(spark, sf_dir).drop("words").withColumns({d: F.col(d).cast("string") for d in days})


def card_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of the customers' papers, wrapped into the lines of their slots."""
    own = synthetic.documents(_cards(spark, sf_dir))
    return own.select("id", "document_type", F.col("truth")["address_lines"].alias("address_lines"), F.size("placed").cast("long").alias("n_lines"))


#: Size of the pictures of cards.
WIDTH, HEIGHT = 1000, 720
DICTIONARY = [(p, d) for p, names in synthetic.DISTRICTS.items() for d in names if d]


def _dictionary(spark: SparkSession) -> dict[str, DataFrame]:
    districts = spark.createDataFrame(DICTIONARY, "province string, district string")
    return {"provinces": spark.createDataFrame([(p,) for p in text.PROVINCES], "province string"), "districts": districts}


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(synthetic.documents(_cards(spark, sf_dir)), "papers")


def _truth(papers: DataFrame) -> DataFrame:
    return papers.select(F.col("id").alias("image"), "document_type", F.col("truth").alias("fields"))


def _signals(papers: DataFrame) -> DataFrame:
    """Signals by the key: a face beside the number, on the wrong side, none, or not looked for; an outline of the right ratio, another or none; colours of all sorts."""
    key, card = F.col("id"), F.col("document_type") == "RESIDENT_CARD"
    face = lambda x: F.array(F.struct(x.cast("double").alias("x0"), F.lit(200.0).alias("y0"), (x + 150).cast("double").alias("x1"), F.lit(380.0).alias("y1"), F.lit(0.9).alias("score")))
    faces = F.when(key % 4 == 2, F.slice(face(F.lit(0)), 1, 0)).otherwise(face(F.when(card == (key % 4 != 1), 700).otherwise(100)))
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    quad = lambda w: F.array(corner(w, 0), corner(w, 540), corner(0, 540), corner(0, 0))
    outline = F.when(key % 3 == 0, quad(856)).when(key % 3 == 1, quad(600))
    return papers.select(key.alias("image"), outline.alias("outline"), faces.alias("faces"), (key % 4 != 3).alias("detector"), F.when(key % 5 == 0, 5.0).when(key % 5 != 1, 30.0).alias("colour"), F.when(key % 20 == 0, 0.6).otherwise(0.1).alias("clipped"))


def document_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' papers, read from the lines of all attempts to records in one run.

    By the last digit of the key: 6 lies upside down, 7 on its side, 8 is unclear without more contrast, 9 shows a note only, 5 can't be decoded or has no line; the others are upright and clear.
    """
    papers = _papers(spark, sf_dir)
    k, attempt = F.col("id") % 10, lambda name, degrees=0, score=synthetic.SCORE: F.struct(F.lit(name).alias("pass"), F.lit(degrees).alias("degrees"), F.lit(score).alias("score"))
    made = F.when((k < 5) | (k == 9), F.array(attempt("original"))).when(k == 6, F.array(attempt("original", 180), attempt("rot180"))).when(k == 7, F.array(attempt("original", 90), attempt("rot90", 180), attempt("rot270")))
    made = made.when(k == 8, F.array(attempt("original", score=0.5), attempt("contrast")))
    # of a note there is one line
    tried = papers.select("id", F.when(k == 9, F.slice("placed", 1, 1)).otherwise(F.col("placed")).alias("placed"), F.inline(made))
    lines = synthetic.lines(tried, F.col("degrees"), (WIDTH, HEIGHT), ("pass",)).withColumnRenamed("id", "image").withColumn("text", F.when(F.col("image") % 10 == 9, "메모 12").otherwise(F.col("text")))
    key, lying = F.col("id"), F.col("id") % 10 == 7
    images = papers.select(key.alias("image"), (key % 20 != 5).alias("decoded"), F.when(lying, HEIGHT).otherwise(WIDTH).alias("width"), F.when(lying, WIDTH).otherwise(HEIGHT).alias("height"), F.lit(1.0).alias("scale"))
    attempts = read.attempted(lines, F.lit(TODAY).cast("date"), _dictionary(spark))
    out = stored(read.results(attempts, images), "results")
    checked = read.checks(attempts, images, _signals(papers)).select("image", F.col("face.ok").alias("face_ok"), F.round("ratio", 6).alias("ratio"), F.array_join("reasons", "|").alias("reasons"), F.array_join("inconclusive", "|").alias("inconclusive"))
    right = evaluate.scored(_truth(papers), out).groupBy("image").agg(F.count_if("correct").alias("n_correct"), F.count_if("accepted").alias("n_accepted"))
    shown = ["name", "name_hanja", "rrn", "address", "address_lines", "issue_date", "issuer", "license_number", "license_types", "aptitude_period", "serial_code"]
    box = F.col("field_meta")["rrn"]["bbox"][0][0]
    told = [F.col("derived")[k].alias(k) for k in ("birth_date", "gender", "license_region_name", "is_expired")]
    return out.join(right, "image").join(checked, "image", "left").select("image", "face_ok", "ratio", "reasons", "inconclusive", "document_type", "status", "fail_reason", "pass", "passes", "n_correct", "n_accepted", *[F.col("fields")[f].alias(f) for f in shown], *told, F.array_join("warnings", "|").alias("warnings"), box["x"].alias("rrn_x"), box["y"].alias("rrn_y"))


#: Lines that the noise of card_conditions reaches with more than lost scores.
NOISY = ("name", "rrn", "address")


def card_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the customers' papers are read by condition of their photographs, one condition by draw each."""
    papers = _papers(spark, sf_dir).withColumn("condition", synthetic.of(list(synthetic.CONDITIONS), synthetic.draw(1, "condition", len(synthetic.CONDITIONS))))
    lines = synthetic.photographed(papers, targets=NOISY).select(F.col("id").alias("image"), F.lit("original").alias("pass"), "idx", "text", "score", "box", "chars")
    images = papers.select(F.col("id").alias("image"), F.lit(True).alias("decoded"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit(1.0).alias("scale"))
    out = stored(read.results(read.attempted(lines, F.lit(TODAY).cast("date"), _dictionary(spark)), images), "results")
    rows = out.join(papers.select(F.col("id").alias("image"), "condition", (F.col("id") % 700).alias("elapsed_ms")), "image")
    report = evaluate.condition_report(rows, evaluate.scored(_truth(papers), out), ["condition"])
    return report.withColumns({c: F.round(c, 6) for c in ("share_ok", "core_correct", "all_correct")})


def _conditions_sql() -> str:
    rows = ", ".join(f"('{c}', {', '.join(map(str, v[1:]))})" for c, v in synthetic.CONDITIONS.items())
    d = lambda what, below: _d(what, below, "key")
    weigh = "list_sum(list_transform(range(1, 13), lambda i: CAST(substr(r, CAST(i AS INT), 1) AS INT) * (2 + (i - 1) % 8)))"
    others = {True: ["issue_date", "issuer"], False: ["label", "aptitude_start", "aptitude_end", "serial_code", "issue_date", "issuer"]}
    after = {card: ", ".join(f"{{'role': '{k}', 'idx': {3 if card else 5} + len(al) + {i}, 'i': 0, 't': '.'}}" for i, k in enumerate(keys)) for card, keys in others.items()}
    narrow = synthetic.NARROW
    # a part of an address right of the number's box isn't taken as part of it
    (r_x, _, r_size), (l_x, _, l_size) = synthetic.RESIDENT_SLOTS["address"][0], synthetic.LICENSE_SLOTS["address"][0]
    r_end, l_end = (f"({x} + 14 * {narrow * size} / 100.0)" for x, _, size in (synthetic.RESIDENT_SLOTS["rrn"], synthetic.LICENSE_SLOTS["rrn"]))
    return f"""WITH {papers_sql(CUSTOMERS)},
  p AS (SELECT *, document_type = 'RESIDENT_CARD' AS card, string_split(address_lines, '|') AS al, {_of(list(synthetic.CONDITIONS), _d("condition", len(synthetic.CONDITIONS)))} AS condition FROM papers),
  l AS (
    SELECT id, unnest(list_concat(CASE WHEN card THEN [{{'role': 'name', 'idx': 1, 'i': 0, 't': CASE WHEN shown THEN name || '(' || name_hanja || ')' ELSE name END}}, {{'role': 'rrn', 'idx': 2, 'i': 0, 't': rrn}}, {after[True]}]
        ELSE [{{'role': 'license_types', 'idx': 1, 'i': 0, 't': '.'}}, {{'role': 'license_number', 'idx': 2, 'i': 0, 't': '.'}}, {{'role': 'name', 'idx': 3, 'i': 0, 't': name}}, {{'role': 'rrn', 'idx': 4, 'i': 0, 't': rrn}}, {after[False]}] END,
      list_transform(al, lambda t, i: {{'role': 'address', 'idx': CASE WHEN card THEN 2 ELSE 4 END + i, 'i': i, 't': t}}))) AS l, condition, name, district_, card, percent FROM (SELECT *, len(words) > 0 AND left(address, 2) <> '세종' AS district_ FROM p)),
  k AS (SELECT id, l.role AS role, l.i AS i, l.t AS t, id || ':' || l.idx AS key, condition, name, district_, card, percent FROM l),
  c(condition, loss, taken, lost, cut, misread) AS (VALUES {rows}),
  n AS (
    SELECT k.*, round(0.97 - ({d("score", 1 << 20)} % (loss + 1)) / 100.0, 2) AS score, list_contains({_list(list(NOISY))}, role) AS noisy, {d("misread", 1000)} < misread AS mis, {d("misread place", 1 << 20)} % length(t) + 1 AS mp, {d("misread by", 9)} + 1 AS inc,
      {d("taken", 1000)} < taken AS tk, {d("taken place", 1 << 20)} % length(t) + 1 AS tp, {d("space", 1000)} < lost AND instr(t, ' ') > 0 AS lo, {d("split", 1000)} < cut AS sp FROM k JOIN c ON k.condition = c.condition),
  s AS (SELECT *, CASE WHEN lo THEN replace(left(t, instr(t, ' ')), ' ', '') || substr(t, instr(t, ' ') + 1) ELSE t END AS t3 FROM n),
  o AS (
    SELECT *, role = 'address' AND sp AND instr(t3, ' ') > 1 AND (CASE WHEN card THEN {r_x} ELSE {l_x} END)
      + (length(left(t3, instr(t3, ' '))) * {narrow} + length(regexp_replace(left(t3, instr(t3, ' ')), '[^가-힣一-鿿]', '', 'g')) * {100 - narrow}) * (CASE WHEN card THEN {r_size} ELSE {l_size} END) * percent / 10000.0 >= CASE WHEN card THEN {r_end} ELSE {l_end} END AS out FROM s),
  m AS (SELECT *, noisy AND mis AND regexp_matches(substr(t, mp, 1), '[0-9가-힣]') AS changed, length(regexp_replace(substr(t, 1, mp - 1), '[^ ]', '', 'g')) AS word FROM o),
  f AS (
    SELECT id, any_value(condition) AS condition, min(score) FILTER (role = 'name') AS name_score, bool_or(changed AND mp <= length(name)) FILTER (role = 'name') AS name_wrong,
      min(score) FILTER (role = 'rrn') AS rrn_score, max(CASE WHEN changed THEN left(t, mp - 1) || CAST((TRY_CAST(substr(t, mp, 1) AS INT) + inc) % 10 AS VARCHAR) || substr(t, mp + 1) ELSE t END) FILTER (role = 'rrn') AS r, bool_or(changed) FILTER (role = 'rrn') AS rrn_wrong,
      min(score) FILTER (role = 'address') AS address_score, bool_or((changed AND NOT (i = 1 AND (word = 0 AND NOT lo OR word = 1 AND district_))) OR (tk AND instr('01258', substr(t, tp, 1)) > 0) OR out) FILTER (role = 'address') AS address_wrong, bool_or(i = 1 AND changed AND word = 0 AND lo) FILTER (role = 'address') AS address_lost,
      min(score) FILTER (role = 'issue_date') AS date_score, min(score) FILTER (role = 'issuer') AS issuer_score, min(score) FILTER (role = 'license_number') AS number_score, min(score) FILTER (role = 'license_types') AS types_score, min(score) FILTER (role IN ('label', 'aptitude_start', 'aptitude_end')) AS period_score
    FROM m GROUP BY id),
  b AS (
    SELECT f.*, p.card, CASE WHEN p.card THEN resident_issued ELSE license_issued END AS issued, replace(f.r, '-', '') AS digits,
      TRY_CAST((CASE WHEN substr(f.r, 8, 1) IN ('1', '2', '5', '6') THEN '19' WHEN substr(f.r, 8, 1) IN ('9', '0') THEN '18' ELSE '20' END) || substr(f.r, 1, 2) || '-' || substr(f.r, 3, 2) || '-' || substr(f.r, 5, 2) AS DATE) AS birth2 FROM f JOIN p ON f.id = p.id),
  a AS (
    SELECT *, name_score >= 0.85 AS name_in,
      coalesce(substr(r, 8, 1) NOT IN ('9', '0') AND birth2 <= DATE '{TODAY}' AND year(DATE '{TODAY}') - year(birth2) <= 120, false) AND (rrn_score >= 0.9 OR rrn_score >= 0.6 AND (11 - {weigh.replace("substr(r,", "substr(digits,")} % 11) % 10 = CAST(substr(digits, 13, 1) AS INT)) AS rrn_in,
      address_score >= 0.8 AND NOT address_lost AS address_in, date_score >= 0.9 AND coalesce(issued >= make_date(year(birth2) + 16, 1, 1), true) AS date_in, issuer_score >= 0.85 AS issuer_in, card OR number_score >= 0.9 AS number_in, card OR types_score >= 0.85 AS types_in, card OR period_score >= 0.9 AS period_in FROM b)
  SELECT condition, count(*) AS n, round(avg(CAST(name_in AND rrn_in AND address_in AND date_in AND issuer_in AND number_in AND types_in AND period_in AS INT)), 6) AS share_ok, round(avg(CAST(NOT name_wrong AND NOT rrn_wrong AS INT)), 6) AS core_correct,
    round(avg(CAST(NOT name_wrong AND NOT rrn_wrong AND NOT address_wrong AS INT)), 6) AS all_correct, median(id % 700) AS p50 FROM a GROUP BY condition"""


TITLES = [classify.RESIDENT[0], classify.LICENSE[0], classify.LICENSE_SHORT[0]]
#: A letter that no title has.
STRANGE = "힣"


def title_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types told by titles of orders, up to three letters of which are misread, between a word and a number."""
    key = F.col("o_orderkey")
    d = lambda what, below: synthetic.draw(1, what, below, key)
    title = synthetic.of(TITLES, d("title", len(TITLES)))
    n = F.length("title")
    own = table(spark, sf_dir, "orders").select("o_orderkey", title.alias("title"), d("misreads", 4).alias("k"))
    second, third = d("second letter", n - 1), d("third letter", n - 2)
    places = F.array(d("letter", n), (d("letter", n) + 1 + second) % n, (d("letter", n) + 1 + (second + 1 + third) % (n - 1)) % n)
    own = own.withColumn("places", F.slice(places, F.lit(1), F.col("k")))
    read = F.array_join(F.transform(F.split("title", ""), lambda c, i: F.when(F.array_contains("places", i), STRANGE).otherwise(c)), "")
    lines = own.select(key.alias("image"), F.posexplode(F.array(F.lit("abc"), F.concat(F.lit("<"), read, F.lit(">")), F.lit("12-34"))).alias("idx", "text"))
    return classify.classified(lines).select("image", "document_type", F.col("title").cast("long").alias("title"))


QUERIES = {f.__name__: f for f in (synthetic_cards, card_addresses, document_results, card_conditions, title_types)}
SQL = {
    "synthetic_cards": f"""WITH {cards_sql(CUSTOMERS)} SELECT id, CAST(birth AS VARCHAR) AS birth, name, name_hanja, sex, rrn, address, CAST(resident_issued AS VARCHAR) AS resident_issued, resident_issuer, CAST(license_issued AS VARCHAR) AS license_issued,
      license_number, license_types, license_issuer, CAST(period_start AS VARCHAR) AS period_start, CAST(period_end AS VARCHAR) AS period_end, serial_code FROM cards""",
    "card_addresses": f"""WITH {papers_sql(CUSTOMERS)} SELECT id, document_type, address_lines, len(string_split(address_lines, '|')) + CASE WHEN document_type = 'RESIDENT_CARD' THEN 5 ELSE 11 END AS n_lines FROM papers""",
    "document_results": f"""WITH {papers_sql(CUSTOMERS)},
      p AS (SELECT *, id % 10 AS k, document_type = 'RESIDENT_CARD' AS card, id % 10 NOT IN (5, 9) AS read FROM papers)
      SELECT id AS image, CASE k WHEN 5 THEN NULL WHEN 9 THEN 'UNKNOWN' ELSE document_type END AS document_type, CASE WHEN read THEN 'OK' ELSE 'FAIL' END AS status,
        CASE WHEN id % 20 = 5 THEN 'IMAGE_DECODE_ERROR' WHEN k = 5 THEN 'NO_TEXT' WHEN k = 9 THEN 'UNSUPPORTED_DOCUMENT' END AS fail_reason,
        CASE k WHEN 5 THEN NULL WHEN 6 THEN 'rot180' WHEN 7 THEN 'rot270' WHEN 8 THEN 'contrast' ELSE 'original' END AS pass, CAST(CASE k WHEN 5 THEN NULL WHEN 6 THEN 2 WHEN 7 THEN 3 WHEN 8 THEN 2 ELSE 1 END AS BIGINT) AS passes,
        CAST(CASE WHEN NOT read THEN 0 WHEN card THEN 5 ELSE 9 END AS BIGINT) AS n_correct, CAST(CASE WHEN NOT read THEN 0 WHEN card THEN 5 ELSE 9 END AS BIGINT) AS n_accepted,
        CASE WHEN read THEN name END AS name, CASE WHEN read AND shown THEN name_hanja END AS name_hanja, CASE WHEN read THEN rrn END AS rrn, CASE WHEN read THEN replace(address_lines, '|', ' ') END AS address, CASE WHEN read THEN address_lines END AS address_lines,
        CASE WHEN read THEN CAST(CASE WHEN card THEN resident_issued ELSE license_issued END AS VARCHAR) END AS issue_date, CASE WHEN read THEN CASE WHEN card THEN resident_issuer ELSE license_issuer END END AS issuer,
        CASE WHEN read AND NOT card THEN license_number END AS license_number, CASE WHEN read AND NOT card THEN license_types END AS license_types, CASE WHEN read AND NOT card THEN period_start || '~' || period_end END AS aptitude_period,
        CASE WHEN read AND NOT card THEN serial_code END AS serial_code, CASE WHEN read THEN CAST(birth AS VARCHAR) END AS birth_date, CASE WHEN read THEN CASE WHEN CAST(sex AS INT) % 2 = 1 THEN 'M' ELSE 'F' END END AS gender,
        CASE WHEN read AND NOT card THEN CASE substr(license_number, 1, 2) {" ".join(f"WHEN '{c}' THEN '{n}'" for c, n in text.REGIONS.items())} END END AS license_region_name, CASE WHEN read AND NOT card THEN CASE WHEN period_end < DATE '{TODAY}' THEN 'true' ELSE 'false' END END AS is_expired,
        CASE WHEN read AND NOT card AND regexp_matches(serial_code, '[0OQ1I]') THEN 'LOOKALIKE:serial_code' ELSE '' END AS warnings,
        CASE WHEN read AND id % 4 <> 3 THEN id % 4 = 0 END AS face_ok, CASE WHEN read THEN round(CASE id % 3 WHEN 0 THEN 856 / 540.0 WHEN 1 THEN 600 / 540.0 ELSE frame END, 6) END AS ratio,
        CASE WHEN read THEN concat_ws('|', CASE WHEN id % 4 IN (1, 2) THEN 'NO_FACE_IN_PHOTO_AREA' END, CASE WHEN id % 3 = 1 THEN 'CARD_ASPECT' END, CASE WHEN id % 20 = 10 THEN 'PLAIN_BACKGROUND' END) END AS reasons,
        CASE WHEN read THEN concat_ws('|', CASE WHEN id % 3 = 2 AND frame IS NOT NULL THEN 'CARD_EDGES_NOT_VISIBLE' END, CASE WHEN id % 20 = 0 THEN 'BACKGROUND_OVEREXPOSED' END) END AS inconclusive,
        CAST(CASE WHEN read THEN CASE k WHEN 6 THEN 999 - x WHEN 7 THEN 719 - y ELSE x END END AS DOUBLE) AS rrn_x, CAST(CASE WHEN read THEN CASE k WHEN 6 THEN 719 - y WHEN 7 THEN x ELSE y END END AS DOUBLE) AS rrn_y
      FROM (SELECT *, CASE WHEN card THEN 80 ELSE 430 END AS x, CASE WHEN card THEN 219 ELSE 291 END AS y,
        CASE WHEN NOT card OR 240 + (length(resident_issuer) * 55 + length(regexp_replace(resident_issuer, '[^가-힣]', '', 'g')) * 45) * 40 / 100.0 - 80 >= 600 THEN 1000 / 720.0 END AS frame FROM p)""",
    "card_conditions": _conditions_sql(),
    "title_types": f"""WITH t AS (SELECT o_orderkey, {_d("title", 3, "o_orderkey")} AS t, {_d("misreads", 4, "o_orderkey")} AS k FROM orders),
      n AS (SELECT *, CASE WHEN t = 1 THEN 8 ELSE 5 END AS n FROM t),
      p AS (SELECT *, {_d("letter", "n", "o_orderkey")} AS a, {_d("second letter", "(n - 1)", "o_orderkey")} AS b, {_d("third letter", "(n - 2)", "o_orderkey")} AS c FROM n),
      q AS (SELECT *, [a, (a + 1 + b) % n, (a + 1 + (b + 1 + c) % (n - 1)) % n][1:k] AS places FROM p),
      r AS (SELECT o_orderkey, CASE t WHEN 0 THEN CASE WHEN k <= 1 THEN 'RESIDENT_CARD' END WHEN 1 THEN CASE WHEN k <= 2 OR len(list_filter(places, lambda x: x >= 3)) <= 1 THEN 'DRIVER_LICENSE' END ELSE CASE WHEN k <= 1 THEN 'DRIVER_LICENSE' END END AS kind FROM q)
      SELECT o_orderkey AS image, coalesce(kind, 'UNKNOWN') AS document_type, CASE WHEN kind IS NOT NULL THEN CAST(1 AS BIGINT) END AS title FROM r""",
}

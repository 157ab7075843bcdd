"""Measures of how good recognised fields are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkrow.functions.text import SPACE
from inkrow.operators.decide import EVALUATED, SPECS
from inkrow.sources.tables import growing


def norm(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value, F.lit("")), f"[{SPACE}]+", "")


def cer(predicted: Column, truth: Column) -> Column:
    """Edit distance as a share of the truth's length, at most 1; against an empty truth 0 or 1."""
    p, t = norm(predicted), norm(truth)
    return F.when(F.length(t) == 0, F.when(F.length(p) == 0, 0.0).otherwise(1.0)).otherwise(F.least(F.lit(1.0), F.levenshtein(p, t) / F.length(t)))


def scored(truth: DataFrame, results: DataFrame) -> DataFrame:
    """image, field, core, pred, gt, found, exact, correct, cer, confidence and accepted of every evaluated field of the truth (image, document_type, fields: map of strings).

    results are those of decide.assemble. Fields of an image whose document was taken for another, or that has no result, have nulls for all measures, so that rates over all images count them
    and means don't. correct leaves white space aside. Maps hold lists joined by a bar and spans as start~end.
    """
    evaluated = F.coalesce(*[F.when(F.col("t.document_type") == d, F.array(*map(F.lit, [*spec["required"], *EVALUATED[d]]))) for d, spec in SPECS.items()])
    core = F.coalesce(*[F.when(F.col("t.document_type") == d, F.array(*map(F.lit, spec["core"]))) for d, spec in SPECS.items()])
    both = truth.alias("t").join(growing(results.alias("r")), "image", "left")
    own = both.select("image", F.col("t.document_type").alias("document_type"), (F.col("r.document_type") == F.col("t.document_type")).alias("same"), F.col("t.fields").alias("truth"), F.col("r.fields").alias("read"), F.col("r.field_meta").alias("meta"), core.alias("core_fields"), F.explode(evaluated).alias("field"))
    pred, gt, meta = F.try_element_at("read", F.col("field")), F.try_element_at("truth", F.col("field")), F.try_element_at("meta", F.col("field"))
    same = F.coalesce("same", F.lit(False))
    only = lambda c: F.when(same, c)
    return own.select(
        "image", "document_type", "field", F.array_contains("core_fields", F.col("field")).alias("core"), only(pred).alias("pred"), gt.alias("gt"), only(pred.isNotNull()).alias("found"), only(pred.eqNullSafe(gt)).alias("exact"),
        only(norm(pred) == norm(gt)).alias("correct"), only(cer(pred, gt)).alias("cer"), only(meta["confidence"]).alias("confidence"), only(F.coalesce(meta["accepted"], F.lit(False))).alias("accepted"),
    )


def condition_report(images: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of images (image, status, elapsed_ms and the keys): n, shares OK, with all core fields correct and with all fields correct, and the median time. fields are those of scored()."""
    right = fields.groupBy("image").agg(F.bool_and(F.coalesce(F.col("correct"), F.lit(False))).alias("all_ok"), F.bool_and(F.when(F.col("core"), F.coalesce(F.col("correct"), F.lit(False)))).alias("core_ok"))
    own = images.join(growing(right), "image", "left")
    shares = own.groupBy(*keys).agg(F.count("*").alias("n"), share(F.col("status") == "OK").alias("share_ok"), share(F.coalesce("core_ok", F.lit(False))).alias("core_correct"), share(F.coalesce("all_ok", F.lit(False))).alias("all_correct"))
    return shares.join(latency(images, keys, "elapsed_ms").select(*keys, "p50"), keys, "left")


def level_report(images: DataFrame, fields: DataFrame) -> DataFrame:
    """Reports by document_type and by document_type and condition in one aggregation (by_condition tells which): n, counts of each status, of all fields correct, of core fields correct, of OK with a wrong field among the accepted, and
    of types taken for others, and the median time.

    images are image, document_type, condition, predicted_type, status and elapsed_ms, a row each; fields are those of scored(). A null condition is one of its own.
    """
    ok = F.coalesce(F.col("correct"), F.lit(False))
    right = fields.groupBy("image").agg(F.bool_and(ok).alias("all_ok"), F.bool_and(F.when(F.col("core"), ok)).alias("core_ok"), F.bool_or(F.coalesce("accepted", F.lit(False)) & ~ok).alias("wrong"))
    own = images.join(growing(right), "image", "left")
    both = own.groupingSets([["document_type", "condition"], ["document_type"]], "document_type", "condition")
    statuses = [F.count_if(F.col("status") == s).alias(s.lower()) for s in ("OK", "PARTIAL", "FAIL")]
    out = both.agg((F.grouping_id() == 0).alias("by_condition"), F.count("*").alias("n"), *statuses, F.count_if("all_ok").alias("all_correct"), F.count_if("core_ok").alias("core_correct"), F.count_if((F.col("status") == "OK") & F.col("wrong")).alias("ok_wrong"), F.count_if(~F.col("predicted_type").eqNullSafe(F.col("document_type"))).alias("other_type"), F.median("elapsed_ms").alias("p50"))
    return out


def markdown(levels: DataFrame, fields: DataFrame) -> DataFrame:
    """(position, line) of a report in Markdown: levels are those of level_report, fields of field_report by document_type and field. Lines follow by position."""
    at = lambda section, row="": F.concat_ws(":", F.coalesce("document_type", F.lit("")), F.lit(section), F.lit(row) if isinstance(row, str) else row)
    cells = lambda *texts: F.concat(F.lit("| "), F.concat_ws(" | ", *[F.lit(t) if isinstance(t, str) else t for t in texts]), F.lit(" |"))
    text = lambda c: F.col(c).cast("string")
    of_n = lambda c: percent(F.col(c), F.col("n"))
    line = lambda position, said: F.struct(position.alias("position"), said.alias("line"))
    rate = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.format_string("%.1f%%", 100 * F.col(c)))
    whole = [
        line(at("0"), F.concat(F.lit("## "), "document_type", F.lit(" ("), text("n"), F.lit(")"))),
        line(at("1"), cells("OK / PARTIAL / FAIL", F.concat_ws(" / ", of_n("ok"), of_n("partial"), of_n("fail")))),
        line(at("2"), cells("taken for another type", text("other_type"))),
        line(at("3"), cells("all fields correct", of_n("all_correct"))),
        line(at("4"), cells("OK with a wrong field", F.concat(text("ok_wrong"), F.lit(" ("), of_n("ok_wrong"), F.lit(")")))),
    ]
    part = line(at("6", F.coalesce("condition", F.lit(""))), cells(F.coalesce("condition", F.lit("-")), text("n"), of_n("ok"), of_n("core_correct"), of_n("all_correct"), F.format_string("%d ms", F.bround("p50", 0).cast("long"))))
    exact = [rate("exact_rate")] if "exact_rate" in fields.columns else []
    each = line(at("5", F.col("field").cast("string")), cells(text("field"), rate("found_rate"), rate("correct_rate"), *exact, F.coalesce(F.format_string("%.3f", "mean_cer"), F.lit("-")), rate("accept_rate"), rate("accept_precision"), text("false_accepts")))
    # the lines of a level in one go, so that levels are worked out once
    return levels.select(F.inline(F.when(F.col("by_condition"), F.array(part)).otherwise(F.array(*whole)))).unionByName(fields.select(F.inline(F.array(each))))


#: Thresholds that the calibration report always shows.
SHOWN = [50, 70, 80, 85, 90, 95]


def calibration_report(fields: DataFrame, kind: str = "kind", aim: float = 0.98) -> DataFrame:
    """The rows of calibration() that a report shows: some thresholds that accept any field, and the recommended one; a kind without one has a row with a null threshold besides."""
    own = calibration(fields, kind, aim).where("n > 0")
    shown = own.where(F.round(F.col("threshold") * 100).cast("int").isin(*SHOWN) | F.col("recommended"))
    missing = own.groupBy(kind).agg(F.bool_or("recommended").alias("any")).where("NOT any")
    nothing = missing.select(kind, *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("threshold", "n", "precision", "coverage")], F.lit(False).alias("recommended"))
    return shown.select(*nothing.columns).unionByName(nothing)


def percent(part: Column, whole: Column) -> Column:
    """Percentage with one decimal as text, a dash without a whole."""
    return F.when(whole > 0, F.format_string("%.1f%%", 100 * part / whole)).otherwise("-")


def share(condition: Column) -> Column:
    return F.avg(condition.cast("int").cast("double"))


def group_report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of rows (status, all_correct): n, shares of each status, of all correct, and of OK but wrong."""
    shares = {s.lower(): share(F.col("status") == s) for s in ("OK", "PARTIAL", "FAIL")}
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[c.alias(f"share_{k}") for k, c in shares.items()], share(F.col("all_correct")).alias("share_correct"), share((F.col("status") == "OK") & ~F.col("all_correct")).alias("share_ok_wrong"))


def field_report(fields: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of fields (found, correct, accepted, cer, and exact if there is one): rates over all rows, those that weren't scored (nulls) included, mean CER of the scored ones, precision of the accepted ones and their errors."""
    rate = lambda c: F.count_if(F.col(c)) / F.count("*")
    exact = [rate("exact").alias("exact_rate")] if "exact" in fields.columns else []
    return fields.groupBy(*keys).agg(
        F.count("*").alias("n"),
        rate("found").alias("found_rate"),
        rate("correct").alias("correct_rate"),
        *exact,
        F.avg("cer").alias("mean_cer"),
        rate("accepted").alias("accept_rate"),
        F.avg(F.when(F.col("accepted"), F.col("correct").cast("int").cast("double"))).alias("accept_precision"),
        F.count_if(F.col("accepted") & ~F.col("correct")).alias("false_accepts"),
    )


def latency(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per group: p50 (the mean of the middle two) and p95, the value at floor(0.95 * (n - 1)) in order.

    The place in the order comes from a count of each value, so that no group is sorted by row or collected.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumns({"upto": F.sum("c").over(order), "n": F.sum("c").over(Window.partitionBy(*keys))})
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col(value)))
    low, high, late = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2), F.floor(0.95 * (F.col("n") - 1))
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), ((at(low) + at(high)) / 2).alias("p50"), at(late).alias("p95"))


def examples(fields: DataFrame, keys: list[str], order: list[str], most: int = 4) -> DataFrame:
    """The first few found and wrong fields of each group; the number is the report's feature."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return fields.where("found AND NOT correct").withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)


def calibration(fields: DataFrame, kind: str = "kind", aim: float = 0.98) -> DataFrame:
    """Per kind and threshold 0.50 to 0.99: n at or above it, precision, coverage, and recommended: the least threshold of at least the aimed precision.

    Fields (confidence, correct) are counted by hundredths once; the sums over thresholds work on those counts.
    """
    bins = fields.where(F.col("confidence").isNotNull()).withColumn("bin", F.least(F.floor(F.col("confidence") * 100 + 1e-9), F.lit(99)).cast("int"))
    counted = bins.groupBy(kind, "bin").agg(F.count("*").alias("c"), F.count_if("correct").alias("good"))
    totals = counted.groupBy(kind).agg(F.sum("c").alias("total"))
    steps = totals.withColumn("t", F.explode(F.sequence(F.lit(50), F.lit(99))))
    above = steps.join(counted, kind).where("bin >= t").groupBy(kind, "t").agg(F.sum("c").alias("n"), F.sum("good").alias("good"))
    out = steps.join(above, [kind, "t"], "left").fillna(0, ["n", "good"])
    out = out.withColumns({"precision": F.try_divide(F.col("good").cast("double"), F.col("n").cast("double")), "coverage": F.col("n") / F.col("total")})
    best = out.where(F.col("precision") >= aim).groupBy(kind).agg(F.min("t").alias("best"))
    return out.join(best, kind, "left").select(kind, (F.col("t") / 100).alias("threshold"), "n", "precision", "coverage", F.coalesce(F.col("t") == F.col("best"), F.lit(False)).alias("recommended"))


def number_safety(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of rows (found, correct, accepted, warned: its check digit disagrees): n, shares found and correct, wrong numbers, those accepted, those warned of, and right numbers warned of."""
    wrong = F.col("found") & ~F.col("correct")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), share(F.col("found")).alias("found_rate"), share(F.col("correct")).alias("correct_rate"), F.count_if(wrong).alias("n_wrong"), F.count_if(wrong & F.col("accepted")).alias("false_accepts"), F.count_if(wrong & F.col("warned")).alias("wrong_warned"), F.count_if(F.col("correct") & F.col("warned")).alias("correct_warned"))


#: Reasons to suspect a card.
REASONS = {"no_face": "NO_FACE_IN_PHOTO_AREA", "card_aspect": "CARD_ASPECT", "plain_background": "PLAIN_BACKGROUND"}


def signal_report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of rows (status, reasons: array of strings, null where nothing was checked): n, shares not checked and OK, and of the checked ones those suspicious and those with each reason (null without any)."""
    checked = F.col("reasons").isNotNull()
    of_checked = lambda c: F.avg(F.when(checked, c.cast("int").cast("double")))
    each = [of_checked(F.array_contains("reasons", code)).alias(name) for name, code in REASONS.items()]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), share(~checked).alias("unchecked"), share(F.col("status") == "OK").alias("share_ok"), of_checked(F.size("reasons") > 0).alias("suspicious"), *each)


def signal_markdown(report: DataFrame, errors: DataFrame, keys: list[str]) -> DataFrame:
    """(position, line) of a report in Markdown: report is that of signal_report by keys, errors that of missed(). Lines follow by position."""
    rate = lambda c: F.when(F.col(c).isNull(), "-").otherwise(F.format_string("%.1f%%", 100 * F.col(c)))
    name = F.concat_ws(" / ", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys])
    cells = [name, F.col("n").cast("string"), *[rate(c) for c in ("unchecked", "share_ok", "suspicious", *REASONS)]]
    groups = report.select(F.concat(F.lit("1:"), name).alias("position"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    counted = Window.partitionBy("error")
    listed = errors.withColumn("many", F.count("*").over(counted))
    heads = listed.where("k = 1").select(F.concat(F.lit("2:"), "error").alias("position"), F.concat(F.lit("## "), "error", F.lit(" ("), F.col("many").cast("string"), F.lit(")")).alias("line"))
    items = listed.select(F.concat(F.lit("2:"), "error", F.lit(":"), F.lpad(F.col("k").cast("string"), 6, "0")).alias("position"), F.concat(F.lit("- "), F.col("image").cast("string")).alias("line"))
    return groups.unionByName(heads).unionByName(items)


def missed(rows: DataFrame, most: int = 20) -> DataFrame:
    """The first few fakes (label) that are OK without a reason, and genuine ones with one, as error; the number is the report's feature."""
    fake = (F.col("label") == "fake") & (F.col("status") == "OK") & (F.size("reasons") == 0)
    genuine = (F.col("label") == "genuine") & (F.size("reasons") > 0)
    found = rows.where("reasons IS NOT NULL").withColumn("error", F.when(fake, "missed").when(genuine, "false_positive")).where("error IS NOT NULL")
    return found.withColumn("k", F.row_number().over(Window.partitionBy("error").orderBy("image"))).where(F.col("k") <= most)

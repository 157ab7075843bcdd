"""Acceptance of fields, verdicts on documents and the choice among attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkrow.functions.jamo import jamo
from inkrow.sources.tables import growing

#: Least confidence of each kind of field, and of a field that a check digit confirms.
THRESHOLDS, VERIFIED = {"numeric": 0.90, "text": 0.85, "address": 0.80}, 0.60


#: Of each document its fields in order, with the kind that sets their threshold; those required, and those without which it fails.
SPECS = {
    "RESIDENT_CARD": {
        "fields": {"name": "text", "name_hanja": None, "rrn": "numeric", "address": "address", "address_lines": "address", "issue_date": "numeric", "issuer": "text"},
        "required": ["name", "rrn", "address", "issue_date", "issuer"],
        "core": ["name", "rrn"],
    },
    "DRIVER_LICENSE": {
        "fields": {"license_number": "numeric", "license_region": None, "license_types": "text", "name": "text", "rrn": "numeric", "address": "address", "address_lines": "address", "aptitude_period": "numeric", "issue_date": "numeric", "conditions": "text", "serial_code": "numeric", "issuer": "text", "name_en": None, "birth_date_en": None},
        "required": ["license_number", "license_types", "name", "rrn", "address", "aptitude_period", "issue_date", "issuer"],
        "core": ["name", "rrn", "license_number"],
    },
}
#: Fixed value: fields that are evaluated though they aren't required.
EVALUATED = {"RESIDENT_CARD": [], "DRIVER_LICENSE": ["serial_code"]}


def strict_checksum(fields: DataFrame) -> DataFrame:
    """fields (field, valid, warnings) where a number whose check digit disagrees isn't valid."""
    wrong = (F.col("field") == "rrn") & F.array_contains("warnings", "CHECKSUM_MISMATCH:rrn")
    return fields.withColumn("valid", F.col("valid") & ~F.coalesce(wrong, F.lit(False)))


def with_spec(fields: DataFrame, document_type: str = "document_type") -> DataFrame:
    """fields (field, document type) with kind, core and required by SPECS; a field that its document doesn't have goes."""
    named = lambda kind: F.array(*[F.lit(f"{d}.{f}") for d, spec in SPECS.items() for f in spec[kind]])
    key = F.concat_ws(".", document_type, "field")
    kinds = F.create_map(*[F.lit(x) for d, spec in SPECS.items() for f, k in spec["fields"].items() if k for x in (f"{d}.{f}", k)])
    return fields.where(F.array_contains(named("fields"), key)).withColumns({"kind": kinds[key], "core": F.array_contains(named("core"), key), "required": F.array_contains(named("required"), key)})


def assemble(fields: DataFrame, images: DataFrame, mask: bool = False) -> DataFrame:
    """One result a row of images (image, document_type, n_lines, decoded): image, document_type, status, fail_reason, fields, field_meta, warnings, derived.

    fields are those of the extractors (image, field, value, confidence, valid, verified, warnings, boxes, derived). The maps fields and field_meta have an entry for every field of the document's
    SPECS, null where it wasn't found; confidences are rounded to four digits; mask hides the last six digits of the number. An image that can't be
    decoded, has no line or is of no known document fails with that reason and empty maps. Every image gives a row; its fields are few.
    """
    typed = fields.join(growing(images.select("image", "document_type")), "image")
    own = accepted(with_spec(typed))
    value = F.when((F.col("field") == "rrn") & F.lit(mask), F.concat(F.left("value", F.lit(8)), F.lit("******"))).otherwise(F.col("value"))
    item = F.struct("field", value.alias("value"), F.round("confidence", 4).alias("confidence"), "valid", "accepted", "boxes", "warnings", "derived")
    held = own.groupBy("image").agg(F.collect_list(item).alias("found"), F.coalesce(F.count_if(F.col("accepted") & F.col("core")), F.lit(0)).alias("n_core"), F.count_if(F.col("accepted") & F.col("required")).alias("n_required"))
    out = images.join(growing(held), "image", "left")
    kind = F.col("document_type")
    pick = lambda make, default: F.coalesce(*[F.when(kind == d, make(spec)) for d, spec in SPECS.items()], default)
    names = pick(lambda s: F.array(*map(F.lit, s["fields"])), F.array().cast("array<string>"))
    reason = F.when(~F.coalesce("decoded", F.lit(True)), "IMAGE_DECODE_ERROR").when(F.coalesce("n_lines", F.lit(0)) == 0, "NO_TEXT").when(~F.coalesce(kind.isin(*SPECS), F.lit(False)), "UNSUPPORTED_DOCUMENT")
    n_core = F.coalesce("n_core", F.lit(0)) == pick(lambda s: F.lit(len(s["core"])), F.lit(0))
    n_all = F.coalesce("n_required", F.lit(0)) == pick(lambda s: F.lit(len(s["required"])), F.lit(0))
    found = lambda name: F.try_element_at(F.filter("found", lambda x: x["field"] == name), F.lit(1))
    asked = F.when(reason.isNull(), names).otherwise(F.array().cast("array<string>"))
    # each name meets its field once
    out = out.withColumn("met", F.transform(asked, lambda n: F.struct(n.alias("key"), found(n).alias("own"))))
    entry = lambda m: F.struct(m["key"].alias("key"), m["own"]["value"].alias("value"))
    meta = lambda m: F.struct(m["key"].alias("key"), F.struct(m["own"].isNotNull().alias("found"), m["own"]["confidence"].alias("confidence"), m["own"]["boxes"].alias("bbox"), m["own"]["valid"].alias("valid"), F.coalesce(m["own"]["accepted"], F.lit(False)).alias("accepted")).alias("value"))
    in_order = F.flatten(F.transform("met", lambda m: F.coalesce(m["own"]["warnings"], F.array().cast("array<string>"))))
    told = F.filter(F.transform("met", lambda m: m["own"]["derived"]), lambda d: F.size(d) > 0)
    derived = F.aggregate(told, F.create_map().cast("map<string,string>"), lambda a, d: F.map_concat(a, d))
    return out.select(
        "image", "document_type",
        F.when(reason.isNotNull() | ~n_core, "FAIL").when(n_all, "OK").otherwise("PARTIAL").alias("status"),
        F.coalesce(reason, F.when(~n_core, "LOW_CONFIDENCE")).alias("fail_reason"),
        F.map_from_entries(F.transform("met", entry)).alias("fields"), F.map_from_entries(F.transform("met", meta)).alias("field_meta"), F.array_distinct(in_order).alias("warnings"), derived.alias("derived"),
    )


#: Fields whose text is a list joined by bars, and the one that is a span.
LISTS, SPAN = ["license_types", "conditions", "address_lines"], "aptitude_period"


def documents(results: DataFrame, model: dict[str, str], schema_version: str = "1", request: Column | None = None, elapsed_ms: Column | None = None) -> DataFrame:
    """image and document: the records of assemble() (with pass and passes, as read.results gives them, or without) as JSON, one object a row.

    An object has request_id (request, or a digest of the image), status, document_type, document_side, fields, derived, field_meta, warnings, fail_reason, preprocess, model (with schema) and elapsed_ms. Every field of the
    document's SPECS is there, null where it wasn't found; lists are arrays and the period is an object of start, end and kind; a field of one box has that box, any other a list of them, a box being four pairs. Names
    are in order of the alphabet within fields, derived and field_meta.
    """
    options = {"ignoreNullFields": "false"}
    variant = lambda c: F.parse_json(F.to_json(c, options))
    value = lambda k, v: F.when(k.isin(*LISTS), variant(F.split(v, r"\|"))).when(k == SPAN, variant(F.struct(F.substring_index(v, "~", 1).alias("start"), F.nullif(F.element_at(F.split(v, "~"), -1), F.lit("")).alias("end"), F.col("derived")["kind"].alias("kind")))).otherwise(v.cast("variant"))
    pairs = lambda box: F.transform(box, lambda p: F.array(p["x"], p["y"]))
    boxes = lambda b: F.when(F.size(b) == 1, variant(pairs(F.get(b, F.lit(0))))).when(b.isNotNull(), variant(F.transform(b, pairs)))
    meta = lambda k, m: F.struct(m["found"].alias("found"), m["confidence"].alias("confidence"), boxes(m["bbox"]).alias("bbox"), m["valid"].alias("valid"), m["accepted"].alias("accepted"))
    ordered = lambda m: F.map_from_entries(F.array_sort(F.map_entries(m)))
    has = set(results.columns)
    name = F.col("pass") if "pass" in has else F.lit(None).cast("string")
    rotation = F.coalesce(F.regexp_extract(name, "^rot([0-9]+)$", 1).try_cast("int"), F.lit(0))
    made = F.struct(rotation.alias("rotation"), F.coalesce(name == "contrast", F.lit(False)).alias("contrast_enhanced"), (F.col("passes") if "passes" in has else F.lit(None).cast("long")).alias("passes"))
    kind = F.coalesce("document_type", F.lit("UNKNOWN"))
    keys = F.array_sort(F.map_keys("fields"))
    held = F.struct(
        (F.md5(F.to_json(F.struct("image")).cast("binary")) if request is None else request).alias("request_id"), "status", kind.alias("document_type"), F.when(kind == "UNKNOWN", "UNKNOWN").otherwise("FRONT").alias("document_side"),
        F.map_from_arrays(keys, F.transform(keys, lambda k: value(k, F.col("fields")[k]))).alias("fields"), ordered(F.col("derived")).alias("derived"), F.map_from_arrays(keys, F.transform(keys, lambda k: meta(k, F.col("field_meta")[k]))).alias("field_meta"),
        "warnings", "fail_reason", made.alias("preprocess"), F.create_map(*[F.lit(x) for pair in sorted({**model, "schema": schema_version}.items()) for x in pair]).alias("model"), (F.lit(None).cast("long") if elapsed_ms is None else elapsed_ms).alias("elapsed_ms"),
    )
    return results.select("image", F.to_json(held, options).alias("document"))


def face_check(faces: Column, document_type: Column, box: Column) -> Column:
    """(found, score, ok) from faces (x0, y0, x1, y1, score) on given boxes: the surest face on the photograph's side of the number's box, right of it on resident cards, else left, whose height is
    2 to 12 of the number's; without one, whether there is any face and the best score. Null without a box."""
    xs, ys = F.transform(box, lambda p: p["x"]), F.transform(box, lambda p: p["y"])
    height = F.array_max(ys) - F.array_min(ys)
    middle = lambda f: (f["x0"] + f["x1"]) / 2
    beside = lambda f: F.when(document_type == "RESIDENT_CARD", middle(f) > F.array_max(xs)).otherwise(middle(f) < F.array_min(xs))
    fits = F.filter(faces, lambda f: beside(f) & (height > 0) & F.try_divide(f["y1"] - f["y0"], height).between(2.0, 12.0))
    best = lambda some: F.round(F.coalesce(F.array_max(F.transform(some, lambda f: f["score"])), F.lit(0.0)), 3)
    good = F.coalesce(F.size(fits), F.lit(0)) > 0
    return F.when(box.isNotNull(), F.struct((F.coalesce(F.size(faces), F.lit(0)) > 0).alias("found"), F.when(good, best(fits)).otherwise(best(faces)).alias("score"), good.alias("ok")))


#: Sides of a card and how far its ratio may be off; least colour of a background, and the most of it that may be burnt out.
CARD_RATIO, RATIO_OFF, LEAST_COLOUR, MOST_CLIPPED = 85.6 / 54.0, 0.10, 12.0, 0.5


def document_checks(rows: DataFrame) -> DataFrame:
    """rows (document_type, rrn_box, faces, detector, ratio, method, colour, clipped) with face, reasons, inconclusive and suspicious.

    Without a detector faces give neither a reason nor a doubt. A card's ratio is judged where its outline was seen (method contour); null ratio or colour weren't measured.
    """
    face = F.when(F.coalesce("detector", F.lit(False)), face_check(F.col("faces"), F.col("document_type"), F.col("rrn_box")))
    off = F.abs(F.col("ratio") / CARD_RATIO - 1) > RATIO_OFF
    seen, burnt = F.col("method") == "contour", F.col("clipped") > MOST_CLIPPED
    own = rows.withColumn("face", face)
    reasons = [F.when(~F.col("face.ok"), "NO_FACE_IN_PHOTO_AREA"), F.when(seen & off, "CARD_ASPECT"), F.when(~burnt & (F.col("colour") < LEAST_COLOUR), "PLAIN_BACKGROUND")]
    doubts = [F.when(F.coalesce("detector", F.lit(False)) & F.col("face").isNull(), "FACE_NOT_CHECKED"), F.when(F.col("ratio").isNotNull() & ~seen, "CARD_EDGES_NOT_VISIBLE"), F.when(F.col("colour").isNotNull() & burnt, "BACKGROUND_OVEREXPOSED")]
    own = own.withColumns({"reasons": F.array_compact(F.array(*reasons)), "inconclusive": F.array_compact(F.array(*doubts))})
    return own.withColumn("suspicious", F.size("reasons") > 0)


def accepted(fields: DataFrame) -> DataFrame:
    """fields (kind, valid, verified, confidence) with accepted. A field without a kind needs no confidence; null valid or confidence isn't accepted."""
    limit = F.create_map(*[F.lit(x) for k, v in THRESHOLDS.items() for x in (k, v)])[F.col("kind")]
    limit = F.when(F.coalesce("verified", F.lit(False)), F.least(limit, F.lit(VERIFIED))).otherwise(limit)
    enough = F.col("kind").isNull() | limit.isNull() | F.coalesce(F.col("confidence") >= limit, F.lit(False))
    return fields.withColumn("accepted", F.coalesce("valid", F.lit(False)) & enough)


def verdicts(fields: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status, n_accepted and mean_confidence from fields (core, required, accepted, confidence): FAIL if a core field isn't accepted, OK if all required ones are, else PARTIAL."""
    own = fields.groupBy(*keys).agg(
        F.coalesce(F.bool_and(F.when(F.col("core"), F.col("accepted"))), F.lit(True)).alias("core_ok"),
        F.coalesce(F.bool_and(F.when(F.col("required"), F.col("accepted"))), F.lit(True)).alias("all_ok"),
        F.count_if("accepted").alias("n_accepted"),
        F.avg("confidence").alias("mean_confidence"),
    )
    status = F.when(~F.col("core_ok"), "FAIL").when(F.col("all_ok"), "OK").otherwise("PARTIAL")
    return own.select(*keys, status.alias("status"), "n_accepted", "mean_confidence")


def ranks(fields: DataFrame, types: DataFrame) -> DataFrame:
    """image, status, n_accepted and mean_confidence of the images of a known type in types (image, document_type): a missing field counts as not accepted, and the mean is that of the fields found."""
    own = accepted(with_spec(fields.join(growing(types.select("image", "document_type")), "image")))
    held = own.groupBy("image").agg(F.count_if(F.col("accepted") & F.col("core")).alias("n_core"), F.count_if(F.col("accepted") & F.col("required")).alias("n_required"), F.count_if("accepted").alias("n_accepted"), F.avg("confidence").alias("mean_confidence"))
    of = lambda part: F.coalesce(*[F.when(F.col("document_type") == d, len(spec[part])) for d, spec in SPECS.items()])
    status = F.when(F.col("n_core") < of("core"), "FAIL").when(F.col("n_required") == of("required"), "OK").otherwise("PARTIAL")
    every = types.where(F.col("document_type").isin(*SPECS)).select("image", "document_type").join(growing(held), "image", "left").fillna(0, ["n_core", "n_required", "n_accepted"])
    return every.select("image", status.alias("status"), "n_accepted", "mean_confidence")


def best_attempts(attempts: DataFrame, key: str, position: str, known: str | None = None) -> DataFrame:
    """The best attempt of each key and passes, the number that were run: attempts (status, n_accepted, mean_confidence) stop at the first that is OK; of equals one of a known type of document (the
    column known, true or false) goes before others, then the earliest. Null status is less than FAIL, null numbers count as 0."""
    run = Window.partitionBy(key).orderBy(position)
    stopped = F.coalesce(F.max((F.col("status") == "OK").cast("int")).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tried = attempts.withColumn("stopped", stopped).where("stopped = 0").drop("stopped")
    tried = tried.withColumn("passes", F.count("*").over(Window.partitionBy(key)))
    order = F.when(F.col("status") == "OK", 3).when(F.col("status") == "PARTIAL", 2).when(F.col("status") == "FAIL", 1).otherwise(0)
    better = [order, F.coalesce("n_accepted", F.lit(0)), F.coalesce("mean_confidence", F.lit(0.0)), *([F.coalesce(known, F.lit(False))] if known else [])]
    ranked = F.row_number().over(Window.partitionBy(key).orderBy(*[c.desc() for c in better], position))
    return tried.withColumn("k", ranked).where("k = 1").drop("k")


def attempt_order(vertical: Column, unknown: Column, title_low: Column) -> Column:
    """The further attempts at an image in order, by how its first one looks; the first condition that holds counts, null ones don't."""
    order = lambda *names: F.array(*map(F.lit, names))
    return F.when(vertical, order("rot90", "rot270", "contrast", "rot180")).when(unknown, order("rot180", "rot90", "rot270", "contrast")).when(title_low, order("rot180", "contrast", "rot90", "rot270")).otherwise(order("contrast", "rot90", "rot270", "rot180"))


def deletions(form: Column, most: int) -> Column:
    """Hashes of form and of what is left of it without up to most of its characters."""
    shorter = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.left(t, i - 1), F.substring(t, i + 1, F.length(t))))
    left, every = F.array(form), F.array(form)
    for _ in range(most):
        left = F.array_distinct(F.flatten(F.transform(left, shorter)))
        every = F.array_union(every, left)
    return F.transform(every, lambda t: F.xxhash64(t))


def nearest(words: DataFrame, candidates: DataFrame, most: int, word: str = "word", candidate: str = "candidate", within: list[str] = [], letters: bool = False) -> DataFrame:
    """word and found, beside the columns named in within, which must agree: the one candidate at the least edit distance, at most most, of those whose length differs by at most 1; null if none or several.

    Words are compared once each, by the letters of their syllables if letters is set. Texts at a distance of d share what is left of them without d characters each, so words and candidates join by
    such remainders, and only pairs that share one are compared. A word of n characters has at most n ** most remainders, so most is 1 or 2 for long words.
    """
    form = jamo if letters else (lambda c: c)
    own = words.select(*within, F.col(word).alias("word")).where("word IS NOT NULL").distinct()
    listed = candidates.select(*within, F.col(candidate).alias("candidate")).where("candidate IS NOT NULL").distinct()
    near = own.withColumn("form", form(F.col("word"))).withColumn("key", F.explode(deletions(F.col("form"), most)))
    index = listed.withColumn("other", form(F.col("candidate"))).withColumn("key", F.explode(deletions(F.col("other"), most)))
    pairs = near.join(index, [*within, "key"]).where(F.abs(F.length("word") - F.length("candidate")) <= 1).select(*within, "word", "candidate", "form", "other").distinct()
    scored = pairs.withColumn("d", F.levenshtein("form", "other", most)).where("d >= 0")
    least = scored.groupBy(*within, "word", "d").agg(F.count("*").alias("ties"), F.min("candidate").alias("found"))
    best = least.groupBy(*within, "word").agg(F.min_by(F.struct("ties", "found"), "d").alias("b"))
    return own.join(best, [*within, "word"], "left").select(*within, F.col("word").alias(word), F.when(F.col("b.ties") == 1, F.col("b.found")).alias("found"))

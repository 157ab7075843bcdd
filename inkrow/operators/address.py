"""Addresses set right by a dictionary of provinces, districts and, if given, further words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkrow.functions.jamo import jamo_distance
from inkrow.functions.text import PROVINCES, collapse_spaces, let
from inkrow.operators.decide import nearest
from inkrow.sources.tables import stored

#: Short names that stay as they are, names no longer in use.
ALIASES = {"서울시": "서울특별시", "부산시": "부산광역시", "대구시": "대구광역시", "인천시": "인천광역시", "광주시": "광주광역시", "대전시": "대전광역시", "울산시": "울산광역시", "세종시": "세종특별자치시"}
FORMER = ["강원도", "전라북도"]


def fix_spacing(text: Column) -> Column:
    """Spaces that were lost: before a house number, round brackets, and between block, house and floor.

    The address is taken apart into numbers, Hangul, brackets and the rest; whether a space belongs before a part follows from its neighbours.
    """
    cut = F.regexp_extract_all(text, F.lit(r"[0-9]+(?:-[0-9]+)?|[가-힣]+|[()]|[^0-9가-힣()]+"), 0)

    def spaced(parts: Column, own: Column, i: Column) -> Column:
        at = lambda k: F.try_element_at(parts, F.nullif(F.greatest(i + 1 + k, F.lit(0)), F.lit(0)))
        before, earlier, after, later = at(-1), at(-2), at(1), at(2)
        number, plain = own.rlike("^[0-9]"), own.rlike("^[0-9]+$")
        word, is_number = before.rlike("[가-힣]$"), before.rlike("[0-9]$")
        street = number & (before.endswith("로") | before.endswith("길")) & (after.isNull() | after.startswith(" ") | (after == "("))
        unit = plain & earlier.rlike("[0-9]$") & (((before == "동") & after.startswith("호")) | ((before == "차") & after.startswith("층")))
        block = plain & word & (after == "차") & (later == ")")
        quarter = number & before.endswith("동") & (F.length(before) >= 2)
        bracket = ((own == "(") & (word | is_number)) | ((before == ")") & (number | own.rlike("^[가-힣]")))
        needs = reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in (street, unit, block, quarter, bracket)))
        return F.when(needs, F.concat(F.lit(" "), own)).otherwise(own)

    return collapse_spaces(F.array_join(let(cut, lambda parts: F.transform(parts, lambda own, i: spaced(parts, own, i))), ""))


def looks_like_district(word: Column) -> Column:
    ends = [jamo_distance(F.right(word, F.lit(1)), F.lit(s)) <= 1 for s in "시군구"]
    return F.coalesce((F.length(word) >= 2) & (ends[0] | ends[1] | ends[2]), F.lit(False))


def split_district(name: Column) -> Column:
    """A district of a city (X시Y구) as its two names, any other as one."""
    parts = [F.regexp_extract(name, "^(.+시)(.+구)$", i) for i in (1, 2)]
    return F.when(parts[0] != "", F.array(*parts)).otherwise(F.array(name))


def correct(addresses: DataFrame, provinces: DataFrame, districts: DataFrame, words: DataFrame | None = None, text: str = "address") -> DataFrame:
    """addresses with corrected, changed (array of old, new) and valid (its province is known); null text gives null, none and false. All rows and other columns stay.

    provinces (province), districts (province, district) and words (word) are dictionaries. The first word is a province's short name or the
    nearest province; a province that is beyond repair follows from a district that only one province in use has. The second word, and in a
    city the third, become the nearest district of the province if they look like one. Each distinct address is set right once and joins back by its text, so that
    rows need no key; only distinct words meet the dictionaries, broadcast if Spark measures what they found small, else with skewed words split.
    """
    kept = addresses.drop("corrected", "changed", "valid")
    fixed = _corrected(stored(kept.select(F.col(text).alias("__key")).where("__key IS NOT NULL").distinct(), "address-texts"), provinces, districts, words)
    out = kept.join(fixed, F.col(text) == F.col("__key"), "left").drop("__key")
    none = F.array().cast("array<struct<old:string,new:string>>")
    return out.select(*kept.columns, "corrected", F.coalesce("changed", none).alias("changed"), F.coalesce("valid", F.lit(False)).alias("valid"))


def _corrected(addresses: DataFrame, provinces: DataFrame, districts: DataFrame, words: DataFrame | None) -> DataFrame:
    t = lambda i: F.try_element_at("__t", F.lit(i))
    own = addresses.select("__key", F.split(fix_spacing(F.col("__key")), " ").alias("__t"))
    own = own.withColumns({"__w0": t(1), "__w1": t(2), "__w2": t(3)})
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    first = nearest(own.where(alias[F.col("__w0")].isNull()), provinces, 2, "__w0", "province", letters=True).where("found IS NOT NULL").withColumnRenamed("found", "__p0")
    current = districts.where(~F.col("province").isin(*FORMER) & F.col("province").isin(*PROVINCES)).groupBy("district").agg(F.min("province").alias("__owner"), F.count_distinct("province").alias("c")).where("c = 1").select(F.col("district").alias("__w1"), "__owner")
    own = own.join(first, "__w0", "left").join(current, "__w1", "left")
    owner = F.when(F.col("__w0").rlike("[가-힣]") & looks_like_district(F.col("__w1")), F.col("__owner"))
    own = own.withColumn("province", F.coalesce(alias[F.col("__w0")], "__p0", owner)).withColumn("__n0", F.when(alias[F.col("__w0")].isNotNull(), F.col("__w0")).otherwise(F.coalesce("province", "__w0")))
    own = stored(own, "address-provinces")

    # both words meet the districts of their province at once
    ask = own.where("province IS NOT NULL").select("province", F.explode(F.array("__w1", "__w2")).alias("__ask")).where(looks_like_district(F.col("__ask")))
    near = nearest(ask, districts, 1, "__ask", "district", ["province"], True).where("found IS NOT NULL")
    for word, new in (("__w1", "__d1"), ("__w2", "__d2")):
        own = own.join(near.select("province", F.col("__ask").alias(word), F.col("found").alias(new)), ["province", word], "left")
    own = own.withColumn("__d2", F.when(F.col("__d1").endswith("시"), F.col("__d2")))
    news = [F.col("__n0"), F.coalesce("__d1", "__w1"), F.coalesce("__d2", "__w2")]
    olds = [F.col(f"__w{i}") for i in range(3)]
    pairs = F.filter(F.array(*[F.struct(o.alias("old"), n.alias("new")) for o, n in zip(olds, news)]), lambda p: p["old"] != p["new"])
    fixed = F.concat(F.filter(F.array(*news), lambda x: x.isNotNull()), F.slice("__t", 4, F.greatest(F.size("__t"), F.lit(0))))
    own = own.select("__key", F.when(F.col("__t").isNotNull(), fixed).alias("__t"), pairs.alias("changed"), F.col("province").isNotNull().alias("valid"))
    if words is not None:
        own = stored(own, "address-districts")
        each = own.select("__key", F.posexplode("__t").alias("i", "w")).withColumn("stem", F.regexp_replace("w", r"[()\d]+", ""))
        asked = each.where((F.length("stem") >= 2) & F.col("stem").rlike("[가-힣]"))
        found = nearest(asked, words, 1, "stem", "word", letters=True).where("found <> stem")
        better = asked.join(found, "stem").groupBy("__key").agg(F.sort_array(F.collect_list(F.struct("i", "w", F.replace("w", "stem", "found").alias("new")))).alias("b"))
        own = own.join(better, "__key", "left").withColumn("b", F.coalesce("b", F.array().cast("array<struct<i:int,w:string,new:string>>")))
        own = own.withColumn("changed", F.concat("changed", F.transform("b", lambda x: F.struct(x["w"].alias("old"), x["new"].alias("new")))))
        own = own.withColumn("__t", F.transform("__t", lambda w, i: F.coalesce(F.try_element_at(F.filter("b", lambda x: x["i"] == i), F.lit(1))["new"], w)))
    return own.select("__key", F.array_join("__t", " ").alias("corrected"), "changed", "valid")

"""Kind of document by its title, and names snapped to a closed list by likeness."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkrow.functions.likeness import Names, ratios
from inkrow.functions.text import SPACE

#: Titles, with the least score at which each counts.
RESIDENT, LICENSE, LICENSE_SHORT = ("주민등록증", 0.7), ("자동차운전면허증", 0.7), ("운전면허증", 0.8)


def likeness(text: Column, words: list[str], windows: bool = False) -> Column:
    """Per word its matching-blocks ratio against text, or with windows the best against any window of the word's length; null or empty text gives 0.

    The distinct texts of a batch are compared once each, all pairs together.
    """

    @F.arrow_udf("array<double>")
    def scores(texts: pa.Array) -> pa.Array:
        held = texts.dictionary_encode()
        distinct = [*held.dictionary.to_pylist(), None]
        pairs = []
        for i, t in enumerate(distinct):
            if t:
                for j, word in enumerate(words):
                    # a text that has the whole word needs no other window
                    starts = [t.find(word)] if word in t else range(max(1, len(t) - len(word) + 1))
                    pairs += [(i, j, t[k : k + len(word)] if windows else t) for k in (starts if windows else [0])]
        out = np.zeros((len(distinct), len(words)))
        if pairs:
            i, j, spans = zip(*pairs, strict=True)
            np.maximum.at(out, (np.array(i), np.array(j)), ratios(list(spans), [words[k] for k in j]))
        places = np.arange(0, len(words) * len(texts) + 1, len(words), np.int32)
        return pa.ListArray.from_arrays(pa.array(places), pa.array(out[held.indices.fill_null(len(distinct) - 1).to_numpy(zero_copy_only=False)].ravel()))

    return scores(text)


def nearest_name(text: Column, names: list[str], least: float) -> Column:
    """The name of a closed list most like text, the first of equals, if it is as like it as least; null for null text. Lists may have many thousands of names."""
    held = Names(names)

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(texts, use_na_sentinel=False)
        asked = [i for i, t in enumerate(distinct) if isinstance(t, str)]
        own: list[str | None] = [None] * len(distinct)
        for i, name in zip(asked, held.nearest([distinct[i] for i in asked], least), strict=True):
            own[i] = name
        return pd.Series([own[c] for c in codes], index=texts.index, dtype=object)

    return found(text)


def classified(lines: DataFrame) -> DataFrame:
    """image, document_type and title (the idx of the line that told it) from lines (image, idx, text).

    A resident title wins over a licence title, that over its short form, that over the English one; of equally like lines the first counts. Without any the type is UNKNOWN; null text matches nothing.
    """
    return typed(scored(lines), [])


#: Titles in order of their weight.
TITLES = [RESIDENT, LICENSE, LICENSE_SHORT]


def scored(lines: DataFrame) -> DataFrame:
    """lines with english and scores: whether a line names the English title, and how like it is to each of TITLES, 0 where it can't count."""
    hangul = F.regexp_replace(F.coalesce("text", F.lit("")), "[^가-힣]", "")
    english = F.replace(F.lower("text"), F.lit("driver's"), F.lit("drivers")).rlike(f"drivers[{SPACE}]*licen")

    def able(title: str, least: float) -> Column:
        # m letters in common make at most 2m / (m + title's) of a text of m letters, less of longer ones
        needed = math.ceil(least * len(title) / (2 - least) - 1e-9)
        return F.length(hangul) - F.length(F.translate(hangul, title, "")) >= needed

    some = F.when(reduce(lambda a, b: a | b, (able(*t) for t in TITLES)), hangul)
    return lines.withColumns({"english": english, "scores": likeness(some, [t for t, _ in TITLES], True)})


def typed(lines: DataFrame, also: list[Column]) -> DataFrame:
    """image, document_type and title of classified() from the lines of scored(), with further aggregates of them."""
    like = [F.max(F.when(F.col("scores")[i] >= least, F.struct(F.col("scores")[i].alias("score"), (-F.col("idx")).alias("before")))).alias(f"like{i}") for i, (_, least) in enumerate(TITLES)]
    best = lines.groupBy("image").agg(*also, *like, F.min(F.when(F.col("english"), F.col("idx"))).alias("said"))
    kind = F.when(F.col("like0").isNotNull(), "RESIDENT_CARD").when(F.coalesce(F.col("like1.before"), F.col("like2.before"), "said").isNotNull(), "DRIVER_LICENSE").otherwise("UNKNOWN")
    kept = [c for c in best.columns if c not in ("image", "like0", "like1", "like2", "said")]
    return best.select("image", kind.alias("document_type"), F.coalesce(*[-F.col(f"like{i}.before") for i in range(3)], "said").alias("title"), *kept)


def document_types(lines: DataFrame) -> DataFrame:
    """image and document_type of classified()."""
    return classified(lines).select("image", "document_type")


def title_lines(lines: DataFrame, title: tuple[str, float]) -> DataFrame:
    """image and idx of the line (image, idx, text) most like the title, the first of equals, where that is enough to count."""
    scored = lines.select("image", "idx", likeness(F.regexp_replace(F.coalesce("text", F.lit("")), "[^가-힣]", ""), [title[0]], True)[0].alias("score")).where(F.col("score") >= title[1])
    return scored.groupBy("image").agg(F.max_by("idx", F.struct(F.col("score"), -F.col("idx"))).alias("idx"))


def snap_to_list(text: Column, names: list[str], least: float = 0.75) -> Column:
    """(value, changed): the name of the closed list most like text without spaces, if that is at least so like it; else text itself."""
    bare = F.regexp_replace(text, f"[{SPACE}]", "")
    found = nearest_name(bare, names, least)
    pair = lambda value, done: F.struct(value.alias("value"), done.alias("changed"))
    return F.when(found.isNotNull(), pair(found, found != bare)).otherwise(pair(text, F.lit(False)))

"""Candidate screening: word n-grams, near-duplicate keywords, CPA breaches, guardrails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adinsight.config import ClientConfig
from adinsight.functions.matching import is_brand, lowered
from adinsight.functions.numbers import ratio_null, rounded, total, units
from adinsight.operators.common import money, tenth
from adinsight.operators.findings import wasted_terms


def ngram_themes(terms: DataFrame, cfg: ClientConfig, n: int = 2, top: int | None = None) -> DataFrame:
    """Cost per distinct word n-gram of the wasted terms, of all or of the ``top`` by cost.

    Equal texts are summed first; n-grams combine map-side before the shuffle.
    """
    texts = wasted_terms(terms, cfg).groupBy("search_term").agg(F.sum(units("cost")).alias("u"))
    words = texts.select("u", F.regexp_extract_all(lowered("search_term"), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
    starts = F.sequence(F.lit(1), F.size("w") - (n - 1))
    grams = F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(F.col("w"), i, n), " ")))
    rows = words.filter(F.size("w") >= n).select(F.explode(grams).alias("ngram"), "u")
    sums = rows.groupBy("ngram").agg((F.sum("u") / 1e6).alias("cost"), F.count("*").alias("terms"))
    if top is not None:
        sums = sums.orderBy(F.col("cost").desc(), "ngram").limit(top)
    return sums.select("ngram", "terms", money("cost"))


def near_duplicates(keywords: DataFrame) -> DataFrame:
    """Groups of keywords with the same words in any order, form or repetition.

    The key is the sorted set of words; one row per group with its size, the
    smallest member and the group's cost.  No pairs are built.
    """
    words = F.regexp_extract_all(lowered("search_keyword"), F.lit("[a-z0-9]+"), F.lit(0))
    key = F.array_join(F.array_sort(F.array_distinct(words)), " ")
    spelled = keywords.groupBy(key.alias("word_key"), "search_keyword").agg(F.count("*").alias("rows"),
                                                                           F.sum(units("cost")).alias("u"))
    groups = spelled.groupBy("word_key").agg(
        F.sum("rows").alias("keywords"), F.count("*").alias("spellings"), F.min("search_keyword").alias("first"),
        (F.sum("u") / 1e6).alias("cost"),
    )
    return groups.filter("keywords > 1").select("word_key", "keywords", "spellings", "first", money("cost"))


def cpa_breaches(rows: DataFrame, limit: float, keys: Sequence[str]) -> DataFrame:
    """Entities whose cost per conversion exceeds a limit."""
    sums = rows.groupBy(*keys).agg(total("cost").alias("cost"), total("conversions").alias("conv"))
    breached = sums.withColumn("ratio", ratio_null("cost", "conv")).filter(F.col("ratio") > limit)
    return breached.select(*keys, rounded("ratio", 2).alias("cpa"), money("cost"), tenth("conv"))


def guardrails(candidates: DataFrame, cfg: ClientConfig, max_changes: int = 200) -> DataFrame:
    """Negative-keyword candidates that may be applied in one run.

    Schema check (a term and a non-negative cost), one row per term, no brand
    terms, and at most ``max_changes`` of the costliest: the cap is the rule.
    """
    valid = candidates.filter((F.trim("search_term") != "") & (F.col("cost") >= 0))
    sums = valid.filter(~is_brand("search_term", cfg)).groupBy(F.lower("search_term").alias("term")).agg(
        total("cost").alias("cost")
    )
    return sums.orderBy(F.col("cost").desc(), "term").limit(max_changes).select("term", money("cost"))


def auction_insights(rows: DataFrame) -> DataFrame:
    """Competitor shares per display domain, typed from the export's text cells.

    Shares arrive as percentages or as bounds such as ``< 10%`` (already null).
    """
    from adinsight.functions.numbers import parse_number

    shares = ("impr_share", "overlap_rate", "position_above", "top_of_page", "outranking")
    return rows.select("domain", *[(parse_number(s) / 100).alias(s) for s in shares])

"""Search terms: grades, intent, competitors, statuses and report lists.

``terms`` is the typed search-term report: search_term, search_terms_match_type
(optional), added_excluded, clicks, cost, conversions, row_index.  Report lists
are ordered by cost, then term, then row index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adinsight.config import ClientConfig
from adinsight.functions.grading import GRADES, INTENTS, STATUSES, grade_term, keyword_status
from adinsight.functions.matching import category_of, is_brand, matched_competitor, search_intent
from adinsight.functions.numbers import count_where, ratio0, ratio_null, rounded, total, whole
from adinsight.operators.common import column_or_null, label_frame, money, tenth, text_column, with_empty_labels
from adinsight.operators.relevance import with_verdicts

UNCATEGORIZED = "Other / uncategorized"


def by_cost() -> list[Column]:
    return [F.col("cost").desc(), F.col("term"), F.col("row_index")]


def _typed(terms: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    zero = F.lit(0.0)
    return terms.select(
        text_column(terms, "search_term").alias("term"), text_column(terms, "search_terms_match_type").alias("match"),
        column_or_null(terms, "added_excluded").alias("added_excluded"),
        *[F.coalesce(F.col(m).cast("double"), zero).alias(m) for m in ("clicks", "cost", "conversions")],
        "row_index", *keep,
    )


def nonbrand(terms: DataFrame, cfg: ClientConfig, keep: Sequence[str] = ()) -> DataFrame:
    """Typed rows of the terms that hold no brand term."""
    return _typed(terms, keep).filter(~is_brand("term", cfg))


def annotate(rows: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Add grade, intent segment, category, competitor and status."""
    return rows.withColumn("grade", grade_term("clicks", "conversions")).withColumns({
        "segment": search_intent("term", cfg),
        "category": category_of("term", cfg),
        "competitor": matched_competitor("term", cfg),
        "status": keyword_status("added_excluded", "grade"),
    })


def graded(terms: DataFrame, cfg: ClientConfig, keep: Sequence[str] = (), brand_terms_too: bool = False) -> DataFrame:
    """Annotated terms, without the brand terms unless asked for."""
    return annotate(_typed(terms, keep) if brand_terms_too else nonbrand(terms, cfg, keep), cfg)


def _leading(rows: DataFrame, cfg: ClientConfig, top: int) -> DataFrame:
    """The costliest rows; only they are annotated."""
    return annotate(rows.orderBy(*by_cost()).limit(top), cfg)


def _share(by: Sequence[str], name: str = "spend") -> Column:
    """Share of the group total; the window runs over the few label rows."""
    return rounded(ratio0(F.col(name), F.sum(name).over(Window.partitionBy(*by))), 4)


def _sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("terms"), total("cost").alias("spend"),
                                   total("conversions").alias("conv"))


def term_totals(terms: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Row counts and spend behind the report lists."""
    return graded(terms, cfg).agg(
        F.count("*").alias("total_terms"), total("cost").alias("s"),
        F.count("competitor").alias("competitor_total"),
        count_where(F.col("segment") == "Relevant").alias("relevant_total"),
        count_where(F.col("segment") == "Needs Review").alias("flagged_total"),
    ).select("total_terms", money("s", "total_spend"), "competitor_total", "relevant_total", "flagged_total")


def term_grades(terms: DataFrame, cfg: ClientConfig, by: Sequence[str] = ()) -> DataFrame:
    """Per grade (only grades present): terms, spend, share, conversions, CPA."""
    rank = F.array_position(F.array(*[F.lit(g) for g in GRADES]), F.col("grade"))
    rows = _sums(graded(terms, cfg, by), [*by, "grade"]).withColumn("position", rank)
    return rows.orderBy(*by, "position").select(
        *by, "grade", "terms", money("spend"), _share(by).alias("spend_share"), whole("conv").alias("conv"),
        rounded(ratio_null("spend", "conv"), 2).alias("cpa"),
    )


def _labelled(terms: DataFrame, cfg: ClientConfig, key: str, labels: Sequence[str], by: Sequence[str]) -> DataFrame:
    sums = _sums(graded(terms, cfg, by), [*by, key]).drop("conv")
    if not by:
        sums = with_empty_labels(sums, [key], label_frame(terms.sparkSession, [key], [(n,) for n in labels]))
    return sums.select(*by, key, "terms", money("spend"), _share(by).alias("spend_share"))


def intent_segments(terms: DataFrame, cfg: ClientConfig, by: Sequence[str] = ()) -> DataFrame:
    """Terms and spend per intent; all four segments appear for the whole account."""
    return _labelled(terms, cfg, "segment", INTENTS, by)


def keyword_statuses(terms: DataFrame, cfg: ClientConfig, by: Sequence[str] = ()) -> DataFrame:
    """Terms and spend per keyword status; all five statuses appear."""
    return _labelled(terms, cfg, "status", STATUSES, by)


def service_categories(terms: DataFrame, cfg: ClientConfig, by: Sequence[str] = ()) -> DataFrame:
    """Spend per product category, largest first."""
    named = graded(terms, cfg, by).withColumn("category", F.coalesce("category", F.lit(UNCATEGORIZED)))
    sums = named.groupBy(*by, "category").agg(total("cost").alias("spend")).filter("spend > 0")
    return sums.orderBy(*by, F.col("spend").desc(), "category").select(*by, "category", money("spend"))


def competitor_breakdown(terms: DataFrame, cfg: ClientConfig, by: Sequence[str] = (), top: int = 12) -> DataFrame:
    """Spend per matched competitor; with ``by`` all competitors are kept."""
    matched = graded(terms, cfg, by).filter(F.col("competitor").isNotNull())
    sums = matched.groupBy(*by, "competitor").agg(total("cost").alias("spend"))
    if not by:
        sums = sums.orderBy(F.col("spend").desc(), "competitor").limit(top)
    return sums.filter("spend > 0").select(*by, "competitor", money("spend"))


def competitor_summary(terms: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Terms, spend, share of competitor spend, conversions and CPA per competitor."""
    sums = _sums(graded(terms, cfg).filter(F.col("competitor").isNotNull()), ["competitor"])
    return sums.orderBy(F.col("spend").desc(), "competitor").select(
        "competitor", "terms", money("spend"), _share(()).alias("spend_share"), whole("conv").alias("conv"),
        rounded(ratio_null("spend", "conv"), 2).alias("cpa"),
    )


def _detail(*extra: str | Column) -> list[str | Column]:
    return [
        "term", *extra, "row_index", money("cost", "spend"), whole("clicks").alias("clicks"),
        tenth("conversions", "conv"), rounded(ratio0("conversions", "clicks"), 4).alias("cvr"),
    ]


def _cpa() -> Column:
    return rounded(ratio_null("cost", "conversions"), 2).alias("cpa")


def competitor_terms(terms: DataFrame, cfg: ClientConfig, top: int = 75) -> DataFrame:
    rows = nonbrand(terms, cfg).filter(matched_competitor("term", cfg).isNotNull())
    return _leading(rows, cfg, top).select(*_detail("competitor"), _cpa())


def relevant_terms(terms: DataFrame, cfg: ClientConfig, top: int = 150) -> DataFrame:
    rows = _leading(nonbrand(terms, cfg).filter(search_intent("term", cfg) == "Relevant"), cfg, top)
    category = F.coalesce("category", F.lit("Uncategorized")).alias("category")
    return rows.select(*_detail(category, "grade", "status"), rounded(ratio0("cost", "clicks"), 2).alias("cpc"))


def flagged_terms(terms: DataFrame, cfg: ClientConfig, top: int = 75) -> DataFrame:
    rows = _leading(nonbrand(terms, cfg).filter(search_intent("term", cfg) == "Needs Review"), cfg, top)
    return rows.select(*_detail("segment", "status"), _cpa())


# --- lists with a relevance verdict ------------------------------------------------


def _head(terms: DataFrame, cfg: ClientConfig, top: int = 60, cache: DataFrame | None = None) -> DataFrame:
    """The top terms by cost with their verdicts."""
    return with_verdicts(_leading(nonbrand(terms, cfg), cfg, top), cfg, cache)


def _listed() -> list[str | Column]:
    return [
        "term", "match", "row_index", whole("clicks").alias("clicks"), money("cost"), tenth("conversions", "conv"),
        "grade", F.col("verdict").alias("intent"), "relevant",
    ]


def top_graded(terms: DataFrame, cfg: ClientConfig, top: int = 40, cache: DataFrame | None = None) -> DataFrame:
    return _head(terms, cfg, cache=cache).orderBy(*by_cost()).limit(top).select(*_listed())


def intent_mix(terms: DataFrame, cfg: ClientConfig, cache: DataFrame | None = None) -> DataFrame:
    """Verdict categories of the top 60 terms."""
    named = _head(terms, cfg, cache=cache).groupBy(F.coalesce("verdict", F.lit("unclassified")).alias("intent"))
    rows = named.agg(F.count("*").alias("terms"), total("cost").alias("cost"))
    return rows.orderBy(F.col("cost").desc(), "intent").select("intent", "terms", money("cost"))


def relevant_top(terms: DataFrame, cfg: ClientConfig, top: int = 25, cache: DataFrame | None = None) -> DataFrame:
    rows = _head(terms, cfg, cache=cache).filter(F.col("relevant"))
    return rows.orderBy(*by_cost()).limit(top).select(*_listed())


def competitor_top(terms: DataFrame, cfg: ClientConfig, top: int = 25, cache: DataFrame | None = None) -> DataFrame:
    """Largest terms with any competitor and their verdicts."""
    candidates = nonbrand(terms, cfg).filter(matched_competitor("term", cfg).isNotNull())
    return with_verdicts(_leading(candidates, cfg, top), cfg, cache).select(*_listed())


def flagged_top(terms: DataFrame, cfg: ClientConfig, top: int = 30, cache: DataFrame | None = None) -> DataFrame:
    """Top terms without conversions that are graded F or classified irrelevant."""
    poor = (F.col("grade") == GRADES[4]) | F.coalesce(~F.col("relevant"), F.lit(False))
    rows = _head(terms, cfg, cache=cache).filter((F.col("conversions") == 0) & poor)
    return rows.orderBy(*by_cost()).limit(top).select(*_listed())


# --- waste against converting ------------------------------------------------------


def _is_waste() -> Column:
    return (F.col("cost") > 0) & (F.col("conversions") <= 0)


def _waste(terms: DataFrame) -> DataFrame:
    return _typed(terms).filter(_is_waste())


def top_waste(terms: DataFrame, cfg: ClientConfig, top: int = 20, cache: DataFrame | None = None) -> DataFrame:
    """Largest zero-conversion terms with their verdicts."""
    rows = with_verdicts(_waste(terms).orderBy(*by_cost()).limit(top), cfg, cache)
    return rows.select("term", "match", "row_index", whole("clicks").alias("clicks"), money("cost"), "relevant",
                       F.col("verdict").alias("category"))


def top_converting(terms: DataFrame, top: int = 20) -> DataFrame:
    rows = _typed(terms).filter(F.col("conversions") > 0)
    best = rows.orderBy(F.col("conversions").desc(), "term", "row_index").limit(top)
    return best.select("term", "row_index", whole("clicks").alias("clicks"), money("cost"), tenth("conversions", "conv"),
                       rounded(ratio0("cost", "conversions"), 2).alias("cpa"))


def waste_split(terms: DataFrame, cfg: ClientConfig, cache: DataFrame | None = None) -> DataFrame:
    """Total waste, split into relevant and irrelevant."""
    everything = _typed(terms).agg(F.count("*").alias("terms"), total("cost", _is_waste()).alias("waste"))
    all_terms, all_waste = everything.select("terms").scalar(), everything.select("waste").scalar()
    sums = with_verdicts(_waste(terms), cfg, cache).agg(
        total("cost", ~F.col("relevant")).alias("irr"), total("cost", F.col("relevant")).alias("rel"),
        F.count_distinct(F.when(F.col("relevant").isNotNull(), F.col("term"))).alias("classified"),
    )
    return sums.select(all_terms.alias("total_terms"), rounded(all_waste, 2).alias("waste_total"), "classified",
                       money("irr", "irrelevant_waste"), money("rel", "relevant_waste"))

"""Quality score: distribution, buckets, component ratings, grid and savings.

``keywords`` is the typed keyword report: search_keyword, campaign (optional),
quality_score (text), exp_ctr, ad_relevance, landing_page_exp, impressions,
clicks, cost, conversions, row_index.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adinsight.config import ClientConfig
from adinsight.functions.grading import RATINGS, rating
from adinsight.functions.matching import category_of, is_brand, region_value
from adinsight.functions.numbers import NUMBER_PATTERN, count_where, ratio0, rounded, total, units, whole
from adinsight.operators.common import everything, label_frame, money, rates, tenth, text_column, with_empty_labels

# Component keys with their labels, short labels and score buckets.
COMPONENTS = (
    ("exp_ctr", "Expected Click-Through Rate"),
    ("ad_relevance", "Ad Relevance"),
    ("landing_page_exp", "Landing Page Experience"),
)
SHORT_LABELS = {"exp_ctr": "Expected CTR", "ad_relevance": "Ad Relevance", "landing_page_exp": "LP Experience"}
BUCKETS = (("Poor (1-3)", 1, 3), ("Below Average (4-5)", 4, 5), ("Average (6-7)", 6, 7), ("Strong (8-10)", 8, 10))
CTR_PENALTY = 0.33


def score(c: str = "quality_score") -> Column:
    """Quality score as a whole number, null when it is not numeric."""
    text = F.trim(F.col(c).cast("string"))
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double").cast("int"))


def nonbrand_keywords(keywords: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Keywords with no brand term in the keyword or in the campaign name."""
    kept = keywords.filter(~is_brand("search_keyword", cfg) & ~is_brand(text_column(keywords, "campaign"), cfg))
    return kept.withColumn("qs", score())


def _measures() -> list[Column]:
    return [
        F.count("*").alias("keywords"), total("cost").alias("cost"), total("clicks").alias("clicks"),
        total("impressions").alias("impr"), total("conversions").alias("conv"),
    ]


def _scored(keywords: DataFrame, cfg: ClientConfig) -> DataFrame:
    """One row per score 1 to 10, zero rows included."""
    kept = nonbrand_keywords(keywords, cfg).filter(F.col("qs").between(1, 10))
    labels = label_frame(keywords.sparkSession, ["qs"], [(i,) for i in range(1, 11)])
    return with_empty_labels(kept.groupBy("qs").agg(*_measures()), ["qs"], labels)


def _shared_columns() -> list[Column]:
    return [
        "keywords", rounded(ratio0(F.col("keywords"), F.sum("keywords").over(everything())), 4).alias("kw_share"),
        money("cost"), rounded(ratio0(F.col("cost"), F.sum("cost").over(everything())), 4).alias("spend_share"),
        whole("clicks").alias("clicks"), tenth("conv"), *rates(),
    ]


def distribution(keywords: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Keywords, spend and rates per score; the shares run over the ten score rows."""
    return _scored(keywords, cfg).select("qs", *_shared_columns()).orderBy("qs")


def buckets(keywords: DataFrame, cfg: ClientConfig) -> DataFrame:
    """:func:`distribution` over the four score buckets."""
    chain = F.lit(None).cast("string")
    for label, lo, hi in BUCKETS:
        chain = F.when(F.col("qs").between(lo, hi), label).otherwise(chain)
    sums = _scored(keywords, cfg).groupBy(chain.alias("bucket")).agg(
        *[F.sum(m).alias(m) for m in ("keywords", "cost", "clicks", "impr", "conv")], F.min("qs").alias("lo")
    )
    return sums.select("bucket", *_shared_columns(), "lo").orderBy("lo").drop("lo")


def summary(keywords: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Mean score and the shares of weak (≤5) and strong (≥7) keywords."""
    kept = nonbrand_keywords(keywords, cfg).filter(F.col("qs").between(1, 10))
    sums = kept.agg(F.count("*").alias("keywords"), F.sum("qs").alias("points"),
                    count_where(F.col("qs") <= 5).alias("weak"), count_where(F.col("qs") >= 7).alias("strong"))
    return sums.filter("keywords > 0").select(
        F.col("keywords").alias("total_keywords"), rounded(ratio0("points", "keywords"), 1).alias("avg_qs"),
        rounded(ratio0("weak", "keywords"), 4).alias("pct_weak"),
        rounded(ratio0("strong", "keywords"), 4).alias("pct_strong"),
    )


def savings(keywords: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Clicks of weak keywords priced down to the CPC of score 7."""
    kept = nonbrand_keywords(keywords, cfg).filter(F.col("qs").between(1, 10))
    weak, seven = F.col("qs") <= 5, F.col("qs") == 7
    sums = kept.agg(total("cost", weak).alias("wc"), total("clicks", weak).alias("wk"),
                    total("cost", seven).alias("sc"), total("clicks", seven).alias("sk"))
    now, target = ratio0("wc", "wk"), ratio0("sc", "sk")
    return sums.select(
        rounded(F.col("wk") * F.greatest(F.lit(0.0), now - target), 2).alias("amount"),
        rounded(now, 2).alias("cpc_weak"), rounded(target, 2).alias("cpc_qs7"),
    )


def portfolio_totals(keywords: DataFrame, cfg: ClientConfig) -> DataFrame:
    kept = nonbrand_keywords(keywords, cfg).filter(F.col("qs").between(1, 10))
    return kept.agg(*_measures()).select("keywords", money("cost"), whole("clicks").alias("clicks"), tenth("conv"),
                                         *rates())


# --- component ratings ------------------------------------------------------------

EVERYTHING = "(all)"


def component_ratings(keywords: DataFrame, cfg: ClientConfig, by: Sequence[str] = ()) -> DataFrame:
    """Component × rating roll-up with the CPC difference to the portfolio average.

    Each row fans out to its three components plus one portfolio entry before
    the map-side aggregation, so one pass yields the ratings and the average.
    """
    entries = [F.struct(F.lit(key).alias("component"), rating(key).alias("rating")) for key, _ in COMPONENTS]
    entries.append(F.struct(F.lit(EVERYTHING).alias("component"), F.lit(EVERYTHING).alias("rating")))
    kept = nonbrand_keywords(keywords, cfg)
    fanned = kept.select(*by, "cost", "clicks", "impressions", "conversions", F.inline(F.array(*entries)))
    grouped = fanned.filter(F.col("rating").isNotNull()).groupBy(*by, "component", "rating").agg(*_measures())
    if not by:
        cells = product([key for key, _ in COMPONENTS], RATINGS)
        grouped = with_empty_labels(grouped, ["component", "rating"],
                                    label_frame(keywords.sparkSession, ["component", "rating"], cells))
    whole_of = Window.partitionBy(*by)
    within = Window.partitionBy(*by, "component")
    portfolio = F.col("component") == EVERYTHING
    average = ratio0(F.max(F.when(portfolio, F.col("cost"))).over(whole_of),
                     F.max(F.when(portfolio, F.col("clicks"))).over(whole_of))
    cpc = F.try_divide(F.col("cost"), F.col("clicks"))
    rows = grouped.withColumn("avg_cpc", average).withColumn("in_component", F.sum("keywords").over(within))
    return rows.filter(~portfolio).select(
        *by, "component", "rating", "keywords",
        rounded(ratio0("keywords", "in_component"), 4).alias("kw_share"), money("cost", "spend"), *rates(),
        tenth("conv"), rounded(F.try_divide(cpc - F.col("avg_cpc"), F.col("avg_cpc")), 4).alias("cpc_vs_avg"),
    )


def brand_portfolio(keywords: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Per brand: spend, share of the portfolio, average CPC and mean score.

    The share window runs over one row per brand of the account.
    """
    kept = nonbrand_keywords(keywords, cfg)
    sums = kept.groupBy("brand").agg(total("cost").alias("cost"), total("clicks").alias("clicks"),
                                     F.sum("qs").alias("points"), F.count("qs").alias("scored"))
    return sums.select(
        "brand", money("cost", "total_spend"),
        rounded(ratio0(F.col("cost"), F.sum("cost").over(everything())), 4).alias("pct_portfolio"),
        rounded(ratio0("cost", "clicks"), 2).alias("avg_cpc"), rounded(ratio0("points", "scored"), 1).alias("wtd_avg_qs"),
    )


def component_grid(keywords: DataFrame, cfg: ClientConfig, by: Sequence[str] = ()) -> DataFrame:
    """The 27 combinations of the three ratings (expected CTR × page × relevance).

    Without ``by`` empty combinations are reported as zero rows.
    """
    keys = ["exp_ctr", "landing_page_exp", "ad_relevance"]
    rated = nonbrand_keywords(keywords, cfg).select(*by, *[rating(k).alias(k) for k in keys], "qs", "cost", "clicks")
    complete = rated.filter((F.col("qs") != 0) & F.col("exp_ctr").isNotNull() & F.col("landing_page_exp").isNotNull()
                            & F.col("ad_relevance").isNotNull())
    grouped = complete.groupBy(*by, *keys).agg(total("cost").alias("cost"), total("clicks").alias("clicks"),
                                               F.sum("qs").alias("points"), F.count("*").alias("keywords"))
    if not by:
        labels = label_frame(keywords.sparkSession, keys, product(RATINGS, repeat=3))
        grouped = with_empty_labels(grouped, keys, labels)
    return grouped.select(
        *by, *keys, rounded(ratio0("cost", "clicks"), 2).alias("cpc"), money("cost", "spend"),
        rounded(ratio0("points", "keywords"), 1).alias("qs"), "keywords",
    )


def ctr_spend_share(keywords: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Spend of the grid per expected-CTR rating as a share of all non-brand spend."""
    kept = nonbrand_keywords(keywords, cfg)
    gridded = (F.col("qs") != 0) & rating("landing_page_exp").isNotNull() & rating("ad_relevance").isNotNull()
    sums = kept.agg(total("cost").alias("all_cost"),
                    *[total("cost", gridded & (rating("exp_ctr") == r)).alias(r) for r in RATINGS])
    rows = F.array(*[F.struct(F.lit(r).alias("rating"), F.col(f"`{r}`").alias("cost")) for r in RATINGS])
    return sums.select("all_cost", F.inline(rows)).select(
        "rating", rounded(ratio0("cost", "all_cost"), 4).alias("spend_share")
    )


def savings_by_brand(keywords: DataFrame, cfg: ClientConfig, by: Sequence[str] = ()) -> DataFrame:
    """Weak keywords (score ≤5): spend, CPC against score 7, savings and main gap."""
    kept = nonbrand_keywords(keywords, cfg)
    weak, seven = F.col("qs") <= 5, F.col("qs") == 7
    below = [count_where(weak & (rating(key) == RATINGS[2])).alias(f"b_{key}") for key, _ in COMPONENTS]
    sums = kept.groupBy(*by).agg(
        count_where(weak).alias("kws_weak"), total("cost", weak).alias("wc"), total("clicks", weak).alias("wk"),
        total("cost", seven).alias("sc"), total("clicks", seven).alias("sk"), total("cost").alias("all_cost"),
        F.count("*").alias("rows"), *below,
    ).filter("rows > 0")
    worst = F.greatest(*[F.col(f"b_{key}") for key, _ in COMPONENTS])
    name = F.coalesce(*[F.when(F.col(f"b_{key}") == worst, F.lit(SHORT_LABELS[key])) for key, _ in COMPONENTS])
    percent = whole(F.try_divide(worst, F.col("kws_weak")) * 100)
    gap = F.when(worst > 0, F.concat(name, F.lit(" ("), percent.cast("string"), F.lit("% below avg)")))
    now, target = ratio0("wc", "wk"), ratio0("sc", "sk")
    saved = F.col("wk") * F.greatest(F.lit(0.0), now - target)
    brand = F.col("brand") if "brand" in by else F.lit(cfg.brand_label)
    return sums.select(
        brand.alias("brand"), "kws_weak", money("wc", "spend_weak"), rounded(now, 2).alias("cpc_current"),
        rounded(target, 2).alias("cpc_target"), rounded(saved, 2).alias("savings"),
        rounded(ratio0(saved, F.col("all_cost")), 4).alias("pct_brand_spend"),
        F.coalesce(gap, F.lit("—")).alias("primary_gap"),
    )


def dominant_region(keyword_geo: DataFrame) -> DataFrame:
    """Per lower-case keyword the region with the largest cost (mergeable arg-max)."""
    spent = (
        keyword_geo.filter(F.col("search_keyword") != "")
        .groupBy(F.lower("search_keyword").alias("kw"), region_value(keyword_geo.columns).alias("region"))
        .agg(F.sum(units("cost")).alias("cost_u"))
        .filter(F.col("region").isNotNull())
    )
    best = spent.groupBy("kw").agg(F.min(F.struct((-F.col("cost_u")).alias("c"), F.col("region"))).alias("m"))
    return best.select("kw", F.col("m.region").alias("region"))


def _improvable(keywords: DataFrame, cfg: ClientConfig) -> DataFrame:
    return nonbrand_keywords(keywords, cfg).filter(F.col("qs") <= 6)


def optimization_keywords(keywords: DataFrame, keyword_geo: DataFrame, cfg: ClientConfig, top: int = 100) -> DataFrame:
    """Keywords with score ≤6 by spend, with category, ratings and dominant region.

    The cut comes first: regions are then computed for at most ``top`` keywords.
    """
    weak = _improvable(keywords, cfg)
    best = weak.orderBy(F.coalesce("cost", F.lit(0.0)).desc(), "search_keyword", "row_index").limit(top)
    best = best.withColumn("kw", F.lower("search_keyword"))
    wanted = F.broadcast(best.select("kw").distinct())  # at most `top` keywords
    geo = keyword_geo.withColumn("kw", F.lower("search_keyword")).join(wanted, "kw", "left_semi").drop("kw")
    dash = F.lit("—")
    return best.join(F.broadcast(dominant_region(geo)), "kw", "left").select(
        F.col("search_keyword").alias("keyword"), F.lit(cfg.brand_label).alias("brand"),
        F.coalesce("region", dash).alias("region"), F.coalesce(category_of("search_keyword", cfg), dash).alias("category"),
        "qs", money("cost", "spend"), whole("clicks").alias("clicks"),
        rounded(ratio0("cost", "clicks"), 2).alias("cpc"),
        *[F.coalesce(rating(key), dash).alias(key) for key, _ in COMPONENTS], tenth("conversions", "conv"),
        "row_index",
    )


def optimization_options(keywords: DataFrame, keyword_geo: DataFrame, cfg: ClientConfig) -> DataFrame:
    """All categories and dominant regions among the improvable keywords, and their number."""
    weak = _improvable(keywords, cfg).select(F.lower("search_keyword").alias("kw"),
                                             category_of("search_keyword", cfg).alias("category"))
    per_keyword = weak.groupBy("kw", "category").agg(F.count("*").alias("n"))
    joined = per_keyword.join(dominant_region(keyword_geo), "kw", "left")
    kinds = F.array(
        F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")),
        F.struct(F.lit("region").alias("kind"), F.col("region").alias("value")),
        F.struct(F.lit("total").alias("kind"), F.lit("keywords").alias("value")),
    )
    options = joined.select("n", F.inline(kinds)).filter(F.col("value").isNotNull())
    return options.groupBy("kind", "value").agg(F.sum("n").alias("keywords")).orderBy("kind", "value")


def component_counts(keywords: DataFrame) -> DataFrame:
    """All keywords (brand included): count and cost per component and raw rating."""
    shown = (*RATINGS, "—")
    def cell(key: str) -> Column:
        text = F.trim(F.coalesce(F.col(key), F.lit("")))
        return F.struct(F.lit(key).alias("component"), F.when(text == "", "—").otherwise(text).alias("rating"))
    fanned = keywords.select("cost", F.inline(F.array(*[cell(key) for key, _ in COMPONENTS])))
    sums = fanned.filter(F.col("rating").isin(*shown)).groupBy("component", "rating").agg(
        F.count("*").alias("keywords"), total("cost").alias("cost")
    )
    return sums.select("component", "rating", "keywords", money("cost"))


def ctr_penalty(keywords: DataFrame) -> DataFrame:
    """Spend on keywords rated below average for expected CTR, and the modelled saving."""
    low = F.lower("exp_ctr") == RATINGS[2].lower()
    sums = keywords.agg(total("cost", low).alias("cost"))
    return sums.select(money("cost", "below_ctr_spend"),
                       rounded(F.col("cost") * CTR_PENALTY, 2).alias("savings_estimate"))

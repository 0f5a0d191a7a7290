"""Keyword tables, keyword × region pivot and per-brand keyword rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adinsight.config import ClientConfig
from adinsight.functions.grading import heat_sqrt, keyword_status
from adinsight.functions.matching import category_of, is_brand, region_value
from adinsight.functions.numbers import ratio0, ratio_null, rounded, total, units, whole
from adinsight.operators.common import everything, column_or_null, money, shuffle_width, tenth, top_per_group


def top_keywords(keywords: DataFrame, top: int = 40) -> DataFrame:
    """Largest keywords by cost."""
    best = keywords.orderBy(F.coalesce("cost", F.lit(0.0)).desc(), "search_keyword", "row_index").limit(top)
    return best.select(
        F.col("search_keyword").alias("keyword"), F.col("search_keyword_match_type").alias("match"),
        F.col("quality_score").alias("qs"), whole("clicks").alias("clicks"), money("cost"), tenth("conversions", "conv"),
        rounded(ratio0("cost", "conversions"), 2).alias("cpa"), "row_index",
    )


def _cells(keyword_geo: DataFrame) -> DataFrame:
    """Exact micro sums per keyword × region."""
    named = keyword_geo.select(
        F.col("search_keyword").alias("keyword"), region_value(keyword_geo.columns).alias("region"),
        column_or_null(keyword_geo, "search_keyword_match_type").alias("match"), "cost", "conversions",
    ).filter((F.col("keyword") != "") & F.col("region").isNotNull())
    return named.groupBy("keyword", "region").agg(
        F.sum(units("cost")).alias("spend_u"), F.sum(units("conversions")).alias("conv_u"), F.min("match").alias("match")
    )


def _by_keyword(keyword_geo: DataFrame, cfg: ClientConfig) -> DataFrame:
    sums = _cells(keyword_geo).groupBy("keyword").agg(
        F.sum("spend_u").alias("spend_u"), F.sum("conv_u").alias("conv_u"), F.min("match").alias("match")
    )
    return sums.withColumn("branded", is_brand("keyword", cfg))


def leading_keywords(keyword_geo: DataFrame, cfg: ClientConfig, top: int = 100) -> DataFrame:
    """Per branded flag: the union of the top keywords by spend and by conversions.

    Both ranks are taken in one shuffle per level; a salt splits the two flag
    values, so the final ranking sees at most ``2 × top × salts`` rows per flag.
    """
    keywords = _by_keyword(keyword_geo, cfg)
    salted = keywords.withColumn("_salt", F.pmod(F.xxhash64("keyword"), F.lit(shuffle_width(keywords))))

    def ranked(df: DataFrame, *groups: str) -> DataFrame:
        order = {m: Window.partitionBy(*groups).orderBy(F.col(f"{m}_u").desc(), "keyword") for m in ("spend", "conv")}
        out = df.withColumn("by_spend", F.row_number().over(order["spend"]))
        out = out.withColumn("by_conv", F.row_number().over(order["conv"]))
        return out.filter((F.col("by_spend") <= top) | (F.col("by_conv") <= top))

    return ranked(ranked(salted, "branded", "_salt"), "branded").drop("_salt")


def leading_regions(keyword_geo: DataFrame, top: int = 25) -> DataFrame:
    sums = _cells(keyword_geo).groupBy("region").agg(F.sum("spend_u").alias("spend_u"), F.sum("conv_u").alias("conv_u"))
    return sums.orderBy(F.col("spend_u").desc(), "region").limit(top)


def region_axis(keyword_geo: DataFrame, top: int = 25) -> DataFrame:
    """The largest regions by spend: the columns of the pivot."""
    return leading_regions(keyword_geo, top).select(
        "region", rounded(F.col("spend_u") / 1e6, 2).alias("spend"), rounded(F.col("conv_u") / 1e6, 1).alias("conv")
    )


def region_pivot(keyword_geo: DataFrame, cfg: ClientConfig, top: int = 100, regions: int = 25) -> DataFrame:
    """Keyword × region cells in long form for the leading keywords and regions.

    At most ``4 × top`` keywords and ``regions`` regions are broadcast.
    """
    keep = leading_keywords(keyword_geo, cfg, top).select(
        "keyword", "branded", F.col("spend_u").alias("all_spend"), F.col("conv_u").alias("all_conv")
    )
    axis = leading_regions(keyword_geo, regions).select("region")
    cells = _cells(keyword_geo).join(F.broadcast(keep), "keyword").join(F.broadcast(axis), "region", "left_semi")
    return cells.select(
        "keyword", "match", category_of("keyword", cfg).alias("category"), F.lit(cfg.brand_label).alias("brand"),
        "branded", "region",
        rounded(F.col("spend_u") / 1e6, 2).alias("spend"), rounded(F.col("conv_u") / 1e6, 1).alias("conv"),
        rounded(F.col("all_spend") / 1e6, 2).alias("overall_spend"),
        rounded(F.col("all_conv") / 1e6, 1).alias("overall_conv"),
    )


def region_pivot_totals(keyword_geo: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Per branded flag: keywords, spend and conversions over all keywords; region count."""
    regions = _cells(keyword_geo).agg(F.count_distinct("region")).scalar()
    sums = _by_keyword(keyword_geo, cfg).groupBy("branded").agg(
        F.count("*").alias("keywords"), (F.sum("spend_u") / 1e6).alias("spend"), (F.sum("conv_u") / 1e6).alias("conv")
    )
    return sums.select("branded", "keywords", money("spend"), tenth("conv"), regions.alias("regions"))


def heatmap(keyword_geo: DataFrame, cfg: ClientConfig, branded: bool = False, criterion: str = "spend",
            metric: str = "spend", top: int = 50) -> DataFrame:
    """Top keywords of a segment with square-root heat positions per cell.

    The maxima run over at most ``top × 25`` cells.
    """
    cells = region_pivot(keyword_geo, cfg).filter(F.col("branded") == F.lit(branded))
    names = cells.select("keyword", f"overall_{criterion}").distinct()
    best = names.orderBy(F.col(f"overall_{criterion}").desc(), "keyword").limit(top).select("keyword")
    shown = cells.join(F.broadcast(best), "keyword", "left_semi")
    return shown.select(
        "keyword", "region", F.col(metric).alias("value"), F.col(f"overall_{metric}").alias("overall"),
        rounded(heat_sqrt(F.col(metric), F.max(metric).over(everything())), 6).alias("heat"),
        rounded(heat_sqrt(F.col(f"overall_{metric}"), F.max(f"overall_{metric}").over(everything())), 6).alias("overall_heat"),
    ).filter(F.col("value") > 0)


# --- multi-brand keyword facts ----------------------------------------------------

WEIGHTED = ("impr_share", "is_lost_rank", "is_lost_bud", "qs")
RATED = ("lp_exp", "ad_rel", "ectr")


def _weighted_mean(name: str) -> Column:
    """Impression-weighted mean over the rows that carry a value and a weight."""
    usable = F.col(name).isNotNull() & (F.col("impressions") > 0)
    weight = F.when(usable, F.col("impressions").cast("decimal(19,0)"))
    weighted = F.sum(weight * units(name).cast("decimal(18,0)"))  # beyond the range of bigint: up to 38 digits
    return F.try_divide(weighted.cast("double"), F.sum(weight).cast("double")) / 1e6


def overall_values(facts: DataFrame) -> DataFrame:
    """Across-region values per brand and keyword.

    Sums stay sums, ratios are recomputed from sums, shares and scores are
    impression-weighted, ratings take the mode (smallest label on ties; the
    mode's state holds one counter per rating label).
    """
    sums = facts.groupBy("brand", "keyword").agg(
        total("spend").alias("spend"), total("conv").alias("conv"), total("impressions").alias("impr"),
        total("clicks").alias("clicks"), *[_weighted_mean(m).alias(m) for m in WEIGHTED],
        *[F.mode(F.when(F.col(r) != "", F.col(r)), True).alias(r) for r in RATED],
    )
    return sums.select(
        "brand", "keyword", money("spend"), tenth("conv"), whole("impr").alias("impressions"),
        whole("clicks").alias("clicks"), rounded(ratio_null("spend", "conv"), 2).alias("cpa"),
        rounded(ratio_null("spend", "clicks"), 2).alias("cpc"), rounded(ratio_null("conv", "clicks"), 4).alias("cvr"),
        rounded(ratio_null("clicks", "impr"), 4).alias("ctr"), *[rounded(m, 4).alias(m) for m in WEIGHTED], *RATED,
    )


def top_per_brand(facts: DataFrame, criterion: str = "spend", top: int = 50) -> DataFrame:
    """Leading keywords of every brand by spend or conversions."""
    sums = facts.groupBy("brand", "keyword").agg(F.sum(units(criterion)).alias("u"))
    order = [F.col("u").desc(), F.col("keyword")]
    best = top_per_group(sums, ["brand"], order, top, ["keyword"])
    return best.select("brand", "keyword", "rank", rounded(F.col("u") / 1e6, 2).alias("total"))


def brand_region_axis(facts: DataFrame) -> DataFrame:
    """Regions present per brand, in alphabetical order."""
    return facts.filter(F.col("region") != "").select("brand", "region").distinct().orderBy("brand", "region")


def status_summary(graded_terms: DataFrame) -> DataFrame:
    """Terms and spend by keyword status over the whole portfolio, brand terms included."""
    status = keyword_status("added_excluded", "grade")
    sums = graded_terms.groupBy(status.alias("status")).agg(F.count("*").alias("terms"), total("cost").alias("spend"))
    return sums.select("status", "terms", money("spend"),
                       rounded(ratio0(F.col("spend"), F.sum("spend").over(everything())), 4).alias("spend_share"))

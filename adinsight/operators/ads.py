"""Ads: inventory, CTR grades and the pairing of ads with landing pages.

``ads`` is the typed ad report: campaign, ad_group, ad_type, final URL columns,
headline_1..15, description_1..5, impressions, clicks, cost, conversions and a
row_index.  Lists are ordered by cost, ad group, headline, URL and row index.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adinsight.config import ClientConfig
from adinsight.functions.grading import GRADES, grade_ad, grade_page, pairing_quadrant
from adinsight.functions.matching import category_of, is_brand, url_brand
from adinsight.functions.numbers import count_where, ratio0, rounded, total, whole
from adinsight.operators.common import label_frame, money, tenth, text_column, top_per_group, with_empty_labels

UNCATEGORIZED = "Uncategorized"
SEGMENTS = ("branded", "nonbranded")


def final_url(ads: DataFrame) -> Column:
    first, second = text_column(ads, "ad_final_url"), text_column(ads, "final_url")
    return F.when(first != "", first).otherwise(second)


def _filled(ads: DataFrame, prefix: str, count: int) -> Column:
    """The non-blank texts of a numbered column family, as an array."""
    cells = [F.col(f"{prefix}_{i}") for i in range(1, count + 1) if f"{prefix}_{i}" in ads.columns]
    if not cells:
        return F.array().cast("array<string>")
    return F.filter(F.array(*cells), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")


def served(ads: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Served ads (impressions or cost) with texts, URL and segment."""
    zero = F.lit(0.0)
    campaign, group = text_column(ads, "campaign"), text_column(ads, "ad_group")
    lead = F.array_join(_filled(ads, "headline", 3), " | ")
    plain, long = text_column(ads, "headline"), text_column(ads, "long_headline")
    headline = F.when(lead != "", lead).when(plain != "", plain).otherwise(long)
    branded = is_brand(F.concat_ws(" ", campaign, group), cfg)
    base = ads.select(
        campaign.alias("campaign"), group.alias("ad_group"), text_column(ads, "ad_type").alias("type"),
        final_url(ads).alias("final_url"), F.size(_filled(ads, "headline", 15)).alias("headlines"),
        F.size(_filled(ads, "description", 5)).alias("descriptions"), headline.alias("headline"),
        F.when(branded, SEGMENTS[0]).otherwise(SEGMENTS[1]).alias("segment"),
        *[F.coalesce(F.col(m).cast("double"), zero).alias(m) for m in ("impressions", "clicks", "cost", "conversions")],
        "row_index",
    )
    return base.filter((F.col("impressions") > 0) | (F.col("cost") > 0))


def annotate(rows: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Add the category and both grades."""
    return rows.withColumns({
        "category": category_of(F.concat_ws(" ", F.col("ad_group"), F.col("headline")), cfg, UNCATEGORIZED),
        "grade": grade_ad("clicks", "impressions", F.col("segment") == SEGMENTS[0]),
        "lp_grade": grade_page("clicks", "impressions", "conversions"),
    })


def graded(ads: DataFrame, cfg: ClientConfig) -> DataFrame:
    return annotate(served(ads, cfg), cfg)


def by_cost() -> list[Column]:
    return [F.col("cost").desc(), F.col("ad_group"), F.col("headline"), F.col("final_url"), F.col("row_index")]


def _ad_columns() -> list[Column | str]:
    return [
        "segment", "ad_group", "final_url", "headline", "row_index", "category", "grade", "lp_grade",
        whole("clicks").alias("clicks"), whole("impressions").alias("impr"), money("cost"),
        tenth("conversions", "conv"), rounded(ratio0("clicks", "impressions"), 4).alias("ctr"),
        rounded(ratio0("cost", "clicks"), 2).alias("cpc"), rounded(ratio0("conversions", "clicks"), 4).alias("cvr"),
    ]


def inventory(ads: DataFrame, cfg: ClientConfig, top: int = 100) -> DataFrame:
    """Largest ads by cost; ``served`` counts all served ads.  Only the listed ads are graded."""
    rows = served(ads, cfg)
    found = rows.agg(F.count("*")).scalar()
    best = annotate(rows.orderBy(*by_cost()).limit(top), cfg)
    return best.select(*_ad_columns(), "campaign", "type", "headlines", "descriptions", found.alias("served"))


def grade_summary(ads: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Per segment and grade present: ads, traffic, spend, share and rates."""
    sums = graded(ads, cfg).groupBy("segment", "grade").agg(
        F.count("*").alias("ads"), total("impressions").alias("impr"), total("clicks").alias("clicks"),
        total("cost").alias("spend"), total("conversions").alias("conv"),
    )
    share = ratio0(F.col("spend"), F.sum("spend").over(Window.partitionBy("segment")))
    return sums.select(
        "segment", "grade", "ads", whole("impr").alias("impr"), whole("clicks").alias("clicks"),
        rounded(ratio0("clicks", "impr"), 4).alias("ctr"), rounded(share, 4).alias("spend_share"), money("spend"),
        whole("conv").alias("conv"), rounded(ratio0("conv", "clicks"), 4).alias("cvr"),
    )


def detail(ads: DataFrame, cfg: ClientConfig, top: int = 100) -> DataFrame:
    """Largest ads per segment.  A segment may hold nearly all ads, hence the salted ranking."""
    best = top_per_group(served(ads, cfg), ["segment"], by_cost(), top, ["headline", "final_url", "row_index"])
    return annotate(best, cfg).select(*_ad_columns(), "rank")


def pairing_cells(ads: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Ads and spend per ad grade × page grade, zero cells included, per segment present."""
    keys = ["segment", "grade", "lp_grade"]
    sums = graded(ads, cfg).groupBy(*keys).agg(F.count("*").alias("ads"), total("cost").alias("spend"))
    dense = with_empty_labels(sums, keys, label_frame(ads.sparkSession, keys, product(SEGMENTS, GRADES, GRADES)))
    return dense.withColumn("in_segment", F.sum("ads").over(Window.partitionBy("segment"))).filter("in_segment > 0")


def pairing_grid(ads: DataFrame, cfg: ClientConfig) -> DataFrame:
    return pairing_cells(ads, cfg).select("segment", "grade", "lp_grade", "ads", money("spend"),
                                          rounded(ratio0("ads", "in_segment"), 4).alias("pct"))


def pairing_totals(ads: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Row, column and grand totals of the grid (cube over at most 72 cells)."""
    cells = pairing_cells(ads, cfg)
    cube = cells.cube("segment", "grade", "lp_grade").agg(
        F.sum("ads").alias("ads"), F.sum("spend").alias("spend"),
        F.grouping("segment").alias("s"), F.grouping_id("segment", "grade", "lp_grade").alias("g"),
    )
    level = F.when(F.col("g") == 1, "ad_grade").when(F.col("g") == 2, "page_grade").otherwise("grand")
    return cube.filter((F.col("s") == 0) & (F.col("g") > 0)).select(
        "segment", level.alias("level"), F.coalesce("grade", "lp_grade").alias("label"), "ads", money("spend")
    )


def pairing_stats(ads: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Aligned pairs, pairs to fix on either side and low-volume pairs per segment."""
    ad, page = F.substring("grade", 1, 1), F.substring("lp_grade", 1, 1)
    strong_ad, strong_page = ad.isin("A", "B"), page.isin("A", "B")
    weak_ad, weak_page = ad.isin("D", "F"), page.isin("D", "F")
    stats = graded(ads, cfg).groupBy("segment").agg(
        F.count("*").alias("total"), count_where(strong_ad & strong_page).alias("aligned"),
        count_where(strong_ad & weak_page).alias("fix_lp"), count_where(weak_ad & strong_page).alias("fix_ad"),
        count_where((ad == "L") | (page == "L")).alias("low_vol"),
    )
    return stats.withColumn("aligned_pct", rounded(ratio0("aligned", "total"), 4))


def pairing_quadrants(ads: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Ads and spend per colour class of the grid."""
    cells = graded(ads, cfg).groupBy("segment", "grade", "lp_grade").agg(F.count("*").alias("ads"),
                                                                      total("cost").alias("spend"))
    sums = cells.groupBy("segment", pairing_quadrant("grade", "lp_grade").alias("quadrant")).agg(
        F.sum("ads").alias("ads"), F.sum("spend").alias("spend")
    )
    return sums.select("segment", "quadrant", "ads", money("spend"))


def options(ads: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Distinct categories and grades per segment, for the list filters."""
    values = F.array(
        F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")),
        F.struct(F.lit("grade").alias("kind"), F.col("grade").alias("value")),
    )
    pairs = graded(ads, cfg).select("segment", "category", "grade").distinct().select("segment", F.inline(values))
    return pairs.filter(F.col("value") != UNCATEGORIZED).distinct().orderBy("segment", "kind", "value")


def resolved_url_brand(ads: DataFrame, cfg: ClientConfig, lookup: DataFrame | None = None) -> DataFrame:
    """Ads with ``url_brand``: exact URL lookup first, then the configured fragments."""
    named = ads.withColumn("final_url", final_url(ads))
    if lookup is None:
        return named.withColumn("url_brand", url_brand("final_url", cfg))
    pages = lookup.groupBy(F.col("url").alias("final_url")).agg(F.max("brand").alias("listed"))
    joined = named.join(pages, "final_url", "left")
    found = F.when(F.col("listed") != "", F.col("listed")).otherwise(url_brand("final_url", cfg))
    return joined.withColumn("url_brand", found).drop("listed")


def page_mismatches(ads: DataFrame, cfg: ClientConfig, lookup: DataFrame | None = None) -> DataFrame:
    """Ads whose final URL belongs to another brand than the ad."""
    rows = resolved_url_brand(ads, cfg, lookup)
    return rows.filter((F.col("url_brand") != "") & (F.col("url_brand") != F.col("brand")))

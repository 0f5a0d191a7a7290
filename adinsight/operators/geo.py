"""Location performance, keyword × region ratings and ZIP overlap between brands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adinsight.config import ClientConfig
from adinsight.functions.grading import RATINGS, rating
from adinsight.functions.matching import category_of, is_brand, region_value
from adinsight.functions.numbers import ratio0, ratio_null, rounded, total, units, whole
from adinsight.operators.common import money, tenth
from adinsight.operators.quality import COMPONENTS


def _locations(geographic: DataFrame) -> DataFrame:
    """Sums per location; cost is cost per conversion × conversions of each row."""
    location = F.coalesce(F.when(F.col("state_matched") != "", F.col("state_matched")), F.lit("(not set)"))
    return geographic.groupBy(location.alias("location")).agg(
        total("clicks").alias("clicks"), total("impressions").alias("impr"), total("conversions").alias("conv"),
        total("conv_value").alias("conv_value"), total(F.col("cost_conv") * F.col("conversions")).alias("cost"),
    )


def geo_performance(geographic: DataFrame, top: int = 60) -> DataFrame:
    """Locations by cost; rows without cost are ranked by their clicks."""
    key = F.coalesce(F.nullif("cost", F.lit(0.0)), F.col("clicks"))
    best = _locations(geographic).orderBy(key.desc(), "location").limit(top)
    return best.select(
        "location", whole("clicks").alias("clicks"), whole("impr").alias("impr"), tenth("conv"),
        money("conv_value"), money("cost"), rounded(ratio0("cost", "conv"), 2).alias("cpa"),
        rounded(ratio0("conv", "clicks"), 4).alias("cvr"), rounded(ratio0("clicks", "impr"), 4).alias("ctr"),
    )


def geo_totals(geographic: DataFrame) -> DataFrame:
    """Totals over all locations, not only the reported ones."""
    sums = geographic.agg(
        total("clicks").alias("clicks"), total("impressions").alias("impr"), total("conversions").alias("conv"),
        total("conv_value").alias("conv_value"), total(F.col("cost_conv") * F.col("conversions")).alias("cost"),
    )
    return sums.select(whole("clicks").alias("clicks"), whole("impr").alias("impr"), tenth("conv"),
                       money("conv_value"), money("cost"))


def latest_ratings(keywords: DataFrame) -> DataFrame:
    """Component ratings per lower-case keyword; the last row of the file wins."""
    rated = F.struct(*[rating(key).alias(key) for key, _ in COMPONENTS])
    return (
        keywords.filter(F.col("search_keyword") != "")
        .groupBy(F.lower("search_keyword").alias("kw"))
        .agg(F.max_by(rated, "row_index").alias("r"))
        .select("kw", "r.*")
    )


def _slices(keyword_geo: DataFrame, keywords: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Per region × category: spend, and cost/clicks per component rating.

    Rows are pre-aggregated per (keyword, region) before the join, so a head
    keyword contributes one row per region; the three components become
    conditional sums instead of exploded rows.
    """
    region = region_value(keyword_geo.columns)
    per_keyword = (
        keyword_geo.filter((F.col("search_keyword") != "") & ~is_brand("search_keyword", cfg))
        .groupBy(F.lower("search_keyword").alias("kw"), region.alias("region"))
        .agg(F.sum(units("cost")).alias("cost_u"), F.sum(units("clicks")).alias("clicks_u"))
        .filter(F.col("region").isNotNull())
    )
    joined = per_keyword.join(latest_ratings(keywords), "kw", "left")
    split = [
        (F.coalesce(F.sum(F.when(F.col(key) == label, F.col(f"{m}_u"))), F.lit(0)) / 1e6).alias(f"{key}|{label}|{m}")
        for key, _ in COMPONENTS for label in RATINGS for m in ("cost", "clicks")
    ]
    return joined.groupBy("region", category_of("kw", cfg, "Uncategorized").alias("category")).agg(
        (F.sum("cost_u") / 1e6).alias("total_spend"), *split
    )


def keyword_region_ratings(keyword_geo: DataFrame, keywords: DataFrame, cfg: ClientConfig,
                           top: int = 100) -> DataFrame:
    """CPC per component rating and the below − above spread, per region × category.

    All components share the slices, so the largest slices are picked once and
    unpivoted afterwards.  ``slices`` is the number of slices before the cut.
    """
    slices = _slices(keyword_geo, keywords, cfg)
    found = slices.agg(F.count("*")).scalar()
    best = slices.orderBy(F.col("total_spend").desc(), "region", "category").limit(top)

    def part(key: str, label: str, name: str) -> list[Column]:
        cost, clicks = F.col(f"`{key}|{label}|cost`"), F.col(f"`{key}|{label}|clicks`")
        return [rounded(ratio_null(cost, clicks), 2).alias(f"{name}_cpc"), whole(clicks).alias(f"{name}_clicks")]

    names = dict(zip(RATINGS, ("above", "avg", "below")))
    blocks = [
        F.struct(F.lit(label).alias("component"), *[c for r, name in names.items() for c in part(key, r, name)])
        for key, label in COMPONENTS
    ]
    rows = best.select(
        F.lit(cfg.brand_label).alias("brand"), "region", "category", money("total_spend"), found.alias("slices"),
        F.inline(F.array(*blocks)),
    )
    return rows.withColumn("spread", rounded(F.col("below_cpc") - F.col("above_cpc"), 2))


# --- ZIP overlap ------------------------------------------------------------------


def zip_cells(spend: DataFrame, states: Sequence[str] | None = None, brand: str | None = None) -> DataFrame:
    """Per ZIP × category: the set of brands, its size and their spend.

    Spend is first summed per (zip, category, brand), so the collected set holds
    one entry per brand of the account.  ``brand`` keeps the ZIPs in which that
    brand takes part in some cell.
    """
    base = spend if states is None else spend.filter(F.col("state").isin(*states))
    per_brand = base.groupBy("zip", "state", "category", "brand").agg(F.sum(units("cost")).alias("cost_u"))
    if brand is not None:
        present = per_brand.filter(F.col("brand") == brand).select("zip").distinct()
        per_brand = per_brand.join(present, "zip", "left_semi")
    return per_brand.groupBy("zip", "state", "category").agg(
        F.array_join(F.sort_array(F.collect_set("brand")), ", ").alias("brands"),
        F.count("*").alias("n_brands"),
        (F.sum("cost_u") / 1e6).alias("spend"),
    )


def zip_overlap(spend: DataFrame, states: Sequence[str] | None = None, brand: str | None = None) -> DataFrame:
    """The overlap grid in long form: one row per populated ZIP × category cell."""
    cells = zip_cells(spend, states, brand)
    return cells.select("zip", "state", "category", "brands", "n_brands", money("spend"),
                        (F.col("n_brands") >= 2).alias("overlap"))


def _overlap_sums(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    shared = F.col("n_brands") >= 2
    return cells.groupBy(*keys).agg(
        F.sum("spend").alias("total_nb_spend"),
        F.coalesce(F.sum(F.when(shared, F.col("spend"))), F.lit(0.0)).alias("overlap_spend"),
        F.count(F.when(shared, 1)).alias("n_overlap_cats"),
    )


def zip_totals(spend: DataFrame) -> DataFrame:
    """Per ZIP: non-brand spend, spend of shared cells and their number."""
    sums = _overlap_sums(zip_cells(spend), ["zip", "state"])
    return sums.select("zip", "state", money("total_nb_spend"), money("overlap_spend"), "n_overlap_cats")


def overlap_categories(spend: DataFrame) -> DataFrame:
    """Per category: ZIPs, spend, largest brand set, most common set and top ZIP.

    The commonest set is counted per (category, set) first; both picks are
    mergeable maxima, so no category is gathered in one task.
    """
    cells = zip_cells(spend)
    per_set = cells.groupBy("category", "brands").agg(
        F.count("*").alias("n"), F.sum("spend").alias("spend"), F.max("n_brands").alias("n_brands"),
        F.min(F.struct((-F.col("spend")).alias("s"), F.col("zip"), F.col("state"))).alias("top"),
    )
    best = per_set.groupBy("category").agg(
        F.sum("n").alias("zips"), F.sum("spend").alias("spend"), F.max("n_brands").alias("max_brands"),
        F.min(F.struct((-F.col("n")).alias("n"), F.col("brands"))).alias("combo"), F.min("top").alias("top"),
    )
    return best.orderBy(F.col("spend").desc(), "category").select(
        "category", "zips", money("spend"), "max_brands", F.col("combo.brands").alias("top_combo"),
        (-F.col("combo.n")).alias("top_combo_zips"), F.col("top.zip").alias("top_zip"),
        F.col("top.state").alias("top_state"), rounded(-F.col("top.s"), 2).alias("top_zip_spend"),
    )


def overlap_kpis(spend: DataFrame) -> DataFrame:
    """Overlap share, ZIPs with two or three shared categories, mean brands per cell."""
    cells = zip_cells(spend)
    shared = F.col("n_brands") >= 2
    per_zip = cells.groupBy("zip").agg(
        F.sum("spend").alias("spend"), F.sum(F.when(shared, F.col("spend")).otherwise(0.0)).alias("shared"),
        F.count(F.when(shared, 1)).alias("cats"), F.count("*").alias("cells"), F.sum("n_brands").alias("brands"),
    )
    kpis = per_zip.agg(
        F.count("*").alias("zips"), F.sum("spend").alias("total_nb_spend"), F.sum("shared").alias("overlap_spend"),
        F.count(F.when(F.col("cats") >= 2, 1)).alias("zips_2plus"),
        F.count(F.when(F.col("cats") >= 3, 1)).alias("zips_3plus"),
        F.sum("brands").alias("brands"), F.sum("cells").alias("cells"),
    )
    return kpis.select(
        "zips", money("total_nb_spend"), money("overlap_spend"),
        rounded(ratio0("overlap_spend", "total_nb_spend"), 4).alias("overlap_share"), "zips_2plus", "zips_3plus",
        rounded(ratio0("brands", "cells"), 2).alias("avg_brands_per_cell"),
    )


def overlap_regions(spend: DataFrame) -> DataFrame:
    """Overlap per region (ZIP → state): ZIPs, shared ZIPs, spend and share."""
    per_zip = _overlap_sums(zip_cells(spend), ["zip", "state"])
    rows = per_zip.groupBy("state").agg(
        F.count("*").alias("zips"), F.count(F.when(F.col("n_overlap_cats") > 0, 1)).alias("overlap_zips"),
        F.sum("total_nb_spend").alias("total_nb_spend"), F.sum("overlap_spend").alias("overlap_spend"),
    )
    return rows.orderBy(F.col("overlap_spend").desc(), "state").select(
        F.col("state").alias("region"), "zips", "overlap_zips", money("total_nb_spend"), money("overlap_spend"),
        rounded(ratio0("overlap_spend", "total_nb_spend"), 4).alias("overlap_share"),
    )


def overlap_summary(spend: DataFrame) -> DataFrame:
    """Tiles: number of ZIPs and their spend by the number of brands present."""
    per_zip = spend.groupBy("zip", "brand").agg(F.sum(units("cost")).alias("u")).groupBy("zip").agg(
        F.count("*").alias("brands"), (F.sum("u") / 1e6).alias("spend")
    )
    rows = per_zip.groupBy("brands").agg(F.count("*").alias("zips"), F.sum("spend").alias("spend"))
    share = Window.partitionBy()  # one row per brand count
    return rows.orderBy("brands").select(
        "brands", "zips", money("spend"), rounded(ratio0(F.col("zips"), F.sum("zips").over(share)), 4).alias("share")
    )

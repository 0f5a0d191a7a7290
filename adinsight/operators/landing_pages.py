"""Landing pages: traffic, conversion quality, categories and devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adinsight.config import ClientConfig
from adinsight.functions.grading import page_score
from adinsight.functions.matching import category_of, is_brand
from adinsight.functions.numbers import ratio0, ratio_null, rounded, total, units, whole
from adinsight.operators.ads import final_url
from adinsight.operators.common import everything, exact_medians, money, tenth, text_column

BRAND_BUCKET = "BR"
DEVICES = ("mobile", "desktop", "tablet")
SIGNIFICANT_CLICKS = 100


def _pages(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.when(F.col("landing_page") != "", F.col("landing_page")), F.lit("(unknown)"))
    speed = F.when(F.col("mobile_speed_score").isNotNull(), F.col("row_index"))
    return pages.groupBy(url.alias("url")).agg(
        total("clicks").alias("clicks"), total("impressions").alias("impr"), total("cost").alias("cost"),
        F.min_by("mobile_speed_score", speed).alias("speed"),
    )


def landing_pages(pages: DataFrame, top: int = 50) -> DataFrame:
    """Pages by cost with CTR and the first reported speed; ``pages`` counts all of them."""
    rows = _pages(pages)
    found = rows.agg(F.count("*")).scalar()
    best = rows.orderBy(F.col("cost").desc(), "url").limit(top)
    return best.select("url", whole("clicks").alias("clicks"), whole("impr").alias("impr"), money("cost"),
                       rounded(ratio0("clicks", "impr"), 4).alias("ctr"), "speed", found.alias("pages"))


def url_categories(pages: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Pages, clicks and cost per category found in the URL; empty when none is found.

    The check runs over one row per configured category.
    """
    other = "Other / uncategorized"
    sums = _pages(pages).groupBy(category_of("url", cfg, other).alias("category")).agg(
        F.count("*").alias("landing_pages"), F.sum("clicks").alias("clicks"), F.sum("cost").alias("cost")
    )
    any_named = F.max(F.col("category") != other).over(everything())
    return sums.withColumn("named", any_named).filter("named").select(
        "category", "landing_pages", whole("clicks").alias("clicks"), money("cost")
    )


def _from_ads(ads: DataFrame) -> DataFrame:
    return ads.withColumn("url", final_url(ads)).filter(F.col("url") != "")


def performance(ads: DataFrame, top: int = 50) -> DataFrame:
    """Cost, traffic, conversion rate and score per final URL."""
    sums = _from_ads(ads).groupBy("url").agg(total("cost").alias("cost"), total("clicks").alias("clicks"),
                                             total("conversions").alias("conv"))
    best = sums.orderBy(F.col("cost").desc(), "url").limit(top)
    return best.select(
        "url", rounded(ratio0("conv", "clicks"), 4).alias("cvr"), rounded(ratio_null("cost", "conv"), 2).alias("cpa"),
        page_score("clicks", "conv").alias("score"), money("cost"), whole("clicks").alias("clicks"), tenth("conv"),
    )


def category_cells(ads: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Clicks, conversions and cost per URL × ad category (brand ads go to ``BR``)."""
    branded = is_brand(F.concat_ws(" ", text_column(ads, "campaign"), text_column(ads, "ad_group")), cfg)
    named = category_of(F.concat_ws(" ", text_column(ads, "ad_group"), text_column(ads, "headline_1")), cfg, "Other")
    category = F.when(branded, BRAND_BUCKET).otherwise(named)
    return _from_ads(ads).groupBy("url", category.alias("category")).agg(
        F.sum(units("clicks")).alias("clicks_u"), F.sum(units("conversions")).alias("conv_u"),
        F.sum(units("cost")).alias("cost_u"),
    )


def _url_sums(cells: DataFrame) -> DataFrame:
    return cells.groupBy("url").agg(
        (F.sum("clicks_u") / 1e6).alias("clicks"), (F.sum("conv_u") / 1e6).alias("conv"),
        (F.sum("cost_u") / 1e6).alias("cost"), F.count("*").alias("n_cats"),
    )


def category_grid(ads: DataFrame, cfg: ClientConfig, top: int = 100) -> DataFrame:
    """Conversion rate per URL × category (long form) for the largest URLs by cost.

    At most ``top`` URLs are broadcast to their cells.
    """
    cells = category_cells(ads, cfg)
    best = _url_sums(cells).orderBy(F.col("cost").desc(), "url").limit(top)
    rows = cells.join(F.broadcast(best), "url")
    return rows.select(
        "url", "category", rounded(ratio_null("conv_u", "clicks_u"), 4).alias("cvr"), money("cost", "url_cost"),
        whole("clicks").alias("url_clicks"), tenth("conv", "url_conv"),
        rounded(ratio0("conv", "clicks"), 4).alias("overall_cvr"), "n_cats",
    )


def grid_categories(ads: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Categories of the grid by spend: the column order."""
    sums = category_cells(ads, cfg).groupBy("category").agg((F.sum("cost_u") / 1e6).alias("spend"))
    return sums.orderBy(F.col("spend").desc(), "category").select("category", money("spend"))


def grid_stats(ads: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Portfolio numbers behind the grid."""
    sums = _url_sums(category_cells(ads, cfg)).agg(
        F.count("*").alias("landing_pages"), F.sum("cost").alias("spend"), F.sum("clicks").alias("clicks"),
        F.sum("conv").alias("conv"), F.sum("n_cats").alias("cells"),
    )
    return sums.select(
        "landing_pages", rounded(ratio0("conv", "clicks"), 4).alias("weighted_cvr"),
        rounded(ratio0("cells", "landing_pages"), 1).alias("avg_cats"), money("spend"),
        whole("clicks").alias("clicks"), tenth("conv", "conversions"),
    )


def _cvr_cells(ads: DataFrame, cfg: ClientConfig) -> DataFrame:
    return category_cells(ads, cfg).withColumn("cvr", ratio_null("conv_u", "clicks_u"))


def _extremes() -> list[Column]:
    """Best and worst page by rate as mergeable maxima; the URL breaks ties."""
    has = F.col("cvr").isNotNull()
    pair = F.struct("cvr", "url")
    return [F.max(F.when(has, pair)).alias("hi"), F.min(F.when(has, pair)).alias("lo")]


def category_summary(ads: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Per category: pages, spend, lowest/upper-median/highest rate, best and worst page."""
    cells = _cvr_cells(ads, cfg)
    sums = cells.groupBy("category").agg(
        F.count("*").alias("lps_running"), (F.sum("cost_u") / 1e6).alias("spend"), *_extremes()
    ).filter(F.col("hi").isNotNull())
    rows = sums.join(exact_medians(cells, ["category"], "cvr"), "category")
    return rows.orderBy(F.col("spend").desc(), "category").select(
        "category", "lps_running", money("spend"), rounded("lo.cvr", 4).alias("min_cvr"),
        rounded("upper_median", 4).alias("median_cvr"), rounded("hi.cvr", 4).alias("max_cvr"),
        F.col("hi.url").alias("best_lp"), F.col("lo.url").alias("worst_lp"),
    )


def category_rollup(ads: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Per category over the pages with a rate: true median, spend of the whole pages."""
    cells = _cvr_cells(ads, cfg)
    urls = cells.groupBy("url").agg(F.sum("cost_u").alias("url_cost_u"))
    priced = cells.filter(F.col("cvr").isNotNull()).join(urls, "url")
    sums = priced.groupBy("category").agg(F.count("*").alias("pages"), (F.sum("url_cost_u") / 1e6).alias("spend"),
                                          *_extremes())
    rows = sums.join(exact_medians(cells, ["category"], "cvr"), "category")
    middle = (F.col("lower_median") + F.col("upper_median")) / 2
    return rows.orderBy(F.col("pages").desc(), F.col("spend").desc(), "category").select(
        "category", "pages", money("spend"), rounded("lo.cvr", 4).alias("min_cvr"),
        rounded(middle, 4).alias("median_cvr"), rounded("hi.cvr", 4).alias("max_cvr"),
        F.col("hi.url").alias("best_lp"), F.col("lo.url").alias("worst_lp"),
    )


def page_medians(ads: DataFrame, cfg: ClientConfig) -> DataFrame:
    """Per page: median of its categories' rates, with the values on both sides of the middle."""
    rows = exact_medians(_cvr_cells(ads, cfg), ["url"], "cvr")
    middle = (F.col("lower_median") + F.col("upper_median")) / 2
    return rows.select("url", rounded("lower_median", 4).alias("lower_median"), rounded(middle, 4).alias("median_cvr"),
                       rounded("upper_median", 4).alias("upper_median"))


def device_rollup(pages: DataFrame) -> DataFrame:
    """Per device: pages, cost, clicks, click-weighted rate, shares, best and worst page.

    ``pages`` has one row per URL: url, cost, clicks and ``<device>_cvr/_cost/_clicks``.
    Best and worst come from pages with at least 100 clicks, else from all pages.
    """
    entries = F.array(*[
        F.struct(F.lit(d).alias("device"), F.col(f"{d}_cvr").alias("cvr"), F.col(f"{d}_cost").alias("dev_cost"),
                 F.col(f"{d}_clicks").alias("dev_clicks"))
        for d in DEVICES
    ])
    everything = pages.agg(total("clicks").alias("clicks"), total("cost").alias("cost"))
    all_clicks = everything.select("clicks").scalar()
    all_cost = everything.select("cost").scalar()
    rows = pages.select("url", F.inline(entries)).filter(F.col("cvr").isNotNull() & (F.col("dev_clicks") > 0))
    pair, significant = F.struct("cvr", "url"), F.col("dev_clicks") >= SIGNIFICANT_CLICKS
    sums = rows.groupBy("device").agg(
        F.count("*").alias("pages"), total("dev_cost").alias("cost"), total("dev_clicks").alias("clicks"),
        total(F.col("cvr") * F.col("dev_clicks")).alias("conv"),
        F.coalesce(F.max(F.when(significant, pair)), F.max(pair)).alias("hi"),
        F.coalesce(F.min(F.when(significant, pair)), F.min(pair)).alias("lo"),
    )
    return sums.select(
        "device", "pages", rounded(ratio0("conv", "clicks"), 4).alias("cvr"),
        rounded(ratio0(F.col("clicks"), all_clicks), 4).alias("click_share"),
        rounded(ratio0(F.col("cost"), all_cost), 4).alias("spend_share"), money("cost"),
        whole("clicks").alias("clicks"), F.col("hi.url").alias("best_lp"), F.col("lo.url").alias("worst_lp"),
    )

"""Global filters, filter options, list search, multi-select and sorting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adinsight.config import ClientConfig
from adinsight.functions.matching import category_label, category_of, contains_any, region_value
from adinsight.operators.common import text_column

# The fields that make up the searchable text of a row.
TEXT_FIELDS = ("campaign", "ad_group", "search_keyword", "search_term", "landing_page", "ad_final_url", "final_url",
               "state_matched")
SALTS = 1024


@dataclass(frozen=True)
class Filters:
    """Global filter values; ``all`` leaves a dimension open."""

    seg: str = "all"
    campaign: str = "all"
    region: str = "all"
    category: str = "all"
    brand: str = "all"

    @property
    def active(self) -> bool:
        return any(v != "all" for v in (self.seg, self.campaign, self.region, self.category, self.brand))


def row_text(df: DataFrame) -> Column:
    return F.lower(F.concat_ws(" ", *[text_column(df, f) for f in TEXT_FIELDS]))


def campaign_bridge(ad_groups: DataFrame) -> DataFrame:
    """Ad group → campaign; an ad group seen in several campaigns takes the last name."""
    named = ad_groups.filter(F.col("ad_group") != "")
    return named.groupBy("ad_group").agg(F.max("campaign").alias("bridged_campaign"))


def region_groups(geographic: DataFrame, region: str) -> DataFrame:
    """Ad groups seen in a region."""
    seen = geographic.filter((F.col("ad_group") != "") & (region_value(geographic.columns) == region))
    return seen.select("ad_group").distinct().withColumn("in_region", F.lit(True))


def _bridge(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """Left join on a text key; rows without the key are spread by a salt.

    The side is a deduplicated mapping whose size is unknown, so Spark picks the
    join from its statistics (broadcast only below the configured threshold).
    """
    empty = F.coalesce(F.col(key), F.lit("")) == ""
    hashable = [name for name, kind in rows.dtypes if not kind.startswith(("map", "variant"))]
    spread = F.when(empty, F.pmod(F.xxhash64(*hashable), F.lit(SALTS)) + 1).otherwise(F.lit(0))
    left = rows.withColumn("_salt", spread.cast("bigint"))
    right = side.withColumn("_salt", F.lit(0).cast("bigint"))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def apply_filters(df: DataFrame, filters: Filters, cfg: ClientConfig, *, ad_groups: DataFrame | None = None,
                  geographic: DataFrame | None = None) -> DataFrame:
    """Keep the rows of any report that satisfy the filters.

    Dimensions a report lacks are resolved over the ad group (its campaign, the
    regions it was seen in); rows that cannot be resolved stay.
    """
    if not filters.active:
        return df
    has_campaign, has_group = "campaign" in df.columns, "ad_group" in df.columns
    campaign = F.nullif(text_column(df, "campaign"), F.lit(""))
    group = F.nullif(text_column(df, "ad_group"), F.lit(""))
    out, conditions = df, []

    if filters.campaign != "all":
        via = F.lit(None).cast("string")
        if has_group and ad_groups is not None:
            out = _bridge(out, campaign_bridge(ad_groups), "ad_group")
            via = F.col("bridged_campaign")
        named = F.coalesce(campaign, via) if has_campaign else via
        conditions.append(F.coalesce(named == filters.campaign, F.lit(True)))

    text = row_text(df)
    if filters.seg in ("br", "nb"):
        brand = contains_any(text, cfg.brand_terms)
        conditions.append(brand if filters.seg == "br" else ~brand)
    if filters.brand != "all":
        conditions.append(text.contains(filters.brand.lower()))
    if filters.category != "all":
        conditions.append(F.coalesce(category_of(text, cfg) == filters.category, F.lit(True)))

    if filters.region != "all":
        resolved = region_value(df.columns) == filters.region
        if geographic is not None:
            groups = region_groups(geographic, filters.region)
            if has_group:
                out = _bridge(out, groups, "ad_group")
                in_group = F.when(group.isNotNull(), F.coalesce(F.col("in_region"), F.lit(False)))
                resolved = F.coalesce(resolved, in_group)
            if has_campaign and ad_groups is not None:
                reached = (
                    campaign_bridge(ad_groups).join(groups, "ad_group", "left_semi")
                    .select(F.col("bridged_campaign").alias("campaign")).distinct()
                )
                some = reached.agg(F.count("*") > 0).scalar()
                out = _bridge(out, reached.withColumn("reached", F.lit(True)), "campaign")
                by_campaign = F.when(campaign.isNotNull() & some, F.coalesce(F.col("reached"), F.lit(False)))
                resolved = F.coalesce(resolved, by_campaign)
        conditions.append(F.coalesce(resolved, F.lit(True)))

    for condition in conditions:
        out = out.filter(condition)
    return out.select(*df.columns)


def filter_options(campaigns: DataFrame, cfg: ClientConfig, geographic: DataFrame | None = None,
                   keyword_geo: DataFrame | None = None, top: int | None = None) -> DataFrame:
    """Option lists as (kind, value): campaigns (all, or the first ``top``), regions, categories, brand."""
    spark = campaigns.sparkSession
    names = campaigns.filter(F.col("campaign") != "").select("campaign").distinct().orderBy("campaign")
    if top is not None:
        names = names.limit(top)
    out = names.select(F.lit("campaign").alias("kind"), F.col("campaign").alias("value"))
    geo = [g for g in (geographic, keyword_geo) if g is not None]
    if geo:
        regions = geo[0].select(region_value(geo[0].columns).alias("value"))
        for g in geo[1:]:
            regions = regions.unionByName(g.select(region_value(g.columns).alias("value")))
        found = regions.filter(F.col("value").isNotNull()).distinct()
        out = out.unionByName(found.select(F.lit("region").alias("kind"), "value"))
    fixed = [("category", category_label(c)) for c in cfg.product_categories] + [("brand", cfg.brand_label)]
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value")) for k, v in fixed])
    return out.unionByName(spark.range(0, 1, 1, 1).select(F.inline(rows)))


def text_search(df: DataFrame, fields: Sequence[str], query: str) -> DataFrame:
    """Case-insensitive containment over the joined fields."""
    if not query:
        return df
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]))
    return df.filter(text.contains(query.lower()))


def multi_select(df: DataFrame, choices: Mapping[str, Sequence[str] | None]) -> DataFrame:
    """Conjunction of ``in`` filters; ``None`` leaves a column open, an empty list drops all."""
    for name, values in choices.items():
        if values is not None:
            df = df.filter(F.col(name).isin(*values) if values else F.lit(False))
    return df


def sort_any(df: DataFrame, name: str, descending: bool = True, numeric: bool | None = None,
             ties: Sequence[str] = ()) -> DataFrame:
    """Sort by any column, missing values last in either direction.

    ``numeric`` compares the number inside a formatted text such as ``$1,204``.
    """
    key = F.col(name)
    if numeric is None:
        numeric = False
    if numeric and dict(df.dtypes)[name] == "string":
        key = F.regexp_replace(key, r"[^0-9.\-]", "").try_cast("double")
    order = key.desc_nulls_last() if descending else key.asc_nulls_last()
    return df.orderBy(order, *ties)

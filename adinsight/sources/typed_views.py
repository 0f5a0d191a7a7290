"""Typed views per report type over the landed rows.

A typed view declares the columns its operators read, so scans of a materialised
view touch only those; everything else stays in ``extra``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adinsight.functions.dates import month_start
from adinsight.functions.matching import GEO_COLUMNS
from adinsight.functions.numbers import parse_number
from adinsight.sources.report_files import DATE_COLUMNS, ENTITY_COLUMNS, METRICS

# Text fields per report type besides campaign and ad_group.
TEXT_FIELDS: dict[str, tuple[str, ...]] = {
    "campaign_performance": ("campaign_type",),
    "ad_group_performance": ("keywords_active",),
    "search_keyword_qs": ("search_keyword", "search_keyword_match_type", "quality_score", "exp_ctr", "ad_relevance",
                          "landing_page_exp"),
    "keyword_geo": ("search_keyword", "search_keyword_match_type", *GEO_COLUMNS),
    "search_terms": ("search_term", "search_terms_match_type", "added_excluded"),
    "ads_performance": ("ad_name", "ad_type", "ad_final_url", "final_url", "headline", "long_headline",
                        *[f"headline_{i}" for i in range(1, 16)], *[f"description_{i}" for i in range(1, 6)]),
    "landing_pages": ("landing_page", "mobile_speed_score"),
    "geographic": GEO_COLUMNS,
    "pmax_placements": ("performance_max_placement",),
    "schedule_dow_hod": ("day", "hour_of_the_day"),
    "audiences": ("audience_segment",),
    "products_sold": ("item_id_sold", "product_title_sold"),
    "distance_from_location": ("distance_from_location_assets",),
}
NUMBER_FIELDS = {"geographic": ("cost_conv",), "products_sold": ("revenue",)}


def typed_view(rows: DataFrame, report_type: str) -> DataFrame:
    """One report type of the landed rows with declared columns."""
    text, numbers = TEXT_FIELDS[report_type], NUMBER_FIELDS.get(report_type, ())
    field = lambda name: F.try_element_at(F.col("record"), F.lit(name))
    declared = {*text, *numbers, *METRICS, "campaign", "ad_group", DATE_COLUMNS.get(report_type, ""),
                ENTITY_COLUMNS.get(report_type, "")}
    out = rows.filter(F.col("report_type") == report_type).select(
        "client_id", "row_index", "campaign", "ad_group", *[field(t).alias(t) for t in text],
        *[parse_number(field(n)).alias(n) for n in numbers], *METRICS.values(), "date",
        F.map_filter("record", lambda k, _: ~k.isin(*sorted(declared))).alias("extra"),
    )
    if report_type == "campaign_performance":
        return out.withColumn("month_start", month_start("date"))
    return out


def materialise(rows: DataFrame, root: str) -> None:
    """Write every typed view as Parquet, replacing the clients it contains."""
    for report_type in TEXT_FIELDS:
        writer = typed_view(rows, report_type).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("client_id").parquet(f"{root.rstrip('/')}/{report_type}")

"""Monthly series, KPI comparison, campaign snapshot, categories and regions.

``campaigns`` is the typed campaign report: campaign, campaign_type, month_start,
impressions, clicks, cost, conversions, conv_value.  ``as_of`` is the last
complete month and ``current`` the month under review; both are date Columns, in
practice a scalar subquery (:func:`latest_complete_month`) or a literal.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adinsight.config import ClientConfig
from adinsight.functions.dates import complete_month, month_abbr, month_of, ym
from adinsight.functions.matching import nonbrand_category, region_of_campaign, short_name
from adinsight.functions.numbers import change, ratio0, rounded, total, whole
from adinsight.operators.common import everything, money, tenth

TOTAL = "TOTAL"
Bound = str | dt.date | None


def latest_complete_month(uploads: DataFrame) -> DataFrame:
    """One row: the last month fully covered by the client's export windows."""
    return uploads.agg(complete_month(F.max("window_end")).alias("month_start"))


def in_range(as_of: Column, date_from: Bound = None, date_to: Bound = None) -> Column:
    """Month predicate: complete months only, inside the requested range."""
    hi, lo = month_of(date_to), month_of(date_from)
    inside = F.col("month_start") <= (as_of if hi is None else F.least(as_of, hi))
    return inside if lo is None else inside & (F.col("month_start") >= lo)


def current_month(campaigns: DataFrame, as_of: Column, date_from: Bound = None, date_to: Bound = None) -> DataFrame:
    """One row: the last month present in the filtered series."""
    return campaigns.filter(in_range(as_of, date_from, date_to)).agg(F.max("month_start").alias("month_start"))


def monthly_sums(campaigns: DataFrame, as_of: Column, date_from: Bound = None, date_to: Bound = None,
                 by: Sequence[str] = ()) -> DataFrame:
    return (
        campaigns.filter(in_range(as_of, date_from, date_to))
        .groupBy(*by, "month_start")
        .agg(total("cost").alias("cost"), total("clicks").alias("clicks"), total("conversions").alias("conv"))
    )


def _trend_columns(by: Sequence[str]) -> list[Column]:
    return [
        *[F.col(c) for c in by],
        ym("month_start").alias("month"),
        money("cost", "spend"),
        whole("clicks").alias("clicks"),
        tenth("conv", "main_conv"),
        rounded(ratio0("cost", "conv"), 2).alias("cpa"),
        rounded(ratio0("conv", "clicks"), 4).alias("cvr"),
    ]


def total_trend(campaigns: DataFrame, as_of: Column, date_from: Bound = None, date_to: Bound = None) -> DataFrame:
    """Monthly spend, clicks, conversions, CPA and CVR over complete months."""
    return monthly_sums(campaigns, as_of, date_from, date_to).orderBy("month_start").select(*_trend_columns(()))


def brand_trends(facts: DataFrame, as_of: Column) -> DataFrame:
    """:func:`total_trend` per brand."""
    series = monthly_sums(facts, as_of, by=["brand"])
    return series.orderBy("brand", "month_start").select(*_trend_columns(["brand"]))


def kpi_scorecard(campaigns: DataFrame, as_of: Column, compare: str = "yoy", date_from: Bound = None,
                  date_to: Bound = None, compare_from: Bound = None, compare_to: Bound = None) -> DataFrame:
    """Spend, conversions, CPA and CVR of the current month against a prior period.

    ``yoy`` takes the same month last year, else the previous available month;
    ``mom`` the previous available month; ``custom`` the sum of the months inside
    the comparison bounds.  All lookups stay inside the date-filtered series.
    The windows run over the monthly series, which has one row per month.
    """
    lo, hi = month_of(compare_from), month_of(compare_to)
    month, cur = F.col("month_start"), F.col("cur")
    order = Window.orderBy(month.desc())
    series = (
        monthly_sums(campaigns, as_of, date_from, date_to)
        .withColumn("cur", F.max("month_start").over(everything()))
        .withColumn("age", F.row_number().over(order))
    )
    previous = F.col("age") == 2
    if compare == "custom" and (lo is not None or hi is not None):
        chosen = month != cur
        chosen = chosen if lo is None else chosen & (month >= lo)
        chosen = chosen if hi is None else chosen & (month <= hi)
    elif compare == "mom":
        chosen = previous
    else:
        last_year = month == F.add_months(cur, -12)
        has_last_year = F.max(last_year).over(everything())
        series = series.withColumn("chosen", F.when(has_last_year, last_year).otherwise(previous))
        chosen = F.col("chosen")
    series = series.withColumn("chosen", chosen)

    def pick(name: str, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(name))), F.lit(0.0))

    first = F.min(F.when(F.col("chosen"), month))
    last = F.max(F.when(F.col("chosen"), month))
    sums = series.agg(
        *[pick(m, month == cur).alias(f"cur_{m}") for m in ("cost", "clicks", "conv")],
        *[pick(m, F.col("chosen")).alias(f"pri_{m}") for m in ("cost", "clicks", "conv")],
        month_abbr(F.max("cur")).alias("current_label"),
        F.when(first.isNull(), F.lit("—"))
        .when(first == last, month_abbr(first))
        .otherwise(F.concat(month_abbr(first), F.lit("–"), month_abbr(last)))
        .alias("prior_label"),
        F.count("*").alias("months"),
    ).filter("months > 0")

    def row(metric: str, num: str, den: str | None) -> Column:
        now = F.col(f"cur_{num}") if den is None else ratio0(f"cur_{num}", f"cur_{den}")
        then = F.col(f"pri_{num}") if den is None else ratio0(f"pri_{num}", f"pri_{den}")
        return F.struct(F.lit(metric).alias("metric"), then.alias("p"), now.alias("c"))

    # Metric labels of the scorecard.
    rows = F.array(
        row("Total Spend", "cost", None),
        row("Main Conversions", "conv", None),
        row("CPA (Main Conv)", "cost", "conv"),
        row("CVR (Main Conv)", "conv", "clicks"),
    )
    return sums.select("current_label", "prior_label", F.inline(rows)).select(
        "metric", "prior_label", "current_label",
        rounded("p", 2).alias("prior"), rounded("c", 2).alias("current"), change("c", "p").alias("change"),
    )


def _aged(facts: DataFrame, current: Column, back: int) -> DataFrame:
    """Rows of the last ``back`` months with their ``age`` in months before ``current``.

    The month range is a plain comparison, so partitions and row groups prune on it.
    """
    month = F.col("month_start")
    recent = facts.filter(month.between(F.add_months(current, -back), current))
    return recent.withColumn("age", F.months_between(current, month).cast("int"))


def _period_cells(campaigns: DataFrame, current: Column, keys: dict[str, Column], compare: str) -> DataFrame:
    """Spend and conversions per key for the current and the comparison month.

    One pass sums the three candidate months (current, previous, last year); last
    year is used unless no row of it exists, then the previous month.  That check
    is an aggregate of the cells; when the current month is empty too, there is no
    comparison.
    """
    by_year = compare not in ("mom", "custom")
    ages = (0, 1, 12) if by_year else (0, 1)
    aged = _aged(campaigns, current, max(ages)).filter(F.col("age").isin(*ages))
    named = aged.select(*[c.alias(k) for k, c in keys.items()], "age", "month_start", "cost", "conversions")
    for key in keys:
        named = named.filter(F.col(key).isNotNull())
    sums = [
        column
        for age in ages
        for column in (
            total("cost", F.col("age") == age).alias(f"cost_{age}"),
            total("conversions", F.col("age") == age).alias(f"conv_{age}"),
            F.count(F.when(F.col("age") == age, 1)).alias(f"rows_{age}"),
        )
    ]
    cells = named.groupBy(*keys).agg(*sums, F.max(F.expr("add_months(month_start, age)")).alias("month"))
    # Two facts of the account: whether last year has rows, and whether it or the current month has any at all.
    facts = cells.agg(F.sum("rows_0").alias("now"), (F.sum("rows_12") if by_year else F.lit(0)).alias("then"))
    last_year = F.coalesce(facts.select(F.col("then") > 0).scalar(), F.lit(False)) if by_year else F.lit(False)
    cells = cells.withColumn("last_year", last_year)
    if by_year:  # nothing to compare when both are empty, whatever the month before holds
        cells = cells.filter(F.coalesce(facts.select((F.col("now") > 0) | (F.col("then") > 0)).scalar(), F.lit(False)))

    def prior(name: str) -> Column:
        previous = F.col(f"{name}_1")
        return F.when(F.col("last_year"), F.col(f"{name}_12")).otherwise(previous) if by_year else previous

    back = F.when(F.col("last_year"), -12).otherwise(-1)
    return cells.filter((F.col("rows_0") > 0) | (prior("rows") > 0)).select(
        *keys, prior("cost").alias("spend_prior"), F.col("cost_0").alias("spend_cur"),
        prior("conv").alias("conv_prior"), F.col("conv_0").alias("conv_cur"),
        month_abbr(F.add_months("month", back)).alias("prior_label"), month_abbr("month").alias("cur_label"),
    )


def _with_changes(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    cpa_prior, cpa_cur = ratio0("spend_prior", "conv_prior"), ratio0("spend_cur", "conv_cur")
    labels = [c for c in ("prior_label", "cur_label") if c in cells.columns]
    return cells.select(
        *keys, *labels,
        money("spend_prior"), money("spend_cur"), change("spend_cur", "spend_prior").alias("spend_chg"),
        tenth("conv_prior"), tenth("conv_cur"), change("conv_cur", "conv_prior").alias("conv_chg"),
        rounded(cpa_prior, 2).alias("cpa_prior"), rounded(cpa_cur, 2).alias("cpa_cur"),
        change(cpa_cur, cpa_prior).alias("cpa_chg"),
    )


_CELL_SUMS = ("spend_prior", "spend_cur", "conv_prior", "conv_cur")


def nonbrand_categories(campaigns: DataFrame, current: Column, cfg: ClientConfig, compare: str = "yoy") -> DataFrame:
    """Non-brand spend and conversions per category, with a total row.

    Totals come from the raw sums.  The roll-up runs over the aggregated
    categories, a list bounded by the configuration.
    """
    cells = _period_cells(campaigns, current, {"category": nonbrand_category("campaign", cfg)}, compare)
    rolled = cells.rollup("category").agg(
        *[F.sum(m).alias(m) for m in _CELL_SUMS],
        F.max("prior_label").alias("prior_label"), F.max("cur_label").alias("cur_label"),
        F.grouping("category").alias("is_total"),
    ).filter(F.col("prior_label").isNotNull())
    ordered = rolled.orderBy("is_total", F.col("spend_cur").desc(), "category")
    named = ordered.withColumn("category", F.coalesce("category", F.lit("Non-Brand Total")))
    return _with_changes(named, ["category"])


def region_cells(campaigns: DataFrame, current: Column, cfg: ClientConfig, compare: str = "yoy",
                 digits: bool = True) -> DataFrame:
    """Non-brand spend and conversions per (region, category)."""
    keys = {"region": region_of_campaign("campaign"), "category": nonbrand_category("campaign", cfg)}
    cells = _period_cells(campaigns, current, keys, compare)
    if not digits:
        return cells
    return cells.orderBy("region", "category").select(
        "region", "category", "prior_label", "cur_label",
        money("spend_prior"), money("spend_cur"), tenth("conv_prior"), tenth("conv_cur"),
    )


def regions_rollup(cells: DataFrame, categories: Sequence[str] | None = None, top: int | None = None) -> DataFrame:
    """Region cells summed over the chosen categories, with a total row.

    ``top`` keeps the largest regions by current spend (chart input) and leaves
    the total row out.
    """
    chosen = cells if categories is None else cells.filter(F.col("category").isin(*categories))
    sums = [F.sum(m).alias(m) for m in _CELL_SUMS]
    if top is not None:
        best = chosen.groupBy("region").agg(*sums).orderBy(F.col("spend_cur").desc(), "region").limit(top)
        return _with_changes(best, ["region"])
    rolled = chosen.rollup("region").agg(*sums, F.grouping("region").alias("is_total"))
    ordered = rolled.filter(F.col("spend_cur").isNotNull()).orderBy("is_total", F.col("spend_cur").desc(), "region")
    return _with_changes(ordered.withColumn("region", F.coalesce("region", F.lit("Non-Brand Total"))), ["region"])


def campaign_snapshot(campaigns: DataFrame, current: Column) -> DataFrame:
    """Campaigns of the current month against the previous calendar month.

    Several rows of one (campaign, month) are summed.  The cost share divides by
    a scalar subquery, so no task sees all campaigns.
    """
    now, then = F.col("age") == 0, F.col("age") == 1
    spent = campaigns.filter(F.col("month_start") == current).agg(total("cost")).scalar()
    rows = (
        _aged(campaigns, current, 1)
        .groupBy("campaign")
        .agg(
            F.max(F.when(now, F.col("campaign_type"))).alias("type"),
            total("clicks", now).alias("clicks"), total("cost", now).alias("cost"),
            total("conversions", now).alias("conv"),
            total("conversions", then).alias("before"),
            F.count(F.when(now, 1)).alias("n_now"), F.count(F.when(then, 1)).alias("n_then"),
        )
        .filter("n_now > 0")
    )
    return rows.orderBy(F.col("cost").desc(), "campaign").select(
        "campaign", short_name("campaign").alias("short_name"), "type", whole("clicks").alias("clicks"),
        rounded(ratio0("cost", "conv"), 2).alias("cpa"), rounded(ratio0("conv", "clicks"), 4).alias("cvr"),
        rounded(ratio0(F.col("cost"), spent), 4).alias("share"),
        rounded(F.when(F.col("n_then") > 0, F.col("before")), 1).alias("prior_conv"),
        change("conv", F.when(F.col("n_then") > 0, F.col("before"))).alias("d_conv"),
        money("cost"), tenth("conv"),
    )


def campaign_totals(campaigns: DataFrame, current: Column) -> DataFrame:
    sums = campaigns.filter(F.col("month_start") == current).agg(
        total("clicks").alias("clicks"), total("cost").alias("cost"), total("conversions").alias("conv")
    )
    return sums.select(whole("clicks").alias("clicks"), money("cost"), tenth("conv"))


# --- operators over facts that carry a brand --------------------------------------


_YOY = ("cost", "conversions", "web_reservations", "calls")


def _yoy_sums(facts: DataFrame, current: Column, keys: Sequence[str]) -> DataFrame:
    sums = [
        total(metric, F.col("age") == age).alias(f"{metric}_{name}")
        for metric in _YOY
        for name, age in (("prior", 12), ("cur", 0))
    ]
    return _aged(facts, current, 12).filter(F.col("age").isin(0, 12)).groupBy(*keys).agg(*sums)


def _yoy_columns() -> list[Column]:
    cpa_prior, cpa_cur = ratio0("cost_prior", "conversions_prior"), ratio0("cost_cur", "conversions_cur")
    out = []
    for metric, name, digits in (("cost", "spend", 2), ("conversions", "conv", 1), ("web_reservations", "webres", 1),
                                 ("calls", "calls", 1)):
        out += [
            rounded(f"{metric}_prior", digits).alias(f"{name}_prior"),
            rounded(f"{metric}_cur", digits).alias(f"{name}_cur"),
            change(f"{metric}_cur", f"{metric}_prior").alias(f"{name}_chg"),
        ]
    return out + [
        rounded(cpa_prior, 2).alias("cpa_prior"), rounded(cpa_cur, 2).alias("cpa_cur"),
        change(cpa_cur, cpa_prior).alias("cpa_chg"),
    ]


def brand_yoy(facts: DataFrame, current: Column) -> DataFrame:
    """Current month against last year per brand, with a TOTAL row."""
    per_brand = _yoy_sums(facts, current, ["brand"])
    measures = [c for c in per_brand.columns if c != "brand"]
    rolled = per_brand.rollup("brand").agg(*[F.sum(m).alias(m) for m in measures], F.grouping("brand").alias("g"))
    ordered = rolled.filter(F.col("cost_cur").isNotNull()).orderBy("g", "brand")
    return ordered.select(F.coalesce("brand", F.lit(TOTAL)).alias("brand"), *_yoy_columns())


def brand_regions(facts: DataFrame, current: Column) -> DataFrame:
    """Brand × region year over year, with one TOTAL row per brand."""
    cells = _yoy_sums(facts, current, ["brand", "region"])
    measures = [c for c in cells.columns if c not in ("brand", "region")]
    rolled = (
        cells.rollup("brand", "region")
        .agg(*[F.sum(m).alias(m) for m in measures], F.grouping_id("brand", "region").alias("g"))
        .filter(F.col("g") < 3)
    )
    ordered = rolled.orderBy("brand", "g", F.col("cost_cur").desc(), "region")
    return ordered.select("brand", F.coalesce("region", F.lit(TOTAL)).alias("region"), *_yoy_columns())


def brand_regions_chart(facts: DataFrame, current: Column, brand: str, top: int = 12) -> DataFrame:
    """The largest regions of one brand, without its TOTAL row."""
    cells = _yoy_sums(facts.filter(F.col("brand") == brand), current, ["brand", "region"])
    best = cells.orderBy(F.col("cost_cur").desc(), "region").limit(top)
    return best.select("brand", "region", *_yoy_columns())


def brand_region_category(facts: DataFrame, current: Column, categories: Sequence[str]) -> DataFrame:
    """Chosen categories summed per brand and region for the current month."""
    cells = (
        facts.filter((F.col("month_start") == current) & F.col("category").isin(*categories))
        .groupBy("brand", "region")
        .agg(total("cost").alias("cost"), total("clicks").alias("clicks"), total("impressions").alias("impr"),
             total("conversions").alias("conv"))
    )
    return cells.orderBy("brand", F.col("cost").desc(), "region").select(
        "brand", "region", money("cost"), whole("clicks").alias("clicks"), whole("impr").alias("impr"), tenth("conv"),
        rounded(ratio0("conv", "clicks"), 4).alias("cvr"), rounded(ratio0("cost", "conv"), 2).alias("cpa"),
    )


def campaign_type_split(facts: DataFrame, as_of: Column) -> DataFrame:
    """Per campaign type: monthly trend, totals and totals per brand, in one pass."""
    base = monthly_sums(facts, as_of, by=["campaign_type", "brand"])
    sets = base.groupingSets(
        [["campaign_type", "month_start"], ["campaign_type"], ["campaign_type", "brand"]],
        "campaign_type", "month_start", "brand",
    ).agg(
        F.sum("cost").alias("cost"), F.sum("clicks").alias("clicks"), F.sum("conv").alias("conv"),
        F.grouping_id("campaign_type", "month_start", "brand").alias("g"),
    )
    level = F.when(F.col("g") == 1, "trend").when(F.col("g") == 3, "total").otherwise("brand")
    return sets.select(
        level.alias("level"), "campaign_type", "brand", ym("month_start").alias("month"), money("cost", "spend"),
        whole("clicks").alias("clicks"), tenth("conv", "main_conv"),
        rounded(ratio0("cost", "conv"), 2).alias("cpa"), rounded(ratio0("conv", "clicks"), 4).alias("cvr"),
    )

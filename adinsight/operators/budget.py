"""Budget: effective amount, composition, reconciliation and monthly pacing.

``lines`` are budget lines (brand, region, category, monthly); ``manual`` is the
configured monthly amount that applies when there are no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adinsight.config import ClientConfig
from adinsight.functions.dates import month_abbr, ym
from adinsight.functions.grading import budget_status
from adinsight.functions.matching import category_of
from adinsight.functions.numbers import ratio_null, rounded, total
from adinsight.operators.common import everything, money
from adinsight.operators.trends import monthly_sums

DIMENSIONS = ("brand", "region", "category")
UNSPECIFIED = "(unspecified)"
OTHER = "Other / uncategorized"


def effective_budget(lines: DataFrame, manual: float | None = None) -> DataFrame:
    """One row: the monthly budget, its source and the number of lines."""
    sums = lines.agg(F.count("*").alias("lines"), total("monthly").alias("amount"))
    by_hand = F.lit(manual).cast("double")
    return sums.select(
        rounded(F.when(F.col("lines") > 0, F.col("amount")).otherwise(by_hand), 2).alias("monthly_budget"),
        F.when(F.col("lines") > 0, "file").when(F.coalesce(by_hand, F.lit(0.0)) != 0, "manual").otherwise("none")
        .alias("source"),
        "lines",
    )


def composition(lines: DataFrame) -> DataFrame:
    """Monthly amount per value of each dimension that is used by some line."""
    used = [F.count(F.nullif(d, F.lit(""))).alias(f"uses_{d}") for d in DIMENSIONS]
    counts = lines.agg(*used)
    named = lines.select(*[F.coalesce(F.nullif(d, F.lit("")), F.lit(UNSPECIFIED)).alias(d) for d in DIMENSIONS],
                         "monthly")
    sets = named.groupingSets([[d] for d in DIMENSIONS], *DIMENSIONS).agg(
        total("monthly").alias("monthly"), F.grouping_id(*DIMENSIONS).alias("g")
    )
    dimension = F.when(F.col("g") == 3, "brand").when(F.col("g") == 5, "region").otherwise("category")
    keep = F.lit(False)
    for d in DIMENSIONS:
        keep = keep | ((F.col("dimension") == d) & (counts.select(f"uses_{d}").scalar() > 0))
    rows = sets.select(dimension.alias("dimension"), F.coalesce(*DIMENSIONS).alias("key"), "monthly").filter(keep)
    return rows.orderBy("dimension", F.col("monthly").desc(), "key").select("dimension", "key", money("monthly"))


def reconciliation(campaigns: DataFrame, lines: DataFrame, current: Column, manual: float | None = None) -> DataFrame:
    """Total budget against the spend of the current month (global filters do not apply)."""
    budget = effective_budget(lines, manual).select("monthly_budget").scalar()
    actual = campaigns.filter(F.col("month_start") == current).agg(total("cost").alias("actual"))
    rows = actual.select(month_abbr(current).alias("month"), budget.alias("budget"), "actual").filter(
        F.coalesce("budget", F.lit(0.0)) != 0
    )
    return rows.select(
        "month", money("budget", "total_budget"), money("actual", "total_actual"),
        rounded(F.col("actual") - F.col("budget"), 2).alias("variance"),
        rounded(ratio_null("actual", "budget"), 4).alias("pct"), budget_status("budget", "actual").alias("status"),
    )


def reconciliation_by_category(campaigns: DataFrame, lines: DataFrame, current: Column,
                               cfg: ClientConfig) -> DataFrame:
    """Budget lines against spend bucketed by the category in the campaign name.

    Both sides are aggregated before the full outer join: one row per category.
    Empty when no line names a category.
    """
    named = F.nullif("category", F.lit(""))
    planned = lines.groupBy(F.coalesce(named, F.lit(UNSPECIFIED)).alias("category")).agg(
        total("monthly").alias("budget"), F.count(named).alias("named")
    )
    spent = campaigns.filter(F.col("month_start") == current).groupBy(
        category_of("campaign", cfg, OTHER).alias("category")
    ).agg(total("cost").alias("actual"))
    joined = planned.join(spent, "category", "full_outer").select(
        "category", F.coalesce("budget", F.lit(0.0)).alias("budget"), F.coalesce("actual", F.lit(0.0)).alias("actual"),
        F.sum("named").over(everything()).alias("named"),
    ).filter("named > 0")
    ordered = joined.orderBy((F.col("budget") + F.col("actual")).desc(), "category")
    return ordered.select(
        "category", rounded(F.col("actual") - F.col("budget"), 2).alias("variance"),
        rounded(ratio_null("actual", "budget"), 4).alias("pct"), budget_status("budget", "actual").alias("status"),
        money("budget"), money("actual"),
    )


def pacing(campaigns: DataFrame, lines: DataFrame, as_of: Column, manual: float | None = None,
           months: int = 12) -> DataFrame:
    """Spend against the budget for the last complete months.

    ``latest_status`` repeats the status of the newest of the (at most twelve) months.
    """
    budget = effective_budget(lines, manual).select(F.nullif("monthly_budget", F.lit(0.0))).scalar()
    recent = monthly_sums(campaigns, as_of).orderBy(F.col("month_start").desc()).limit(months)
    rows = recent.select("month_start", "cost", budget.alias("budget"))
    newest = F.max_by("cost", "month_start").over(everything())
    status = F.when(F.col("budget").isNotNull(), budget_status(F.col("budget"), newest))
    return rows.orderBy("month_start").select(
        ym("month_start").alias("month"), money("cost", "spend"), money("budget"),
        rounded(F.col("cost") - F.col("budget"), 2).alias("variance"),
        rounded(ratio_null("cost", "budget"), 4).alias("pct"), status.alias("latest_status"),
    )

"""Budget tables: find the header, read dimensions and the amount, make it monthly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adinsight.functions.numbers import col, parse_number, rounded
from adinsight.sources.report_files import read_cells

# Header words per role.  The two short keys match whole words only.
HEADER_KEYS = {
    "brand": ("brand", "bu", "business unit", "account"),
    "region": ("region", "state", "market", "metro", "dma", "geo", "location", "territory"),
    "category": ("category", "categories", "cat", "service", "services", "product", "line", "vertical"),
    "amount": ("budget", "amount", "monthly", "annual", "spend", "target", "allocation", "usd"),
}
WHOLE_WORDS = ("bu", "cat")
HEADER_ROWS = 5


def _pattern(keys: tuple[str, ...]) -> str:
    return "|".join(rf"\b{k}\b" if k in WHOLE_WORDS else k for k in keys)


def header_position(cells: Column | str, role: str) -> Column:
    """Index of the first header cell that fits the role, null when none does."""
    words = F.transform(col(cells), lambda x: F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " ")))
    fits = F.transform(words, lambda w: w.rlike(_pattern(HEADER_KEYS[role])))
    return F.nullif(F.array_position(fits, F.lit(True)), F.lit(0)).cast("int") - 1


def find_header(rows: DataFrame, header_rows: int = HEADER_ROWS) -> DataFrame:
    """The header among the first ``header_rows`` rows: an amount column and one dimension."""
    first = rows.orderBy("row_index").limit(header_rows)
    spotted = first.select("row_index", *[header_position("cells", role).alias(role) for role in HEADER_KEYS])
    usable = spotted.filter(F.col("amount").isNotNull() & F.coalesce("brand", "region", "category").isNotNull())
    return usable.orderBy("row_index").limit(1)


def budget_lines(rows: DataFrame, period: str = "monthly", window_months: int = 12, header_rows: int = HEADER_ROWS) -> DataFrame:
    """Monthly budget lines from ``(row_index, cells)`` rows; rows without amount drop out.

    ``annual`` amounts are divided by twelve, ``total`` amounts by the window. Rows without a header among the first
    ``header_rows`` fail when they are read.
    """
    head = find_header(rows, header_rows).select(F.struct("row_index", *HEADER_KEYS)).scalar()
    divisor = {"annual": 12.0, "total": float(max(1, window_months))}.get(period, 1.0)
    cell = lambda role: F.get(F.col("cells"), F.col(f"head.{role}"))
    amount = parse_number(F.nullif(F.trim(cell("amount")), F.lit("--")))
    below = F.when(F.col("head").isNull(), F.raise_error(F.lit(f"no budget header in the first {header_rows} rows")).cast("boolean")).otherwise(
        F.col("row_index") > F.col("head.row_index"))
    lines = rows.withColumn("head", head).filter(below).select(
        *[F.nullif(F.trim(cell(d)), F.lit("")).alias(d) for d in ("brand", "region", "category")],
        rounded(amount / divisor, 2).alias("monthly"),
    )
    return lines.filter(F.col("monthly").isNotNull())


def read_budget(spark: SparkSession, path: str, period: str = "monthly", window_months: int = 12, header_rows: int = HEADER_ROWS) -> DataFrame:
    """Budget lines of a CSV file; raises when no header or no usable row exists."""
    rows = read_cells(spark, [path], preamble=False)
    if find_header(rows, header_rows).isEmpty():
        raise ValueError("no amount column next to a brand, region or category column")
    lines = budget_lines(rows, period, window_months, header_rows)
    if lines.isEmpty():
        raise ValueError("the budget file has no usable rows")
    return lines

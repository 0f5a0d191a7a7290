"""Exact sums, guarded ratios, rounding and number parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1_000_000

# Tokens that stand for "no value" in exported cells.
NULL_TOKENS = ("--", "", "< 10%", "<0.1")

# Plain decimal or scientific notation; rejects Java suffixes, NaN and infinities.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def units(c: Column | str) -> Column:
    """A metric as whole millionths (missing = 0), so sums are exact and order-free."""
    return F.coalesce(F.floor(col(c).cast("double") * SCALE + F.lit(0.5)), F.lit(0)).cast("bigint")


def total(c: Column | str, where: Column | None = None) -> Column:
    """Exact sum of a metric, optionally only over the rows where ``where`` holds."""
    value = units(c)
    if where is not None:
        value = F.when(where, value).otherwise(F.lit(0).cast("bigint"))
    return F.coalesce(F.sum(value), F.lit(0)) / F.lit(float(SCALE))


def count_where(where: Column) -> Column:
    return F.count(F.when(where, F.lit(1)))


def ratio_null(num: Column | str, den: Column | str) -> Column:
    return F.try_divide(col(num), col(den))


def ratio0(num: Column | str, den: Column | str) -> Column:
    return F.coalesce(ratio_null(num, den), F.lit(0.0))


def rounded(c: Column | str, digits: int) -> Column:
    """Half-up rounding on the decimal value, back to double."""
    return F.round(col(c).cast("decimal(28,10)"), digits).cast("double")


def whole(c: Column | str) -> Column:
    return F.round(col(c).cast("decimal(28,10)"), 0).cast("bigint")


def change(cur: Column | str, prev: Column | str) -> Column:
    """Relative change, 4 digits; null when the previous value is zero or missing."""
    return rounded(ratio_null(col(cur) - col(prev), col(prev)), 4)


def clean_cell(c: Column | str) -> Column:
    """Trim blanks and surrounding quotes, turn null tokens into null."""
    blanks = r"^\s+|\s+$"
    unquoted = F.regexp_replace(F.regexp_replace(col(c), blanks, ""), r'^"+|"+$', "")
    trimmed = F.regexp_replace(unquoted, blanks, "")
    return F.when(~trimmed.isin(*NULL_TOKENS), trimmed)


def parse_number(c: Column | str) -> Column:
    """``"$1,234.5"`` or ``"12%"`` to double; anything that is no plain number to null."""
    text = F.trim(F.regexp_replace(col(c), r"[,$%]", ""))
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def money_text(c: Column | str) -> Column:
    return F.concat(F.lit("$"), F.format_number(whole(c), 0))


def whole_text(c: Column | str) -> Column:
    return whole(c).cast("string")


def grouped_text(c: Column | str) -> Column:
    return F.format_number(whole(c), 0)


def fixed_text(c: Column | str, digits: int) -> Column:
    """Plain decimal text with a fixed number of digits."""
    return F.round(col(c).cast("decimal(28,10)"), digits).cast(f"decimal(28,{digits})").cast("string")

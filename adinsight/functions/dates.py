"""Month labels, month bounds, export windows and date presets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from adinsight.functions.numbers import col

# Date formats that appear in the window line of an export.
WINDOW_FORMATS = ("MMMM d, yyyy", "MMM d, yyyy", "yyyy-MM-dd")


def month_start(label: Column | str) -> Column:
    """``"June 2026"`` (any case, any blanks) to the first day of that month, else null."""
    text = F.regexp_replace(F.trim(col(label)), r"\s+", " ")
    return F.when(text.rlike(r"^[A-Za-z]+ \d{4}$"), F.try_to_timestamp(text, F.lit("MMMM yyyy")).cast("date"))


def ym(month: Column | str) -> Column:
    return F.date_format(col(month), "yyyy-MM")


def month_abbr(month: Column | str) -> Column:
    return F.date_format(col(month), "MMM yyyy")


def month_name(month: Column | str) -> Column:
    return F.date_format(col(month), "MMMM yyyy")


def month_bound(text: Column | str) -> Column:
    """Month of a ``yyyy-MM`` or ``yyyy-MM-dd`` prefix, null when there is none."""
    part = F.regexp_extract(F.coalesce(col(text), F.lit("")), r"^(\d{4}-\d{2})", 1)
    return F.try_to_timestamp(F.when(part != "", F.concat(part, F.lit("-01"))), F.lit("yyyy-MM-dd")).cast("date")


def month_of(value: str | dt.date | None) -> Column | None:
    """Driver-side bound (a string or a date) as a month literal."""
    if value is None or value == "":
        return None
    return month_bound(F.lit(str(value)))


def complete_month(window_end: Column | str) -> Column:
    """Last month that ends on or before ``window_end``."""
    end = col(window_end).cast("date")
    first = F.trunc(end, "month").cast("date")
    return F.when(F.last_day(end) == end, first).otherwise(F.add_months(first, -1))


def _window_date(text: Column) -> Column:
    stamps = [F.try_to_timestamp(F.trim(text), F.lit(fmt)) for fmt in WINDOW_FORMATS]
    return F.coalesce(*stamps).cast("date")


def window_bounds(raw: Column | str) -> Column:
    """Window line to ``struct(window_start, window_end)``; a single date is both ends."""
    parts = F.split(F.trim(col(raw)), r"\s+-\s+")
    first = _window_date(F.get(parts, F.lit(0)))
    second = F.when(F.size(parts) == 2, _window_date(F.get(parts, F.lit(1)))).when(F.size(parts) == 1, first)
    return F.struct(
        F.when(F.size(parts) <= 2, first).alias("window_start"),
        second.alias("window_end"),
    )


def _preset_bounds(today: Column) -> dict[str, tuple[Column, Column]]:
    """First and last day of each named preset; week starts on Sunday."""
    month = F.trunc(today, "month").cast("date")
    yesterday = F.date_sub(today, 1)
    sunday = F.date_sub(today, F.dayofweek(today) - 1)
    last_month = F.add_months(month, -1)
    return {
        "mtd": (month, today),
        "lastmonth": (last_month, F.last_day(last_month)),
        "ytd": (F.trunc(today, "year").cast("date"), today),
        "today": (today, today),
        "yesterday": (yesterday, yesterday),
        "thisweek": (sunday, today),
        "last7": (F.date_sub(today, 7), yesterday),
        "lastweek": (F.date_sub(sunday, 7), F.date_sub(sunday, 1)),
        "last14": (F.date_sub(today, 14), yesterday),
        "last30": (F.date_sub(today, 30), yesterday),
    }


def date_presets(today: Column | str) -> Column:
    """``array<struct(preset, date_from, date_to)>`` for a day; ``all`` is unbounded."""
    day = col(today).cast("date")
    none = F.lit(None).cast("date")
    bounds = {**_preset_bounds(day), "all": (none, none)}
    return F.array(
        *[
            F.struct(F.lit(name).alias("preset"), lo.alias("date_from"), hi.alias("date_to"))
            for name, (lo, hi) in bounds.items()
        ]
    )


def last_days(today: Column | str, days: int, upto: str = "yesterday") -> Column:
    """``struct(date_from, date_to)`` of the last ``days`` days up to today or yesterday."""
    day = col(today).cast("date")
    end = day if upto == "today" else F.date_sub(day, 1)
    return F.struct(F.date_sub(end, max(1, days) - 1).alias("date_from"), end.alias("date_to"))

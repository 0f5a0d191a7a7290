"""Grades, scores, buckets and statuses as ``when`` chains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from adinsight.functions.matching import lowered
from adinsight.functions.numbers import col, ratio0

# Labels and their order in reports.
GRADES = (
    "A — Top Performer",
    "B — Good",
    "C — Average",
    "D — Below Average",
    "F — Poor / No Conversions",
    "Low Volume",
)
RATINGS = ("Above average", "Average", "Below average")
INTENTS = ("Relevant", "Competitor", "Needs Review", "Irrelevant")
STATUSES = ("Recommend to Add", "Already Added", "Review", "Excluded", "Unassigned")

# Lower bounds of grades A to D.
TERM_BANDS = (0.40, 0.25, 0.15, 0.05)
AD_BANDS = (0.10, 0.06, 0.04, 0.02)
BRANDED_AD_BANDS = (0.30, 0.20, 0.10, 0.05)
PAGE_SCORES = ((0.45, "Excellent"), (0.30, "Strong"), (0.20, "Average"))
HEAT_BANDS = ((40.0, "hi"), (25.0, "mh"), (15.0, "md"), (7.0, "lw"))


def banded(value: Column, bands: Sequence[tuple[float, str]], below: str) -> Column:
    chain = F.when(value >= bands[0][0], bands[0][1])
    for bound, label in bands[1:]:
        chain = chain.when(value >= bound, label)
    return chain.otherwise(below)


def _graded(value: Column, bounds: Sequence[float]) -> Column:
    return banded(value, tuple(zip(bounds, GRADES)), GRADES[4])


def _n(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("double"), F.lit(0.0))


def grade_term(clicks: Column | str, conversions: Column | str) -> Column:
    return F.when(_n(clicks) < 5, GRADES[5]).otherwise(_graded(ratio0(_n(conversions), _n(clicks)), TERM_BANDS))


def grade_ad(clicks: Column | str, impressions: Column | str, branded: Column) -> Column:
    ctr = ratio0(_n(clicks), _n(impressions))
    return (
        F.when(_n(impressions) < 100, GRADES[5])
        .when(branded, _graded(ctr, BRANDED_AD_BANDS))
        .otherwise(_graded(ctr, AD_BANDS))
    )


def grade_page(clicks: Column | str, impressions: Column | str, conversions: Column | str) -> Column:
    thin = (_n(impressions) < 100) | (_n(clicks) < 5)
    return F.when(thin, GRADES[5]).otherwise(_graded(ratio0(_n(conversions), _n(clicks)), TERM_BANDS))


def page_score(clicks: Column | str, conversions: Column | str) -> Column:
    cvr = ratio0(_n(conversions), _n(clicks))
    return F.when(_n(clicks) < 5, "—").otherwise(banded(cvr, PAGE_SCORES, "Below Avg"))


def heat_band(percent: Column | str) -> Column:
    return banded(col(percent), HEAT_BANDS, "vl")


def rating(c: Column | str) -> Column:
    """Free rating text to one of the three labels, else null."""
    text = lowered(c)
    return (
        F.when(text.contains("above"), RATINGS[0])
        .when(text.contains("below"), RATINGS[2])
        .when(text.contains("average"), RATINGS[1])
    )


def match_type_bucket(c: Column | str) -> Column:
    text = lowered(c)
    return (
        F.when(text.startswith("exact"), "Exact")
        .when(text.startswith("phrase"), "Phrase")
        .when(text.startswith("broad"), "Broad")
        .otherwise("Other")
    )


def budget_status(budget: Column | str, actual: Column | str) -> Column:
    used = F.try_divide(col(actual), col(budget))
    return (
        F.when(used.isNull(), "n/a").when(used > 1.05, "over").when(used < 0.9, "under").otherwise("on-track")
    )


def keyword_status(added_excluded: Column | str, grade: Column | str) -> Column:
    flag, letter = lowered(added_excluded), F.substring(col(grade), 1, 1)
    return (
        F.when(flag.contains("exclud"), "Excluded")
        .when(flag.contains("add"), "Already Added")
        .when(letter.isin("A", "B", "C"), "Recommend to Add")
        .when(letter == "D", "Review")
        .otherwise("Unassigned")
    )


def pairing_quadrant(ad_grade: Column | str, page_grade: Column | str) -> Column:
    """Colour class of an ad grade × page grade cell."""
    ad, page = F.substring(col(ad_grade), 1, 1), F.substring(col(page_grade), 1, 1)
    good_page = page.isin("A", "B")
    return (
        F.when((ad == "L") | (page == "L"), "low_volume")
        .when(ad.isin("A", "B") & page.isin("D", "F"), "red")
        .when(ad.isin("A", "B", "C") & good_page, "green")
        .when(ad.isin("D", "F") & good_page, "amber")
        .otherwise("neutral")
    )


def heat_linear(value: Column, low: Column, high: Column, higher_is_better: bool) -> Column:
    """Position in [0, 1] between the extremes, 0 being the good end."""
    t = F.try_divide(value - low, high - low)
    return F.lit(1.0) - t if higher_is_better else t


def heat_sqrt(value: Column, high: Column) -> Column:
    """Square-root position in [0, 1]; null for empty cells."""
    t = F.sqrt(F.try_divide(value, high))
    return F.when((value > 0) & (high > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))

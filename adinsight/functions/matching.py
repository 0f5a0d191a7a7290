"""Ordered dictionary matching: substring semantics, first configured hit wins.

Dictionaries come from the client configuration.  Short ones unroll into a chain
of ``contains`` (constant-folded, inside codegen); long ones become one quoted
alternation, so the generated code does not grow with the list.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from adinsight.config import ClientConfig
from adinsight.functions.numbers import col

CHAIN_LIMIT = 24

# Words that carry no meaning in category names.
CATEGORY_STOP_WORDS = ("and", "the", "for", "goods", "supplies", "store", "products", "items")

# Words left out of waste themes.
THEME_STOP_WORDS = (
    "a an the of for to in on at and or near me my i you your with by "
    "is are best top buy shop store online"
).split()


def lowered(c: Column | str) -> Column:
    return F.lower(F.coalesce(col(c), F.lit("")))


def _quoted(term: str) -> str:
    return r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """True when the (already lower-cased) text contains one of the terms."""
    needles = [t.lower() for t in terms if t]
    if not needles:
        return F.lit(False)
    if len(needles) > CHAIN_LIMIT:
        return text.rlike("|".join(_quoted(t) for t in needles))
    hit = text.contains(needles[0])
    for term in needles[1:]:
        hit = hit | text.contains(term)
    return hit


def is_brand(text: Column | str, cfg: ClientConfig) -> Column:
    return contains_any(lowered(text), cfg.brand_terms)


def category_words(category: str) -> list[str]:
    """Alphabetic words of four or more letters."""
    return [w for w in re.findall("[a-z]+", category.lower()) if len(w) >= 4]


def category_label(category: str) -> str:
    """Only the first letter changes; the rest keeps its case."""
    return category[:1].upper() + category[1:]


def first_match(text: Column, rules: Sequence[tuple[Iterable[str], str]], default: str | None = None) -> Column:
    """Label of the first rule whose terms occur in the text."""
    chain = None
    for terms, label in rules:
        hit = contains_any(text, terms)
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    fallback = F.lit(default).cast("string")
    return fallback if chain is None else chain.otherwise(fallback)


def category_rules(cfg: ClientConfig) -> list[tuple[list[str], str]]:
    return [([c, *category_words(c)], category_label(c)) for c in cfg.product_categories if c]


def category_of(text: Column | str, cfg: ClientConfig, default: str | None = None) -> Column:
    return first_match(lowered(text), category_rules(cfg), default)


def nonbrand_category(campaign: Column | str, cfg: ClientConfig) -> Column:
    """Category of a non-brand campaign from its name; null for brand campaigns."""
    name = lowered(campaign)
    structural = [
        (("pmax", "performance max"), "PMax"),
        (("conquest", "competitor"), "Conquest"),
        (("non-brand", "nonbrand", "non brand"), "Non-Brand Search"),
    ]
    brand = contains_any(name, ("brand defense", "| brand", *cfg.brand_terms))
    return F.when(~brand, first_match(name, category_rules(cfg) + structural, "Other Non-Brand"))


def matched_competitor(text: Column | str, cfg: ClientConfig) -> Column:
    return first_match(lowered(text), [((c,), c) for c in cfg.competitors if c])


def search_intent(text: Column | str, cfg: ClientConfig) -> Column:
    """Segment of a search term; competitor beats exclusion beats product."""
    name = lowered(text)
    product = category_of(text, cfg).isNotNull() | contains_any(name, cfg.brand_terms)
    return (
        F.when(contains_any(name, cfg.competitors), "Competitor")
        .when(contains_any(name, cfg.waste_exclusions), "Irrelevant")
        .when(product, "Relevant")
        .otherwise("Needs Review")
    )


def region_of_campaign(campaign: Column | str) -> Column:
    """Region after the tier token of a campaign name; short words upper-case."""
    raw = F.regexp_extract(lowered(campaign), r"tier\s+\S+\s*[-–:|]\s*(.+)$", 1)
    tidy = F.regexp_replace(raw, r"^[ \-–|]+|[ \-–|]+$", "")
    words = F.filter(F.split(tidy, r"\s+"), lambda w: w != "")
    label = F.array_join(
        F.transform(words, lambda w: F.when(F.length(w) <= 3, F.upper(w)).otherwise(F.initcap(w))), " "
    )
    return F.when(label != "", label)


def region_value(available: Iterable[str]) -> Column:
    """First non-empty geographic column, in the fixed order of the exports."""
    have = set(available)
    picks = [F.when(F.col(c) != "", F.col(c)) for c in GEO_COLUMNS if c in have]
    return F.coalesce(*picks) if picks else F.lit(None).cast("string")


# Geographic columns in order of preference.
GEO_COLUMNS = (
    "state_matched",
    "region",
    "region_user_location",
    "region_matched_location",
    "state",
    "metro",
    "metro_area",
    "city",
    "most_specific_location",
    "county",
)


def short_name(campaign: Column | str) -> Column:
    """Text after the last bar, or the whole name when nothing follows it."""
    c = col(campaign)
    tail = F.trim(F.element_at(F.split(F.coalesce(c, F.lit("")), r"\|"), -1))
    return F.when(tail != "", tail).otherwise(c)


def theme_tokens(text: Column | str) -> Column:
    """Distinct tokens of three or more characters without the stop words."""
    words = F.array_distinct(F.regexp_extract_all(lowered(text), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*THEME_STOP_WORDS))


def in_brand_list(listing: Column | str, brand: str) -> Column:
    """Membership in a list separated by commas, slashes, bars or blanks."""
    return F.array_contains(F.split(F.upper(col(listing)), r"[,\s/|]+"), brand.upper())


def url_brand(url: Column | str, cfg: ClientConfig) -> Column:
    """Brand whose configured fragment occurs first in rule order, else empty."""
    return first_match(lowered(url), [((fragment,), brand) for fragment, brand in cfg.url_brands], "")


def url_host(url: Column | str) -> Column:
    host = F.try_parse_url(col(url), F.lit("HOST"))
    return F.coalesce(F.regexp_replace(F.lower(host), r"^www\.", ""), col(url))


def url_path(url: Column | str) -> Column:
    """Path of a URL, ``/`` when it has none, the text itself when it is no URL."""
    host = F.try_parse_url(col(url), F.lit("HOST"))
    path = F.coalesce(F.try_parse_url(col(url), F.lit("PATH")), F.lit(""))
    return F.when(host.isNull(), col(url)).when(path == "", "/").otherwise(path)

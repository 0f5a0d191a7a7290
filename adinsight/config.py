"""Per-client business context: terms, thresholds, seasonality and budgets.

The configuration is a few dozen short strings typed by an account manager.  It
stays on the driver and enters plans as literals, so Catalyst can fold it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Analyzer defaults.
DEFAULT_THRESHOLDS: dict[str, float | None] = {
    "smart_bidding_floor": 30.0,
    "low_vol_conv": 15.0,
    "low_vol_spend": 100.0,
    "qs_floor": 3.0,
    "monthly_budget": None,
}

TERM_LISTS = (
    "brand_terms",
    "product_categories",
    "competitors_friendly",
    "competitors_conquest",
    "waste_exclusions",
)

BUDGET_DIMENSIONS = ("brand", "region", "category")
BUDGET_SCHEMA = "brand string, region string, category string, monthly double"


@dataclass(frozen=True)
class ClientConfig:
    """Immutable client context with the defaults filled in."""

    client_id: str = "client"
    name: str = "client"
    brand_terms: tuple[str, ...] = ()
    product_categories: tuple[str, ...] = ()
    competitors_friendly: tuple[str, ...] = ()
    competitors_conquest: tuple[str, ...] = ()
    waste_exclusions: tuple[str, ...] = ()
    thresholds: Mapping[str, float | None] = field(default_factory=lambda: dict(DEFAULT_THRESHOLDS))
    seasonality: tuple[Mapping[str, Any], ...] = ()
    budget_lines: tuple[Mapping[str, Any], ...] = ()
    url_brands: tuple[tuple[str, str], ...] = ()
    notes: str = ""

    @property
    def brand_label(self) -> str:
        return self.brand_terms[0] if self.brand_terms else self.name

    @property
    def competitors(self) -> tuple[str, ...]:
        """Conquest targets first, then the protected ones: the match order."""
        return self.competitors_conquest + self.competitors_friendly

    def threshold(self, key: str) -> float:
        """Configured threshold; an unset or zero value means the default."""
        return float(self.thresholds.get(key) or DEFAULT_THRESHOLDS[key] or 0.0)

    def budget_frame(self, spark: SparkSession) -> DataFrame:
        rows = [tuple(line.get(k) for k in ("brand", "region", "category", "monthly")) for line in self.budget_lines]
        return spark.createDataFrame(rows, BUDGET_SCHEMA)

    def updated(self, payload: Mapping[str, Any]) -> ClientConfig:
        """A copy with the known keys of ``payload`` merged in.

        Partial payloads leave other fields alone, thresholds merge key by key.
        Callers drop the client's relevance cache afterwards, because its
        verdicts depended on the old context (``relevance.invalidate``).
        """
        clean = sanitize(payload)
        if "thresholds" in clean:
            clean["thresholds"] = {**self.thresholds, **clean["thresholds"]}
        return replace(self, **clean)

    @classmethod
    def from_mapping(cls, raw: Mapping[str, Any] | None, **identity: str) -> ClientConfig:
        return cls(**identity).updated(raw or {})


class Rejected(ValueError):
    """A config value that its field cannot hold."""


def _as_terms(value: Any) -> tuple[str, ...]:
    """Trimmed non-empty texts; one text is split at commas and line breaks."""
    parts = re.split(r"[,\n]", value) if isinstance(value, str) else value
    if not isinstance(parts, Sequence):
        raise Rejected("a list or a comma-separated text is expected")
    return tuple(t for p in parts if (t := str(p).strip()))


def _as_amount(value: Any) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        raise Rejected(f"{value!r} is no number") from None


def _as_thresholds(value: Any) -> dict[str, float | None]:
    """Known thresholds; blank ones return to the default."""
    if not isinstance(value, Mapping):
        raise Rejected("a mapping of thresholds is expected")
    return {k: None if v in (None, "") else _as_amount(v) for k, v in value.items() if k in DEFAULT_THRESHOLDS}


def _as_budget_line(value: Any) -> dict[str, Any]:
    if not isinstance(value, Mapping):
        raise Rejected("a budget line is a mapping")
    line: dict[str, Any] = dict.fromkeys(BUDGET_DIMENSIONS)
    line |= {d: str(value[d]).strip() or None for d in BUDGET_DIMENSIONS if value.get(d) is not None}
    return line | {"monthly": round(_as_amount(value.get("monthly")), 2)}


def _as_pair(value: Any) -> tuple[str, str]:
    if isinstance(value, str) or not isinstance(value, Sequence) or len(value) != 2:
        raise Rejected("a pair of URL part and brand is expected")
    return str(value[0]), str(value[1])


def _as_mapping(value: Any) -> Mapping[str, Any]:
    if not isinstance(value, Mapping):
        raise Rejected("a mapping is expected")
    return value


def _each(one: Callable[[Any], Any]) -> Callable[[Any], tuple]:
    """A coercion of every entry of a list."""
    def every(value: Any) -> tuple:
        if isinstance(value, str) or not isinstance(value, Sequence):
            raise Rejected("a list is expected")
        return tuple(map(one, value))

    return every


#: How a client's own values become field values.  Identity fields are set by the caller.
COERCIONS: dict[str, Callable[[Any], Any]] = dict.fromkeys(TERM_LISTS, _as_terms) | {
    "thresholds": _as_thresholds, "seasonality": _each(_as_mapping), "budget_lines": _each(_as_budget_line),
    "url_brands": _each(_as_pair), "notes": str,
}


def sanitize(payload: Mapping[str, Any]) -> dict[str, Any]:
    """Field values of a config payload; keys that are no fields are left out.

    A value that does not fit its field raises :class:`Rejected` with the name of the field.
    """
    clean = {}
    for name in COERCIONS.keys() & payload.keys():
        try:
            clean[name] = COERCIONS[name](payload[name])
        except Rejected as why:
            raise Rejected(f"{name}: {why}") from None
    return clean

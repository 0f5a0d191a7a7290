"""Search-term relevance: built-in rules, a pluggable classifier and its cache."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adinsight.config import ClientConfig
from adinsight.functions.matching import CATEGORY_STOP_WORDS, category_words, contains_any, lowered

# Fixed value: terms of one call of an injected classifier.
BATCH_TERMS = 40

#: Source of a rule verdict that stands in for a failed batch.
AFTER_ERROR = "heuristic-after-error"

CACHE_SCHEMA = "client_id string, term string, relevant boolean, category string, reason string, source string"
VERDICT_SCHEMA = "term string, relevant boolean, category string, reason string, source string"

# A classifier gets a batch of terms and the business context, and returns
# {term: {"relevant": bool, "category": str, "reason": str}} for some or all of them.
Classifier = Callable[[list[str], Mapping[str, tuple[str, ...]]], Mapping[str, Mapping[str, object]]]


def product_words(cfg: ClientConfig) -> list[str]:
    """Significant words of the product categories and their crude singulars."""
    words = {w for c in cfg.product_categories for w in category_words(c) if w not in CATEGORY_STOP_WORDS}
    return sorted(words | {w[:-1] for w in words if w.endswith("s")})


def heuristic(term: Column | str, cfg: ClientConfig) -> Column:
    """Verdict struct from brand, conquest and product words, in that order."""
    text = lowered(term)
    words = product_words(cfg)
    tokens = F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0))
    product = F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words])) if words else F.lit(False)

    def verdict(relevant: bool, category: str, reason: str) -> Column:
        return F.struct(
            F.lit(relevant).alias("relevant"), F.lit(category).alias("category"), F.lit(reason).alias("reason"),
            F.lit("heuristic").alias("source"),
        )

    return (
        F.when(contains_any(text, cfg.brand_terms), verdict(True, "brand", "brand term"))
        .when(contains_any(text, cfg.competitors_conquest), verdict(True, "competitor", "competitor term"))
        .when(product, verdict(True, "product", "matches a product category"))
        .otherwise(verdict(False, "unrelated", "no product/brand match"))
    )


def classify(terms: DataFrame, cfg: ClientConfig, term: str = "term") -> DataFrame:
    """Rule verdict for every row of ``terms``."""
    return terms.select(F.col(term).alias("term"), heuristic(term, cfg).alias("v")).select("term", "v.*")


def classify_with(terms: DataFrame, cfg: ClientConfig, classifier: Classifier, batch: int = BATCH_TERMS,
                  source: str = "model") -> DataFrame:
    """Verdicts of an injected classifier, the rules filling every gap.

    Partitions are classified in batches of at most ``batch`` terms.  Terms the
    classifier drops take the rule verdict; so do batches it fails on, whose
    ``source`` says so.
    """
    context = {
        "product_categories": cfg.product_categories,
        "brand_terms": cfg.brand_terms,
        "competitors_conquest": cfg.competitors_conquest,
    }

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            names = frame["term"].tolist()
            for start in range(0, len(names), batch):
                part, failed = names[start:start + batch], False
                try:
                    answers = dict(classifier(part, context))
                except Exception:  # any classifier failure falls back to the rules
                    answers, failed = {}, True
                rows = [(t, answers.get(t)) for t in part]
                yield pd.DataFrame({
                    "term": [t for t, _ in rows],
                    "relevant": pd.array([None if a is None else bool(a.get("relevant")) for _, a in rows], "boolean"),
                    "category": [None if a is None else str(a.get("category", "unrelated")) for _, a in rows],
                    "reason": [None if a is None else str(a.get("reason", "")) for _, a in rows],
                    "source": [AFTER_ERROR if failed else None if a is None else source for _, a in rows],
                })

    answered = terms.select(F.col("term")).distinct().mapInPandas(run, VERDICT_SCHEMA)
    fallback = heuristic("term", cfg)
    missing = F.col("relevant").isNull()
    filled = [F.when(missing, fallback[c]).otherwise(F.col(c)).alias(c) for c in ("relevant", "category", "reason")]
    return answered.select("term", *filled, F.coalesce("source", fallback["source"]).alias("source"))


def known_verdicts(cache: DataFrame, client_id: str, wanted: DataFrame) -> DataFrame:
    """One cached verdict per wanted term of the client; among repeats the largest, whatever their order."""
    own = cache.filter(F.col("client_id") == client_id).join(wanted.select("term").distinct(), "term", "left_semi")
    verdict = F.struct("source", "relevant", "category", "reason")
    return own.groupBy("term").agg(F.max(verdict).alias("v")).select("term", "v.relevant", "v.category", "v.reason", "v.source")


def with_verdicts(rows: DataFrame, cfg: ClientConfig, cache: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``verdict`` and ``relevant`` of every non-empty term: cached where known, else by the rules."""
    rule = F.when(F.col("term") != "", heuristic("term", cfg))
    if cache is None:
        ruled = rows.withColumn("_rule", rule)
        return ruled.select(*rows.columns, F.col("_rule.category").alias("verdict"), F.col("_rule.relevant").alias("relevant"))
    known = known_verdicts(cache, cfg.client_id, rows).select("term", F.col("category").alias("_c"), F.col("relevant").alias("_r"))
    ruled = rows.withColumn("_rule", rule).join(known, "term", "left")
    return ruled.select(*rows.columns, F.coalesce("_c", "_rule.category").alias("verdict"), F.coalesce("_r", "_rule.relevant").alias("relevant"))


def unseen(terms: DataFrame, cache: DataFrame, client_id: str) -> DataFrame:
    """Terms of the client that have no cached verdict."""
    known = cache.filter(F.col("client_id") == client_id).select("term")
    return terms.select("term").distinct().join(known, "term", "left_anti")


def refresh_cache(terms: DataFrame, cache: DataFrame, cfg: ClientConfig,
                  classifier: Classifier | None = None) -> DataFrame:
    """Cached verdicts, one a client and term, plus fresh ones for the unseen terms; returns the new cache."""
    fresh = unseen(terms, cache, cfg.client_id)
    verdicts = classify(fresh, cfg) if classifier is None else classify_with(fresh, cfg, classifier)
    rows = verdicts.select(F.lit(cfg.client_id).alias("client_id"), "term", "relevant", "category", "reason", "source")
    verdict = F.struct("source", "relevant", "category", "reason")
    once = cache.groupBy("client_id", "term").agg(F.max(verdict).alias("v"))
    return once.select("client_id", "term", "v.relevant", "v.category", "v.reason", "v.source").unionByName(rows)


def invalidate(cache: DataFrame, client_id: str) -> DataFrame:
    """The cache without one client's verdicts (after a config change)."""
    return cache.filter(F.col("client_id") != client_id)

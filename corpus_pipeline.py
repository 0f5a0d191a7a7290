"""A training corpus from ``documents``: quality rules, near-duplicates, decontamination, personal data, token ids.

Each stage takes all rows that its predecessor kept, written as Parquet and read again. All but the last return the
columns of their input; ``n_chars`` follows the text where there is such a column.

Nulls and odd rows: a document without words fails the quality rules; rows of one id are documents of their own until
the near-duplicate stage, which keeps one of each group; an empty table passes through; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adinsight.llm import bpe, decontamination, jaccard_join, pii, quality_rules
from adinsight.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _counted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars, if it has the column, as long as its text is now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles."""
    return jaccard_join.one_of_each(docs).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, without what they share with benchmark items."""
    return _counted(decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    return _counted(pii.replace(docs, pii.DEMO_KEY).select(*docs.columns))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents and the digests of ids and decoded text."""
    import public_tokenizers

    # workers stay beside stages of other kinds, without the memos
    rows = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), decoded=True, keep=False)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("pii", personal_data),
    ("bpe", token_ids),
]

#: No stage but the base rules can be stated in SQL; tests/llm holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir).drop("ids")

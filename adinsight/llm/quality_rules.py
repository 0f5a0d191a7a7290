"""Quality rules from hashed n-gram likelihood ratios, in DataFrame functions only.

Two multinomials over hashed word unigrams and bigrams are compared: that of trusted documents (labelled as good and
not toxic) and that of the raw corpus. Both are add-k smoothed at the size of the trusted counts, so an n-gram that is
too rare to be expected among the trusted ones says nothing. A document's score is the mean log ratio over its
n-grams; the verdict compares it with one fixed threshold. Base rules on the text stand beside it.

The trusted side is fitted on at most ``TRUSTED_ROWS`` labelled documents, taken in the order of the hash of their
ids; the raw side counts every document. Only those ids and the ``BUCKETS`` ratios ever leave
the executors.

Nulls: a null text has no words. A document without n-grams scores 0. A document without a label, with a null label or
with a null id is not trusted; several labels of one id must all be good. Rows with the same id are documents of their
own. Without any trusted document every score is 0, an empty table gives no rows, further columns are kept, or
ignored by the model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adinsight.llm.common import WORD, packed, table, unpacked, whole, written

BUCKETS = 1 << 14
#: Pseudo-count of each bucket.
SMOOTHING = 10.0
#: Lowest mean log ratio (nats an n-gram) of a document that stays.
THRESHOLD = -0.06
#: Labelled documents that the trusted side is fitted on, at most.
TRUSTED_ROWS = 50_000
WINDOW = 8


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _grams(hashes: str, buckets: int) -> Column:
    """Buckets of all unigrams and bigrams of an array of word hashes."""
    pairs = F.greatest(F.size(hashes) - 1, F.lit(0))
    one = F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int"))
    two = F.zip_with(F.slice(hashes, 1, pairs), F.slice(hashes, 2, pairs), lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS,
        smoothing: float = SMOOTHING, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """The model: bucket, ratio (log of trusted over raw probability), for every bucket."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    trusted = (labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__t"))
               .agg(F.min(F.coalesce(good, F.lit(False))).alias("good")).filter("good").select("__t")
               .orderBy(F.xxhash64("__t"), "__t").limit(trusted_rows))
    rows = docs.select(F.col(id_col).alias("__d"), _hashed(_words(whole(text_col))).alias("hashes"))
    marked = rows.join(F.broadcast(trusted), F.col("__d") == F.col("__t"), "left")  # at most trusted_rows ids
    grams = marked.select(F.col("__t").isNotNull().cast("long").alias("t"), F.explode(_grams("hashes", buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("good"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(counts, "bucket", "left").select(
        "bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good"))
    counts = written(counts, "ngram-counts")
    sums = counts.agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    share = sums.select(F.coalesce(F.col("good") / F.nullif(F.col("raw"), F.lit(0)), F.lit(0.0))).scalar()
    return counts.select("bucket", F.log((F.col("good") + smoothing) / (F.col("raw") * share + smoothing)).alias("ratio"))


def score(docs: DataFrame, model: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with the columns __words, __hashes and __score (mean log ratio of its n-grams)."""
    # One number a bucket, in a literal: subqueries may not stand in lambdas, and a column of them would be copied per row.
    numbers = {r.bucket: r.ratio for r in model.collect()}
    ratios = F.split(F.lit(",".join(repr(numbers.get(b, 0.0)) for b in range(buckets))), ",").cast("array<double>")
    hashed = docs.withColumn("__words", _words(whole(text_col))).withColumn("__hashes", _hashed(F.col("__words")))
    total = F.aggregate(_grams("__hashes", buckets), F.lit(0.0), lambda a, g: a + F.get(ratios, g))
    n = 2 * F.size("__hashes") - 1
    return hashed.withColumn("__score", F.when(n > 0, total / n).otherwise(0.0))


def repeated_words(rows: DataFrame, hashes: str = "__hashes", window: int = WINDOW) -> DataFrame:
    """``rows`` with __n_repeat: words in windows found twice or more in the same text."""
    n = F.size(hashes)
    windows = F.when(n > window, F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice(hashes, i, window))))
    rows = rows.withColumn("__windows", windows)
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    pairs = F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("__sorted", F.when(repeats, pairs))

    def twin(x: Column, i: Column) -> Column:
        return (x["h"] == F.get("__sorted", i - 1)["h"]) | (x["h"] == F.get("__sorted", i + 1)["h"])

    at = F.sort_array(F.transform(F.filter("__sorted", twin), lambda x: x["i"]))
    none = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
    covered = F.aggregate(at, none, lambda a, p: F.struct(
        (p + window).alias("to"), (a["n"] + p + window - F.greatest(p, a["to"])).alias("n")), lambda a: a["n"])
    return rows.withColumn("__n_repeat", F.coalesce(covered, F.lit(0)).cast("long")).drop("__windows", "__sorted")


def assess(docs: DataFrame, model: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the base counts and verdicts in columns named __n_words to __kept."""
    text = whole(text_col)
    rows = repeated_words(score(docs, model, text_col))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    rows = rows.withColumn("__lines", lines)
    rows = rows.withColumns({
        "__n_words": F.size("__words").cast("long"),
        "__word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
        "__n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long"),
        "__n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
    }).drop("__words", "__hashes", "__lines")
    failed = (F.col("__n_words") < 20) | (100 * F.col("__n_repeat") > 30 * F.col("__n_words"))
    return rows.withColumn("__base_failed", failed).withColumn("__kept", ~F.col("__base_failed") & (F.col("__score") >= threshold))


def kept(docs: DataFrame, model: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    rows = assess(packed(docs, text_col), model, "text", threshold).withColumn("__row", F.monotonically_increasing_id())
    # A filter on the verdict alone would be pushed below the projections that build it, each of which would then be
    # repeated for every use of its result; one that needs a row number stays where it stands.
    rows = rows.filter("__kept and __row >= 0")
    return rows.select(*unpacked(rows, docs, text_col))


def op6_ngram_ratio_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdicts of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = assess(docs, fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__word_chars").alias("word_chars"), F.col("__n_symbols").alias("n_symbols"),
                       F.col("__n_dup_lines").alias("n_dup_lines"), F.col("__n_repeat").alias("n_repeat_words"),
                       F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"), F.col("__score").alias("ratio"))

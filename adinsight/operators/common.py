"""Building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from adinsight.functions.numbers import ratio0, ratio_null, rounded, total, whole

def everything() -> WindowSpec:
    """One window over all rows; only for results with a handful of rows."""
    return Window.partitionBy()


def text_column(df: DataFrame, name: str) -> Column:
    """The column as text, or an empty string where a report does not carry it."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def column_or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def label_frame(spark: SparkSession, columns: Sequence[str], rows: Iterable[Sequence[str | int]]) -> DataFrame:
    """A constant frame of labels, produced inside the plan (no local data shipped)."""
    structs = [F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))


def with_empty_labels(grouped: DataFrame, keys: Sequence[str], labels: DataFrame) -> DataFrame:
    """Add a zero row for every label combination that has no data.

    ``grouped`` is already aggregated to the few label groups, so the second
    aggregation handles a handful of rows; no join is involved.  All measures
    must be additive numbers.
    """
    measures = [c for c in grouped.columns if c not in keys]
    types = dict(grouped.dtypes)
    zeros = labels.select(*keys, *[F.lit(0).cast(types[m]).alias(m) for m in measures])
    return grouped.unionByName(zeros).groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def totals(*, cost: str = "cost", clicks: str | None = None, conv: str | None = None, impr: str | None = None,
           where: Column | None = None) -> list[Column]:
    """Exact metric sums under their short names."""
    pairs = (("cost", cost), ("clicks", clicks), ("conv", conv), ("impr", impr))
    return [total(source, where).alias(name) for name, source in pairs if source]


def rates(null_cpa: bool = False) -> list[Column]:
    """CPC, CTR, CVR and CPA from summed ``cost, clicks, conv, impr``."""
    cpa = ratio_null("cost", "conv") if null_cpa else ratio0("cost", "conv")
    return [
        rounded(ratio0("cost", "clicks"), 2).alias("cpc"),
        rounded(ratio0("clicks", "impr"), 4).alias("ctr"),
        rounded(ratio0("conv", "clicks"), 4).alias("cvr"),
        rounded(cpa, 2).alias("cpa"),
    ]


def money(name: str, alias: str | None = None) -> Column:
    return rounded(name, 2).alias(alias or name)


def tenth(name: str, alias: str | None = None) -> Column:
    return rounded(name, 1).alias(alias or name)


def count(name: str, alias: str | None = None) -> Column:
    return whole(name).alias(alias or name)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def shuffle_width(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, spread: Sequence[str],
                  rank: str = "rank") -> DataFrame:
    """Exact top ``k`` rows of each group, safe for a group that holds most rows.

    A first ranking inside (group, salt) keeps at most ``k`` rows per salt and is
    pruned before its shuffle; the second ranking then sees at most
    ``k × salts`` rows per group.  ``spread`` columns feed the salt.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(shuffle_width(df))))
    near = Window.partitionBy(*groups, "_salt").orderBy(*order)
    candidates = salted.withColumn("_near", F.row_number().over(near)).filter(F.col("_near") <= k)
    final = Window.partitionBy(*groups).orderBy(*order)
    ranked = candidates.drop("_near", "_salt").withColumn(rank, F.row_number().over(final))
    return ranked.filter(F.col(rank) <= k)


def exact_medians(df: DataFrame, groups: Sequence[str], value: str, salts: int = 16) -> DataFrame:
    """Exact lower and upper median per group, for any number of groups and without sorting a group in one task.

    A mergeable quantile sketch proposes edges, close together around the middle.  Rows
    are counted between the edges exactly, so the counts, not the sketch, say which
    stretch holds a middle rank; only the distinct values of that stretch are ranked,
    offset by the rows before it.  A poor edge makes a stretch longer, never a result
    wrong.  The edges meet the distinct values by (group, salt), so a group with most
    rows is spread.  A null group is a group, null values count for nothing.
    """
    reach = 0.001
    shares = F.array(*[F.lit(x) for x in (0.25, 0.45, 0.5 - reach, 0.5 + reach, 0.55, 0.75)])
    seen = df.filter(F.col(value).isNotNull()).select(*groups, F.col(value).alias("v"))
    counted = seen.groupBy(*groups, "v").agg(F.count("*").alias("rows"))
    edges = seen.groupBy(*groups).agg(F.count("*").alias("n"), F.percentile_approx("v", shares, F.lit(10_000)).alias("edge"))
    salted = edges.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    place = sum(((F.col("v") > F.get("edge", F.lit(i))).cast("int") for i in range(6)), F.lit(0))
    placed = same_keys(counted.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")), salted, [*groups, "_salt"])
    placed = placed.select(*groups, "v", "rows", "n", place.alias("place"))
    upto = F.sum("held").over(Window.partitionBy(*groups).orderBy("place"))
    stretches = placed.groupBy(*groups, "place").agg(F.sum("rows").alias("held"), F.max("n").alias("n")).withColumn("upto", upto)
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    before = F.col("upto") - F.col("held")
    middle = stretches.filter((before < high) & (F.col("upto") >= low)).select(*groups, "place", before.alias("before"))
    near = same_keys(placed, middle, [*groups, "place"])
    running = F.sum("rows").over(Window.partitionBy(*groups, "place").orderBy("v"))
    ranked = near.withColumn("last", F.col("before") + running)
    return ranked.groupBy(*groups).agg(
        F.min(F.when(F.col("last") >= low, F.col("v"))).alias("lower_median"),
        F.min(F.when(F.col("last") >= high, F.col("v"))).alias("upper_median"),
    )


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be null; the keys come from the left side."""
    other = right.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    return left.join(other, match).drop(*[f"_key{i}" for i in range(len(keys))])

"""Packing of token sequences by vector best fit.

A document's ids are cut into pieces from its end, so that all but the first fill a sequence. A piece asks for a vector
of tokens, documents (one) and attention cost (the square of its tokens, as attention stays within a document), and a
sequence has a capacity in each. Pieces are placed longest first into the open sequence that best fits: by the weighted
norm of what would be left, or by the weighted dot-product of that with the piece, under every constraint; a new one is
opened where none has room. The plan with the fewest sequences of the given rules is taken.

A piece's vector follows from its length, so the best fit runs over a histogram of lengths and over groups of sequences
in the same state: as the best sequence for a piece stays the best for the next equal one, it is filled with as many as
it takes, and equal sequences are filled alike. Histogram and plan are bounded by the capacity, whatever the corpus;
the result is that of placing all pieces one after another. Pieces find their places in Spark: their rank among those
of one length (counts by writing task and length, summed up by a window) tells run, sequence and offset.

Nulls: a null text has no ids but the end id; without an end id it gives no piece. Null ids and repeated rows are
documents of their own. Texts of any length are encoded and cut as a whole. Ties of the best fit go to the sequence
opened first; which of several equally long pieces takes which place is not fixed. An empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adinsight.llm.common import table, whole, written
from adinsight.llm.token_codes import word_memo

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Capacity(NamedTuple):
    """What one sequence may hold; the defaults beyond tokens never bind."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024

    @property
    def piece(self) -> int:
        """Tokens of the longest piece that an empty sequence takes."""
        return min(self.tokens, math.isqrt(self.attention))


class Rule(NamedTuple):
    """How the best fit is measured: ``norm`` or ``dot``, with weights of tokens, documents and attention."""

    kind: str = "norm"
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0)


RULES = (Rule(), Rule("norm", (1.0, 0.25, 0.0)), Rule("norm", (1.0, 0.0, 0.25)), Rule("dot", (1.0, 0.25, 0.25)))


class Run(NamedTuple):
    """Pieces of one length, numbered from ``low``: ``each`` of them side by side in sequences from ``first``."""

    length: int
    low: int
    count: int
    first: int
    each: int
    offset: int


# --- the plan ------------------------------------------------------------------------------------------------------

def best_fit(histogram: dict[int, int], capacity: Capacity, rule: Rule) -> tuple[int, list[Run]]:
    """Sequences and runs of placing all pieces, longest first."""
    full = np.array(capacity, np.int64)
    weights = np.array(rule.weights)
    left = np.zeros((0, 3), np.int64)  # of groups of sequences in one state
    first, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    opened, runs = 0, []
    for length in sorted(histogram, reverse=True):
        piece, todo, low = np.array([length, 1, length * length], np.int64), histogram[length], 0
        if (piece > full).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while todo:
            fits = np.flatnonzero((left >= piece).all(1))
            if len(fits):
                rest = (left[fits] - piece) / full
                measure = (weights * rest * rest).sum(1) if rule.kind == "norm" else (rest * weights * (piece / full)).sum(1)
                best = measure.min()
                at = fits[measure == best]
                at = int(at[first[at].argmin()])
            else:  # as many new ones as it takes
                each = int((full // piece).min())
                at = len(left)
                left, first, count = np.vstack([left, full]), np.append(first, opened), np.append(count, -(-todo // each))
                opened += int(count[at])
            each = int((left[at] // piece).min())
            state, start, size = left[at].copy(), int(first[at]), int(count[at])
            offset, whole_ones = int(full[0] - state[0]), min(todo // each, size)
            pieces = []  # (sequences, pieces in each) of the group, in order
            if whole_ones:
                pieces.append((whole_ones, each))
            over = todo - whole_ones * each
            if whole_ones < size and over:
                pieces.append((1, over))
            used = sum(n for n, _ in pieces)
            if used < size:
                pieces.append((size - used, 0))
            keep = np.arange(len(left)) != at
            left, first, count = left[keep], first[keep], count[keep]
            for n, k in pieces:
                if k:
                    runs.append(Run(length, low, n * k, start, k, offset))
                    low, todo = low + n * k, todo - n * k
                left, first, count = np.vstack([left, state - k * piece]), np.append(first, start), np.append(count, n)
                start += n
        open_ones = (left >= [1, 1, 1]).all(1)
        left, first, count = left[open_ones], first[open_ones], count[open_ones]
    return opened, runs


def plan(histogram: dict[int, int], capacity: Capacity, rules: tuple[Rule, ...] = RULES) -> tuple[int, list[Run]]:
    """The plan with the fewest sequences; ties go to the earlier rule."""
    return min((best_fit(histogram, capacity, rule) for rule in rules), key=lambda p: p[0])


# --- pieces and places ---------------------------------------------------------------------------------------------

def _pieces(docs: DataFrame, tokenizer: str, end_id: int | None, longest: int) -> DataFrame:
    """Rows (part, nth, id, piece, start, length, ids): all pieces, numbered within task and length."""
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(Path(tokenizer).read_text())
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType()), docs.schema["id"], T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = word_memo(definition.value), TaskContext.get().partitionId()
        seen = np.zeros(longest + 1, np.int64)  # pieces of each length so far
        for batch in batches:
            for first, stop, ids, sizes in coder.batches(batch.column(1), end_id):
                counts = -(-sizes // longest)
                owner = np.repeat(np.arange(len(sizes)), counts)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                head = (sizes - (counts - 1) * longest)[owner]  # of the first piece
                start = np.where(piece, head + (piece - 1) * longest, 0)
                length = np.where(piece, longest, head)
                order = np.argsort(length, kind="stable")
                values, begin, many = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(owner), np.int64)
                nth[order] = np.arange(len(owner)) - np.repeat(begin, many) + seen[length[order]]
                seen[values] += many
                ends = 4 * np.append(0, np.cumsum(length))
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(owner), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(owner), part, np.int32)), pa.array(nth), batch.column(0).slice(first, stop - first).take(pa.array(owner)),
                    pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), data.cast(pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), rules: tuple[Rule, ...] = RULES, end_id: int | None = None,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece (from 0), start (ids of its document before it), length, ids (little-endian unsigned 32-bit
    integers), sequence_id and offset in the sequence; the pieces of a sequence leave no gap."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    pieces = written(_pieces(rows, tokenizer, end_id, capacity.piece), "packing-pieces", compression="zstd")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = written(counts.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "packing-ranks")
    histogram = {r.length: r.n for r in ranks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length
    _, runs = plan(histogram, capacity, rules)
    by_length: dict[int, list[tuple]] = {}
    for run in runs:
        by_length.setdefault(run.length, []).append(tuple(run[1:]))
    places = spark.createDataFrame(list(by_length.items()),
                                   "length long, runs array<struct<low: long, count: long, first: long, each: long, offset: long>>")
    # Ranks are few for each writing task: Spark broadcasts them while they are small. Places are bounded by the capacity.
    placed = pieces.join(ranks.drop("n"), ["part", "length"]).join(F.broadcast(places), "length").withColumn("rank", F.col("nth") + F.col("earlier"))
    run = F.element_at(F.filter("runs", lambda r: (F.col("rank") >= r["low"]) & (F.col("rank") < r["low"] + r["count"])), 1)
    placed = placed.withColumn("run", run).withColumn("nth", F.col("rank") - F.col("run.low"))
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids",
        F.expr("run.first + nth div run.each").alias("sequence_id"), (F.col("run.offset") + F.col("nth") % F.col("run.each") * F.col("length")).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """Per sequence its ids and where each of its pieces starts, from the rows of :func:`pack`."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # no more than the capacity
    rows = packed.groupBy("sequence_id").agg(ordered.alias("pieces"))
    return rows.select("sequence_id", F.col("pieces.offset").alias("offsets"),
                       F.aggregate("pieces", F.lit(b""), lambda so_far, p: F.concat(so_far, p["ids"])).alias("ids"))


def op11_vector_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens; a row per piece."""
    import public_tokenizers

    rows = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return rows.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")

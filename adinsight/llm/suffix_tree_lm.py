"""Language-model scores from a probabilistic suffix tree over words.

States are word contexts of up to ``DEPTH`` words. A context is a candidate if it occurs ``LEAST_CONTEXT`` times in
training, whatever the size of the corpus; a next word is tested in it if the pair occurs ``LEAST_PAIR`` times. The word
keeps a probability of its own there if it diverges from what the next shorter context says (ratio and likelihood gain),
and a context without such a word is not retained. Kept probabilities are discounted; the mass that is left goes to all
other words in proportion to the shorter context, down to the smoothed unigrams. A word is scored by the longest
retained suffix of what stands before it in its document.

The tree lives in Spark tables of phrases (64-bit hashes of up to ``DEPTH`` + 1 words), grown a level at a time by joins
of counts: what a phrase may add to a score is a weight, as a context for the word after it and as a pair of context and
last word, so that a text's score is the sum of its unigram terms and of the weights of its phrases. Documents are scored
by slices of the weights: phrases are dealt by their hashes into slices of about ``SLICE`` entries, each is broadcast,
and the sums of all slices are added up. The number of slices follows the tree, their size does not.

Training counts a phrase only where bits of a fixed-size table say that its parts may be frequent enough. Most of those
are too rare themselves, so each level adds up hashes alone, in packed arrays, and keeps those that have the least count.
The texts are stored in units, and the parts of a phrase are told by the first unit that holds it, which bits of a table
name as well; the joins decide, so that a fuller table costs work, not phrases. The unigrams of the words that make up
``SHARE`` of the tokens or more (at most 1 / share words) are broadcast, those of all others reach the documents by a
join on the word.

Nulls: a null text has its end only. A document with a null id is held out. Rows with the same id are documents of
their own. A text of any length is read as a whole. An empty table gives no rows; without training documents every token
is unknown. Further columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adinsight.llm import hash_counts
from adinsight.llm.common import binary, groups, new_path, remove, table, tidy, whole, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEPTH = 3
#: Fewest occurrences of a context and of a pair.
LEAST_CONTEXT, LEAST_PAIR = 32, 8
#: Least ratio to the shorter context (or its inverse), and least gain in nats over all occurrences.
RATIO, GAIN = 1.25, 6.0
DISCOUNT = 0.5
ADDED = 0.1
#: Share of the tokens from which a word's unigram is broadcast instead of joined.
SHARE = 1e-6
#: The end of a document as a word; words hold no white space.
END = b" end"
#: Bytes of text, or of tokens, that are worked on together; bytes of tokens of a unit.
TOGETHER, UNIT = 4 << 20, 16 << 20
#: Weights that are broadcast together (16 bytes each).
SLICE = 3_000_000
#: Bits of the tables of marks: at least, at most, and for each token.
LEAST_BITS, MOST_BITS, BITS_PER_TOKEN = 1 << 18, 1 << 29, 1


def word_hash(word: bytes) -> int:
    value = xxhash.xxh64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


def _longer(phrases: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word in front."""
    x = phrases.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + before.view(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def phrases(tokens: np.ndarray, ends: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``most`` words: hashes of the phrases that end at each token, and whether they lie in one document."""
    place = np.arange(len(tokens)) - np.repeat(np.concatenate([[0], ends[:-1] + 1]), np.diff(ends, prepend=-1))
    out = [(tokens, place >= 0)]
    for k in range(1, most):
        longer = np.zeros(len(tokens), np.int64)
        if len(tokens) > k:
            longer[k:] = _longer(out[-1][0][k:], tokens[:-k])
        out.append((longer, place >= k))
    return out


# --- words -----------------------------------------------------------------------------------------------------------

def _numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes of some texts, the number of each token's, and the places of the ends."""
    words: list[bytes] = []
    ends = []
    for text in texts:
        words += text.lower().split()
        ends.append(len(words))
        words.append(END)
    numbered = pa.array(words, pa.large_binary()).dictionary_encode()
    return np.array([word_hash(w) for w in numbered.dictionary.to_pylist()], np.int64), numbered.indices.to_numpy(), np.array(ends, np.int64)


def _count_words(docs: DataFrame) -> DataFrame:
    """(hash, n) of all words of the rows (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch.column(0))
            for start, stop in groups(texts, len, TOGETHER):
                hashes, number, _ = _numbered(texts[start:stop])
                yield pa.RecordBatch.from_pydict({"hash": hashes, "n": np.bincount(number, minlength=len(hashes)).astype(np.int64)})

    return docs.mapInArrow(tidy(run), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


class Counts(NamedTuple):
    """Unigram counts: all of them in a table, those of the most frequent words in arrays."""

    words: DataFrame
    tokens: int
    distinct: int
    hashes: np.ndarray
    counts: np.ndarray

    @property
    def unit(self) -> float:
        return self.tokens + ADDED * (self.distinct + 1)


def count_words(training: DataFrame, share: float = SHARE) -> Counts:
    """Counts over the rows (text)."""
    words = written(_count_words(training), "lm-words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    often = words.filter(F.col("n") >= max(1, share * total.n)).toArrow()  # at most 1 / share words
    hashes, counts = (often.column(c).to_numpy() for c in ("hash", "n"))
    order = np.argsort(hashes)
    return Counts(words, total.n, total.v, hashes[order], counts[order])


def _encoded(docs: DataFrame, known: Counts) -> DataFrame:
    """Per document its tokens as hashes, the unigram terms of its frequent words, and its other words with multiplicities."""
    shared = docs.sparkSession.sparkContext.broadcast((known.hashes, np.log10((known.counts + ADDED) / known.unit)))
    rare = T.ArrayType(T.StructType([T.StructField("hash", T.LongType()), T.StructField("m", T.LongType())]))
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("unit", T.LongType()), docs.schema["id"], docs.schema["held_out"], T.StructField("n_tokens", T.LongType()),
        T.StructField("known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("tokens", T.BinaryType()), T.StructField("rare", rare),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, (frequent, terms) = to_arrow_schema(schema), shared.value
        row = unit = TaskContext.get().partitionId() << 40  # a unit is named by its first row
        size = 0
        for batch in batches:
            texts = binary(batch.column(2))
            for start, stop in groups(texts, len, TOGETHER):
                hashes, number, ends = _numbered(texts[start:stop])
                starts, n = np.concatenate([[0], ends[:-1] + 1]), stop - start
                at = np.minimum(np.searchsorted(frequent, hashes), max(len(frequent) - 1, 0))
                often = frequent[at] == hashes if len(frequent) else np.zeros(len(hashes), bool)
                term = np.where(often, terms[at], 0.0) if len(frequent) else np.zeros(len(hashes))
                missing = np.flatnonzero(~often[number])
                code, m = np.unique(np.searchsorted(ends, missing) * len(hashes) + number[missing], return_counts=True)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(code // max(len(hashes), 1), np.arange(n + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(hashes[code % max(len(hashes), 1)]), pa.array(m.astype(np.int64))], names=["hash", "m"]))
                tokens = hashes[number]
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(8 * np.append(starts, len(tokens))), pa.py_buffer(tokens)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(row, row + n)), pa.array(np.full(n, unit)), batch.column(0).slice(start, n), batch.column(1).slice(start, n), pa.array(ends - starts + 1),
                    pa.array(np.add.reduceat(often[number].astype(np.int64), starts)), pa.array(np.add.reduceat(term[number], starts)),
                    data.cast(pa.binary()), lists.cast(arrow.field("rare").type)], schema=arrow)
                row, size = row + n, size + 8 * len(tokens)
                if size >= UNIT:
                    unit, size = row, 0

    return docs.select("id", "held_out", "text").mapInArrow(tidy(run), schema)


def _tokens(column: pa.Array, units: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Bounds of groups of documents (of one unit, if units are given), their tokens in one array, and the places of their ends."""
    texts = column.to_pylist()
    edges = [0, *([] if units is None else (np.flatnonzero(np.diff(units)) + 1).tolist()), len(texts)]
    for first, last in zip(edges, edges[1:]):
        for start, stop in groups(texts[first:last], len, 4 * TOGETHER):
            chosen = texts[first + start : first + stop]
            lengths = np.array([len(t) // 8 for t in chosen])
            yield first + start, first + stop, np.frombuffer(b"".join(chosen), np.int64), np.cumsum(lengths) - 1


# --- the tree --------------------------------------------------------------------------------------------------------

def _marked(hashes: DataFrame, bits: int) -> np.ndarray:
    """A table of so many bits with those of the rows (q)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}  # no more than the table has
        for batch in batches:
            at = np.unique(batch.column(1).to_numpy() & (bits - 1))
            held, first = np.unique(at // LEAST_BITS, return_index=True)
            for p, ours in zip(held.tolist(), np.split(at % LEAST_BITS, first[1:])):
                pieces.setdefault(p, np.zeros(LEAST_BITS, bool))[ours] = True
        for p, data in pieces.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([p], pa.int32()), "data": pa.array([np.packbits(data).tobytes()], pa.binary())})

    out = np.zeros((bits // LEAST_BITS, LEAST_BITS // 8), np.uint8)
    # A piece of the table is made in one task, from nothing but the hashes that lie in it.
    place = F.shiftright(F.col("q").bitwiseAND(F.lit(bits - 1)), LEAST_BITS.bit_length() - 1)
    # One job brings all pieces, no more than the table has; an iterator would run one for each partition.
    pieces = hashes.select(place.alias("piece"), "q").repartition("piece").mapInArrow(tidy(run), "piece int, data binary").toArrow()
    for piece, data in zip(pieces.column("piece").to_pylist(), pieces.column("data")):
        out[piece] = np.frombuffer(data.as_buffer(), np.uint8)
    return out.ravel()


def _has(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & (8 * len(marks) - 1)
    return (marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _in_unit(hashes: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Hashes of phrases together with a unit."""
    return _longer(hashes, units)


def _likely(encoded: DataFrame, marks: Broadcast, level: int, least: int, bits: int) -> DataFrame:
    """(q, n, first) of the phrases of level + 1 words whose parts are marked and that occur ``least`` times.

    ``first`` is the hash of a phrase together with the first unit that holds it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, pairs = marks.value
        for batch in batches:
            units = batch.column(0).to_numpy()
            for start, _, tokens, ends in _tokens(batch.column(1), units):
                found = phrases(tokens, ends, level + 1)
                (q, inside), (shorter, _) = found[level], found[level - 1]
                at = np.flatnonzero(inside[1:]) + 1
                at = at[_has(contexts, shorter[at - 1])]
                at = at[_has(pairs, shorter[at])]
                hashes, n = np.unique(q[at].view(np.uint64), return_counts=True)
                used, data = hash_counts.buckets(bits, hashes, n)
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(np.full(len(used), units[start])), pa.array(data, pa.binary())], names=["bucket", "unit", "data"])

    def merge(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        parts = [(*hash_counts.unpack(data, 1), unit) for _, unit, data in rows]
        parts = [(hashes, n, np.full(len(n), unit)) for hashes, n, unit in parts]
        hashes, n, unit = hash_counts.distinct(*map(np.concatenate, zip(*parts)), by=(np.add, np.minimum))
        q, n, unit = hashes[n >= least].view(np.int64), n[n >= least], unit[n >= least]
        yield pa.RecordBatch.from_pydict({"q": q, "n": n, "first": _in_unit(q, unit)})

    rows = encoded.select("unit", "tokens").mapInArrow(tidy(run), "bucket int, unit long, data binary")
    return hash_counts.merged(rows, merge, "q long, n long, first long", "bucket")


def _count_phrases(encoded: DataFrame, marks: Broadcast, level: int, likely: DataFrame | None = None) -> DataFrame:
    """(q, context, shorter, n) of the phrases of level + 1 words that are marked.

    With ``likely`` they are marked with their first units, which tell their parts, and their counts are taken from there.
    """
    placed = likely is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column(0).to_numpy()
            for start, _, tokens, ends in _tokens(batch.column(1), units):
                found = phrases(tokens, ends, level + 1)
                (q, inside), (shorter, _) = found[level], found[level - 1]
                at = np.flatnonzero(inside[1:]) + 1
                at = at[_has(marks.value, _in_unit(q[at], units[start : start + 1]) if placed else q[at])]
                distinct, first, n = np.unique(q[at], return_index=True, return_counts=True)
                at = at[first]
                yield pa.RecordBatch.from_pydict({"q": distinct, "context": shorter[at - 1], "shorter": shorter[at], "n": n.astype(np.int64)})

    rows = encoded.select("unit", "tokens").mapInArrow(tidy(run), "q long, context long, shorter long, n long")
    if likely is None:
        return rows.groupBy("q", "context", "shorter").agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("long")
    rows = rows.withColumn("n", F.lit(0).cast("long")).unionByName(likely.select("q", none.alias("context"), none.alias("shorter"), "n"))
    return rows.groupBy("q").agg(F.max("context").alias("context"), F.max("shorter").alias("shorter"), F.sum("n").alias("n"))


def grow(encoded: DataFrame, known: Counts, depth: int = DEPTH, least_context: int = LEAST_CONTEXT, least_pair: int = LEAST_PAIR) -> DataFrame:
    """Weights (q, weight) of phrases, learned from the training rows (tokens): a phrase's part as a context and as a pair."""
    spark = encoded.sparkSession
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(known.tokens * BITS_PER_TOKEN).bit_length()))
    # Phrases of the level below with their count and log10 probability there: at first the words.
    tested = known.words.filter(F.col("n") >= least_pair).select(
        F.col("hash").alias("q"), "n", F.log10((F.col("n") + ADDED) / known.unit).alias("p"))
    packed_bits = hash_counts.bits_for(known.tokens)
    weights = []
    for level in range(1, depth + 1):
        marks = spark.sparkContext.broadcast((_marked(tested.filter(F.col("n") >= least_context).select("q"), bits), _marked(tested.select("q"), bits)))
        path = new_path(spark, "lm-likely")
        likely = written(_likely(encoded, marks, level, least_pair, packed_bits), "", "zstd", path)
        marks.unpersist()
        marks = spark.sparkContext.broadcast(_marked(likely.select(F.col("first").alias("q")), bits))
        pairs = _count_phrases(encoded, marks, level, likely).filter(F.col("n") >= least_pair)
        contexts = tested.filter((F.col("n") >= least_context) & (F.col("q") != word_hash(END))).select(F.col("q").alias("context"), F.col("n").alias("all"))
        below = tested.select(F.col("q").alias("shorter"), F.col("p").alias("low"))
        joined = pairs.join(contexts, "context").join(below, "shorter")
        own = F.log10((F.col("n") - DISCOUNT) / F.col("all"))
        far = F.abs(F.col("own") - F.col("low")) * np.log(10.0)
        diverges = (far >= float(np.log(RATIO))) & (F.col("n") * far >= GAIN)
        joined = written(joined.withColumn("own", own).withColumn("kept", diverges).drop("all", "shorter"), "lm-pairs")
        remove(spark, path)
        marks.unpersist()
        power = lambda c: F.pow(F.lit(10.0), F.col(c))
        rest = joined.filter("kept").groupBy("context").agg(F.sum(power("own")).alias("mass"), F.sum(power("low")).alias("below"))
        least = F.lit(1e-9)
        rest = rest.select("context", F.log10(F.greatest(1 - F.col("mass"), least) / F.greatest(1 - F.col("below"), least)).alias("rest"))
        rest = written(rest, "lm-contexts")
        with_rest = joined.join(rest, "context", "left").withColumn("rest", F.coalesce("rest", F.lit(0.0)))
        tested = written(with_rest.select("q", "n", F.when(F.col("kept"), F.col("own")).otherwise(F.col("rest") + F.col("low")).alias("p"),
                                          F.when(F.col("kept"), F.col("own") - F.col("low") - F.col("rest")).alias("more")), "lm-level")
        weights += [rest.select(F.col("context").alias("q"), F.col("rest").alias("weight")), tested.filter("more is not null").select("q", F.col("more").alias("weight"))]
        tested = tested.select("q", "n", "p")
    return reduce(DataFrame.unionByName, weights).groupBy("q").agg(F.sum("weight").alias("weight"))


def _begins(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """Where the sorted hashes with each value of their leading bits begin, and the number of the other bits."""
    bits = max(8, (2 * len(hashes)).bit_length())
    return np.concatenate([[0], np.cumsum(np.bincount((hashes >> (64 - bits)) + (1 << bits - 1), minlength=1 << bits))]).astype(np.int32), 64 - bits


def _find(hashes: np.ndarray, begins: np.ndarray, rest: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted are among the sorted hashes, and where; leading bits leave a hash or two to compare."""
    value = (wanted >> rest) + (1 << 63 - rest)
    place, end = begins[value], begins[value + 1]
    left, found, where = np.arange(len(wanted)), [], []
    on = place < end
    while on.any():
        left, place, end = left[on], place[on], end[on]
        hit = hashes[place] == wanted[left]
        found.append(left[hit])
        where.append(place[hit])
        place = place + 1
        on = ~hit & (place < end)
    return (np.concatenate(found), np.concatenate(where)) if found else (left[:0], place[:0])


def token_scores(hashes: np.ndarray, weights: np.ndarray, tokens: np.ndarray, ends: np.ndarray, depth: int = DEPTH, marks: np.ndarray | None = None, begins: tuple[np.ndarray, int] | None = None) -> np.ndarray:
    """What the given weights (in the order of their hashes) add to the unigram term of each token; marks spare searches."""
    out = np.zeros(len(tokens))
    if not len(hashes):
        return out
    begins, rest = begins or _begins(hashes)
    for q, inside in phrases(tokens, ends, depth + 1):
        at = np.flatnonzero(inside if marks is None else inside & _has(marks, q))
        found, place = _find(hashes, begins, rest, q[at])
        out[at[found]] += weights[place]
    return out


def _added(encoded: DataFrame, shared: Broadcast, depth: int) -> DataFrame:
    """(row, tree): what a slice of the weights adds to the score of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weights = shared.value
        bits = 1 << max(16, (8 * len(hashes)).bit_length())
        marks = np.zeros(bits, bool)
        marks[hashes & (bits - 1)] = True
        marks, begins = np.packbits(marks), _begins(hashes)
        for batch in batches:
            for start, stop, tokens, ends in _tokens(batch.column(1)):
                added = token_scores(hashes, weights, tokens, ends, depth, marks, begins)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(np.add.reduceat(added, np.concatenate([[0], ends[:-1] + 1])))],
                                                 names=["row", "tree"])

    return encoded.select("row", "tokens").mapInArrow(tidy(run), "row long, tree double")


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, least_context: int = LEAST_CONTEXT,
          least_pair: int = LEAST_PAIR, slice_size: int = SLICE) -> DataFrame:
    """Learn from the rows where ``train`` holds and score all: the columns of the contract."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), (~F.coalesce(train, F.lit(False))).alias("held_out"), whole(text_col).alias("text"))
    known = count_words(docs.filter(~F.col("held_out")).select("text"))
    encoded = written(_encoded(docs, known), "lm-tokens", "zstd")  # texts are read twice in all
    weights = written(grow(encoded.filter(~F.col("held_out")), known, depth, least_context, least_pair), "lm-weights")
    slices = -(-weights.count() // slice_size)
    sums: list[DataFrame] = []
    for k in range(slices):
        part = weights.filter(F.pmod(F.xxhash64("q"), F.lit(slices)) == k).toArrow()  # about slice_size entries
        hashes, values = part.column("q").to_numpy(), part.column("weight").to_numpy()
        order = np.argsort(hashes)
        shared = spark.sparkContext.broadcast((hashes[order], values[order]))
        sums.append(_added(encoded, shared, depth) if slices == 1 else written(_added(encoded, shared, depth), "lm-slice"))
    asked = encoded.select("row", F.explode("rare").alias("w")).select("row", "w.hash", "w.m")
    p = F.log10((F.coalesce("n", F.lit(0)) + ADDED) / F.lit(known.unit))
    found = asked.join(known.words, "hash", "left").groupBy("row").agg(
        F.sum(F.col("m") * p).alias("rare_p"), F.sum(F.when(F.col("n") > 0, F.col("m")).otherwise(0)).alias("rare_known"))
    rows = encoded.drop("tokens", "rare", "unit").join(found, "row", "left")
    if sums:
        rows = rows.join(reduce(DataFrame.unionByName, sums).groupBy("row").agg(F.sum("tree").alias("tree")), "row", "left")
    else:
        rows = rows.withColumn("tree", F.lit(0.0))
    base = F.col("base") + F.coalesce("rare_p", F.lit(0.0))
    return rows.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.coalesce("tree", F.lit(0.0))).alias("score"))


def op5_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; a tenth of them, by the CRC-32 of their ids, is held out of training."""
    return score(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0)

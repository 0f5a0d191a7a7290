"""Phrases that occur together, by dynamic itemset counting.

The texts become arrays of word hashes and are dealt into ``SHARDS`` shards, which are scanned one after another in
cycles. Words are counted from the first scan on. After every scan, what has reached the least count so far is marked; a
longer phrase is active as soon as its first and its last words (all but one each) are marked, and is counted from the
next scan on until each shard has been scanned with it active, so that lengths are interleaved and each phrase is
counted over one full cycle. Sums over scans go on for what has its share of the least count already; the rest is added
up once a cycle. The scans end with a cycle that has marked nothing new. Nearly all active phrases stay below the least
count, so the scans count hashes of phrases, in packed arrays; a last scan counts with their words the phrases whose
hashes have reached it, and what is truly below falls out there.

Marks are bits of a fixed-size table of phrase hashes, which is broadcast. Different phrases on one bit may make a phrase
active too early, never too late: an occurrence is counted in the first scan of its shard that finds its phrase active,
so no count holds an occurrence twice, a phrase whose parts truly have the least count is counted in full, and any other
stays below it. The size of the table follows the texts up to ``MOST_BITS``; a fuller table lets more phrases be
counted, with the same result.

In the last scan phrases are counted by the 64-bit hashes of their words. Should two words or two languages of the corpus have one hash,
which the table of words shows, all is done again with another seed, so that counts are exact.

Scores, subsumption and ranks are DataFrame operations on the phrases with the least count.

Nulls: a null text has no words, a null language is ``und``. Null ids play no role; repeated rows count as often as
they occur. A text of any length is read as a whole; a long one is stored in parts that overlap by a phrase. Ties of
cuts go to the shorter first part, ties of phrases to the lower bytes. An empty table, and a language without
candidates, give no rows. Further columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adinsight.llm import hash_counts
from adinsight.llm.common import binary, groups, new_path, remove, table, tidy, whole, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARDS = 3
#: Bits of the table of marks: at least, at most, and for each word.
LEAST_BITS, MOST_BITS, BITS_PER_WORD = 1 << 20, 1 << 29, 1
#: Bytes of text, and of hashes, that are worked on together, words that a task remembers to have told, rows that travel
#: together, and phrases that a task adds up before it tells them.
TEXT, TOGETHER, TOLD, ROWS, HELD = 2 << 20, 8 << 20, 200_000, 1 << 15, 1 << 19
#: Places of a stored part of a text.
PART = 1 << 14
#: Marks travel in pieces of this many bytes.
PIECE = 1 << 16
#: Parts of a language whose leaders are ranked on their own first.
SALTS = 16
#: The longest phrases that the columns hold.
LONGEST = 4
WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]
#: A phrase: its language and its words as hashes, 0 for none.
KEY = ["g", *WORDS]
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: A-Z in lower case, and every mark that ends a piece as a full stop.
_PIECES = bytes.maketrans(_UPPER + b",;:!?\n\x0b\x0c\r", _UPPER.lower() + b"." * 9)


# --- word hashes -----------------------------------------------------------------------------------------------------

def words_of(text: bytes) -> list[bytes]:
    """The words of a text, a full stop wherever a piece ends."""
    return text.translate(_PIECES).replace(b".", b" . ").split()


def word_hash(word: bytes, seed: int = 0) -> int:
    """A word as a signed 64-bit number other than 0, which stands for the end of a piece."""
    value = xxhash.xxh64_intdigest(word, seed) or 1
    return value - (1 << 64) if value >> 63 else value


def _dealt(docs: DataFrame, path: str, shards: int, longest: int, seed: int) -> None:
    """Write rows (shard, g, lang, starts, words, tokens) of the documents (lang, text), and in shard -1 rows (h, word).

    Phrases start at the first ``starts`` of the tokens, ``words`` of which are words; each row ends with a 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, told = TaskContext.get().partitionId(), set()
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), binary(batch.column(1))
            for start, stop in groups(texts, len, TEXT):
                words, ends = [], []
                for text in texts[start:stop]:
                    words += words_of(text)
                    words.append(b".")
                    ends.append(len(words))
                numbered = pa.array(words, pa.large_binary()).dictionary_encode()
                distinct = numbered.dictionary.to_pylist()
                hashes = [0 if w == b"." else word_hash(w, seed) for w in distinct]
                data = np.array(hashes, np.int64)[numbered.indices.to_numpy()]
                rows = []
                for lang, first, end in zip(langs[start:stop], [0, *ends], ends):
                    for at in range(first, end, PART):
                        upto = min(at + PART, end)
                        tokens = data[at : min(upto + longest - 1, end)].tobytes() + (b"" if upto == end else bytes(8))
                        rows.append((number % shards, word_hash(lang.encode(), seed), lang, upto - at, int(np.count_nonzero(data[at:upto])), tokens))
                        number += 1
                n = len(rows)
                yield pa.RecordBatch.from_arrays([
                    pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()])] + [
                    pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names=names)
                # a word is told once a task, or again after so many others
                new = [k for k, h in enumerate(hashes) if h and h not in told]
                if len(told) > TOLD:
                    told.clear()
                told.update(hashes)
                n = len(new)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, -1, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()),
                    pa.array([hashes[k] for k in new], pa.int64()), numbered.dictionary.take(pa.array(new, pa.int64())).cast(pa.binary()).cast(pa.string())], names=names)

    names = ["shard", "g", "lang", "starts", "words", "tokens", "h", "word"]
    rows = docs.mapInArrow(tidy(run), _DEALT)
    rows.write.partitionBy("shard").parquet(path, compression="zstd")


_DEALT = "shard int, g long, lang string, starts int, words long, tokens binary, h long, word string"


# --- marks and scans -------------------------------------------------------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _first(words: np.ndarray, lang: np.ndarray | int) -> np.ndarray:
    """Hashes of phrases of one word."""
    return _mixed(words.view(np.uint64) ^ np.asarray(lang, np.int64).view(np.uint64))


def _longer(phrases: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases and a next word."""
    return _mixed(phrases * np.uint64(3) + words.view(np.uint64))


class Marks:
    """Bits of phrase hashes."""

    def __init__(self, data: np.ndarray):
        self.data, self.mask = data, np.uint64(8 * len(data) - 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _distinct(tokens: np.ndarray, hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First places (as numbers of ``at``) and counts of the phrases of k words at the given places, which have these hashes.

    Should two phrases have one hash, each occurrence stands for itself.
    """
    order = np.argsort(hashes)
    new = np.concatenate([[True], np.diff(hashes[order]) != 0])
    first, place = np.flatnonzero(new), at[order]
    same = ~new[1:]
    if any((tokens[place[1:] + j] != tokens[place[:-1] + j])[same].any() for j in range(k)):
        return np.arange(len(at)), np.ones(len(at), np.int64)
    return order[first], np.diff(first, append=len(order))


def _phrases(tokens: np.ndarray, may_start: np.ndarray, lang: int, longest: int, now: Marks | None, before: Marks | None,
             single: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, places, their hashes) of the words, and of phrases that are active now and were not at the shard's last scan."""
    inside, shorter = tokens != 0, _first(tokens, lang)
    if single:
        at = np.flatnonzero(inside & may_start)
        yield 1, at, shorter[at]
    if now is None:
        return
    for k in range(2, longest + 1):
        on = now(shorter)
        was = before(shorter) if before is not None else None
        inside = inside[:-1] & tokens[k - 1 :].astype(bool)
        active = inside & on[:-1] & on[1:] & may_start[: len(inside)]
        if was is not None:
            active &= ~(was[:-1] & was[1:])
        shorter = _longer(shorter[:-1], tokens[k - 1 :])
        at = np.flatnonzero(active)
        if len(at):
            yield k, at, shorter[at]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Language, tokens and where phrases may start, for groups of rows (g, starts, tokens) of one language."""
    for batch in batches:
        langs = batch.column(0).to_numpy()
        starts, parts = batch.column(1).to_numpy(), batch.column(2).to_pylist()
        for lang in np.unique(langs):
            rows = np.flatnonzero(langs == lang).tolist()
            for first, last in groups(rows, lambda i: len(parts[i]), TOGETHER):
                chosen = rows[first:last]
                tokens = np.frombuffer(b"".join([parts[i] for i in chosen]), np.int64)
                lengths = np.array([len(parts[i]) // 8 for i in chosen])
                place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                yield int(lang), tokens, place < np.repeat(starts[chosen], lengths)


def _turned(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Hashes whose leading bits name their place in a table of so many marks, so that a bucket's marks stand together."""
    low = bits.bit_length() - 1
    return (hashes << np.uint64(64 - low)) | (hashes >> np.uint64(low))


#: Packed counts of the phrases of k words: all sums so far, and those of one scan.
_PACKED = "k int, bucket int, data binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int32(), pa.binary()])], names=["k", "bucket", "data"])


def _scan(shard: DataFrame, longest: int, now: Broadcast | None, before: Broadcast | None, single: bool, bits: int, size: int) -> DataFrame:
    """Packed rows of what this scan counts in the rows (g, starts, tokens), for marks of ``size`` bytes; not yet summed over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, earlier = now and Marks(now.value), before and Marks(before.value)
        for lang, tokens, may_start in _texts(batches):
            for k, _, hashes in _phrases(tokens, may_start, lang, longest, marks, earlier, single):
                hashes, n = np.unique(_turned(hashes, 8 * size), return_counts=True)
                if len(hashes):
                    yield _batch([(k, *x) for x in zip(*hash_counts.buckets(bits, hashes, n, n))])

    return shard.select("g", "starts", "tokens").mapInArrow(tidy(run), _PACKED)


def _summed(found: DataFrame, likely: DataFrame | None, longest: int, least: int, shards: int) -> DataFrame:
    """Packed rows (sums so far, counts of this scan): ``found``, with the sums of ``likely`` that are on their way to the least count."""

    def merge(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        parts = []
        for k, _, data, old in rows:
            hashes, n, here = hash_counts.unpack(data, 2)
            if old:
                on = (n < least) & (n >= -(-least // shards)) if k < longest else np.zeros(len(n), bool)
                hashes, n, here = hashes[on], n[on], np.zeros(on.sum(), np.int64)
            parts.append((hashes, n, here))
        hashes, n, here = hash_counts.distinct(*map(np.concatenate, zip(*parts)))
        if len(hashes):
            yield _batch([(*rows[0][:2], hash_counts.pack(hashes, n, here))])

    rows = found.withColumn("old", F.lit(False))
    if likely is not None:
        rows = rows.unionByName(likely.withColumn("old", F.lit(True)))
    return hash_counts.merged(rows, merge, _PACKED, "k", "bucket")


def _totals(counts: list[DataFrame], before: DataFrame | None, cycle: int, least: int) -> DataFrame:
    """Packed rows (sum, first cycle) of a cycle's scans and of the totals before.

    What came up before this cycle and has stayed below the least count is counted in full and left out.
    """

    def merge(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        parts = []
        for _, _, data, old in rows:
            hashes, n, other = hash_counts.unpack(data, 2)
            on = (n >= least) | (other >= cycle - 1) if old else other > 0
            hashes, n, other = hashes[on], n[on], other[on]
            parts.append((hashes, n, other) if old else (hashes, other, np.full(len(hashes), cycle)))
        hashes, n, first = hash_counts.distinct(*map(np.concatenate, zip(*parts)), by=(np.add, np.minimum))
        if len(hashes):
            yield _batch([(*rows[0][:2], hash_counts.pack(hashes, n, first))])

    rows = reduce(DataFrame.unionByName, counts).withColumn("old", F.lit(False))
    if before is not None:
        rows = rows.unionByName(before.withColumn("old", F.lit(True)))
    return hash_counts.merged(rows, merge, _PACKED, "k", "bucket")


def _marked(packed: DataFrame, least: int, data: np.ndarray) -> np.ndarray:
    """The marks with those of the packed rows that have the least count; their size is fixed."""
    bits = 8 * len(data)

    def pieces_of(pieces: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for p, held in pieces.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([p], pa.int32()), "bits": pa.array([held.tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}  # no more than the table has
        for batch in batches:
            reached = []
            for packed in batch.column(0).to_pylist():
                hashes, n, _ = hash_counts.unpack(packed, 2)
                reached.append(hashes[n >= least])
            at = (np.concatenate(reached) >> np.uint64(65 - bits.bit_length())).astype(np.int64) if reached else np.zeros(0, np.int64)
            at.sort()
            piece = at // (8 * PIECE)
            held, first = np.unique(piece, return_index=True)
            for p, ours in zip(held.tolist(), np.split(at, first[1:])):
                np.bitwise_or.at(pieces.setdefault(p, np.zeros(PIECE, np.uint8)), (ours >> 3) % PIECE, (1 << (ours & 7)).astype(np.uint8))
        yield from pieces_of(pieces)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            for p, more in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = np.frombuffer(more, np.uint8)
                pieces[p] = pieces[p] | more if p in pieces else more
        yield from pieces_of(pieces)

    out = data.copy()
    parts = packed.select("data").mapInArrow(run, "piece int, bits binary").repartition(2, "piece")
    # One job brings all pieces, no more than the table has; an iterator would run one for each partition.
    pieces = parts.mapInArrow(merge, "piece int, bits binary").toArrow()
    for piece, held in zip(pieces.column("piece").to_pylist(), pieces.column("bits")):
        out[piece * PIECE : (piece + 1) * PIECE] |= np.frombuffer(held.as_buffer(), np.uint8)
    return data if np.array_equal(out, data) else out


def _counted(texts: DataFrame, longest: int, marks: Broadcast, least: int) -> DataFrame:
    """Rows (key, a) of the marked phrases of the rows (g, starts, tokens) that occur ``least`` times, told with their words."""

    def told(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (key, n) with sums of equal keys; should two phrases have one hash, as they are."""
        order = np.argsort(hashes, kind="stable")
        hashes, rows = hashes[order], rows[order]
        new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        first = np.flatnonzero(new)
        if (rows[first[np.cumsum(new) - 1], :-1] != rows[:, :-1]).any():
            return hashes, rows
        n = np.add.reduceat(rows[:, -1], first)
        return hashes[first], np.column_stack([rows[first, :-1], n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, held, size = Marks(marks.value), [], 0

        def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(rows), ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows[at : at + ROWS].T], names=[*KEY, "a"])

        for lang, tokens, may_start in _texts(batches):
            for k, at, hashes in _phrases(tokens, may_start, lang, longest, wanted, None, True):
                on = wanted(hashes)
                at, hashes = at[on], hashes[on]
                if not len(at):
                    continue
                chosen, n = _distinct(tokens, hashes, at, k)
                rows = np.zeros((len(chosen), len(KEY) + 1), np.int64)
                rows[:, 0], rows[:, -1] = lang, n
                for j in range(k):
                    rows[:, 1 + j] = tokens[at[chosen] + j]
                held.append((hashes[chosen], rows))
                size += len(rows)
                if size > HELD:
                    held = [told(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][1])
                    if size > HELD // 2:
                        yield from out(held[0][1])
                        held, size = [], 0
        if held:
            yield from out(told(*map(np.concatenate, zip(*held)))[1])

    rows = texts.select("g", "starts", "tokens").mapInArrow(tidy(run), ", ".join(f"{c} long" for c in [*KEY, "a"]))
    # A task has added up what it tells, so rows move by key before they are added: sums within tasks would find little.
    return rows.repartition(*KEY).groupBy(*KEY).agg(F.sum("a").alias("a")).filter(F.col("a") >= least)


class Counted:
    """Tables of :func:`counted`: phrases (key, a), texts of the words (h, word) and languages (g, lang, n)."""

    def __init__(self, phrases: DataFrame, words: DataFrame, languages: DataFrame):
        self.phrases, self.words, self.languages = phrases, words, languages


def counted(docs: DataFrame, least: int = 30, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text", shards: int = SHARDS) -> Counted:
    """All phrases of up to ``longest`` words that occur ``least`` times."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), whole(text_col).alias("text"))
    for seed in count():
        dealt = new_path(spark, "phrase-shards")
        _dealt(rows, dealt, shards, longest, seed)
        every = spark.read.schema(_DEALT).parquet(dealt)
        words = every.filter("shard = -1").groupBy("h").agg(F.min("word").alias("word"), F.max("word").alias("other"))
        words = written(words, "phrase-words", "zstd")
        texts = every.filter("shard >= 0")
        languages = texts.groupBy("g").agg(F.min("lang").alias("lang"), F.max("lang").alias("other"), F.sum("words").alias("n")).collect()
        if words.filter("word <> other").isEmpty() and all(x.lang == x.other for x in languages):
            break
        remove(spark, dealt)
    size = sum(x.n for x in languages)  # a row a language
    bits = hash_counts.bits_for(size)
    size = min(MOST_BITS, max(LEAST_BITS, 1 << int(size * BITS_PER_WORD).bit_length())) // 8
    # The marks before each scan of the last cycle, oldest first, as arrays and as broadcasts of a fixed size.
    marks: list[tuple[np.ndarray, Broadcast | None]] = [(np.zeros(size, np.uint8), None)]
    likely, totals, scan = None, None, 0
    while scan == 0 or scan % shards or marks[0][0] is not marks[-1][0]:
        cycle = scan // shards
        if scan % shards == 0:
            counts: list[DataFrame] = []
            paths: list[str] = []
        data, now = marks[-1]
        before = marks[0][1] if len(marks) > shards else None
        new = data
        if cycle == 0 or marks[0][0] is not data:  # otherwise the last scan of this shard found the same
            found = _scan(texts.filter(F.col("shard") == scan % shards), longest, now, before, cycle == 0, bits, size)
            paths.append(new_path(spark, "phrase-counts"))
            # Sums go on with what is on its way to the least count; the others are added up at the end of the cycle.
            likely = written(_summed(found, likely, longest, least, shards), "", "zstd", paths[-1])
            counts.append(likely)
            new = _marked(likely.filter(F.col("k") < longest), least, data)
        if scan % shards == shards - 1 and counts:
            old_totals, totals_path = totals_path if totals is not None else None, new_path(spark, "phrase-totals")
            totals = written(_totals(counts, totals, cycle, least), "", "zstd", totals_path)
            new = _marked(totals.filter(F.col("k") < longest), least, new)
            likely = None  # these sums are in the totals; a new cycle begins its own
            for path in [*paths, *([old_totals] if old_totals else [])]:
                remove(spark, path)
        marks.append((data, now) if new is data else (new, spark.sparkContext.broadcast(new)))
        if len(marks) > shards + 1:
            (_, old), *marks = marks
            if old is not None and all(old is not b for _, b in marks):
                old.unpersist()
        scan += 1
    reached = spark.sparkContext.broadcast(_marked(totals, least, np.zeros(size, np.uint8)))
    remove(spark, totals_path)
    phrases = written(_counted(texts, longest, reached, least), "phrases", "zstd")
    reached.unpersist()
    remove(spark, dealt)
    names = spark.createDataFrame([(x.g, x.lang, x.n) for x in languages if x.n], "g long, lang string, n long")
    return Counted(phrases, words.drop("other"), names)


# --- scores ----------------------------------------------------------------------------------------------------------

def _size() -> Column:
    """Words of a phrase."""
    return sum(((F.col(w) != 0).cast("int") for w in WORDS[1:]), F.lit(1))


def _part(first: int, size: int) -> list[Column]:
    """The columns of the part of ``size`` words from word number ``first`` (from 0)."""
    return [F.col(WORDS[first + j]) if j < size and first + j < LONGEST else F.lit(0).cast("long") for j in range(LONGEST)]


def _struct(words: list[Column]) -> Column:
    return F.struct(*[c.alias(w) for w, c in zip(WORDS, words)])


def _parts(rows: DataFrame, longest: int) -> DataFrame:
    """Rows of ``rows`` with every part of two words or more that is shorter than the phrase, as ``p``."""
    places = [(k, first) for k in range(2, longest) for first in range(longest - k + 1)]
    every = [F.struct(F.lit(k).alias("k"), F.lit(first).alias("first"), _struct(_part(first, k)).alias("p")) for k, first in places]
    if not every:
        return rows.limit(0).withColumn("p", _struct(_part(0, 1)))
    spread = rows.withColumn("size", _size()).withColumn("x", F.explode(F.array(*every)))
    return spread.filter((F.col("x.k") < F.col("size")) & (F.col("x.k") + F.col("x.first") <= F.col("size"))).withColumn("p", F.col("x.p"))


def _best_cut(phrases: DataFrame, candidates: DataFrame, longest: int) -> DataFrame:
    """``candidates`` with score, l and r of their lowest-scoring cut."""
    size = F.col("size")
    cuts = [F.struct(F.lit(k).alias("k"), _struct(_part(0, k)).alias("left"),
                     reduce(lambda other, s: F.when(size == s, _struct(_part(k, s - k))).otherwise(other), range(k + 1, longest + 1), _struct(_part(k, 1))).alias("right"))
            for k in range(1, longest)]
    spread = candidates.withColumn("size", _size()).withColumn("c", F.explode(F.array(*cuts))).filter(F.col("c.k") < size)
    spread = spread.select(*KEY, "a", "c.*", F.pmod(F.xxhash64(*KEY), F.lit(SALTS)).cast("int").alias("salt"))
    # A word may be a part of very many phrases: its count is repeated for each salt. Longer parts take no salt.
    salts = F.when(F.col("w2") != 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    for side, name in (("left", "l"), ("right", "r")):
        at = F.when(F.col(f"{side}.w2") != 0, -1).otherwise(F.col("salt"))
        spread = spread.withColumns({"at": at} | {f"p{k}": F.col(f"{side}.{w}") for k, w in enumerate(WORDS)})
        part = phrases.select("g", *[F.col(w).alias(f"p{k}") for k, w in enumerate(WORDS)], F.col("a").alias(name), F.explode(salts).alias("at"))
        spread = spread.join(part, ["g", "at", *[f"p{k}" for k in range(LONGEST)]])
    wide = "decimal(38,0)"
    score = F.expr(f"cast(2000000 * cast(a as decimal(20,0)) as {wide}) div cast(cast(l as decimal(20,0)) + r as {wide})")
    return spread.groupBy(*KEY, "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")).select(*KEY, "a", "c.score", "c.l", "c.r")


def collocations(docs: DataFrame, least: int = 30, longest: int = LONGEST, top: int = 2000, cover: tuple[int, int] = (80, 100), lang_col: str = "lang",
                 text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """The leading phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase is out if a longer candidate that holds it has ``cover`` (a ratio) of its occurrences or more.
    """
    found = counted(docs, least, longest, lang_col, text_col, shards)
    candidates = found.phrases.filter("w2 <> 0")
    held = _parts(candidates, longest).select("g", *[F.col(f"p.{w}").alias(w) for w in WORDS], F.col("a").alias("longer"))
    held = held.groupBy(*KEY).agg(F.max("longer").alias("longer"))
    num, den = cover
    free = candidates.join(held, KEY, "left").filter(F.col("longer").isNull() | (den * F.col("longer") < num * F.col("a"))).drop("longer")
    scored = _best_cut(found.phrases, free, longest).withColumn("salt", F.pmod(F.xxhash64(*KEY), F.lit(SALTS)))
    # Those that may lead, with all ties of the last place, get their texts; then the texts decide.
    measure = [F.desc("score"), F.desc("a")]
    near = scored.withColumn("place", F.rank().over(Window.partitionBy("g", "salt").orderBy(*measure))).filter(F.col("place") <= top)
    spread = near.select("*", F.posexplode(F.array(*WORDS)).alias("i", "h")).filter("h <> 0").join(found.words, "h")
    texts = spread.groupBy("g", "salt", *WORDS, "a", "l", "r", "score").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("words"))
    texts = texts.select("g", "salt", F.array_join("words.word", " ").alias("phrase"), "a", "l", "r", "score")
    order = [*measure, F.asc("phrase")]
    leaders = texts.withColumn("rank", F.row_number().over(Window.partitionBy("g", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    leaders = leaders.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).filter(F.col("rank") <= top)
    return leaders.join(found.languages, "g").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_dynamic_itemset_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 leading collocations of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
with words as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w
  from (select coalesce(lang, 'und') as lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) as piece
        from documents)),
grams as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
          from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, range(1, 5) as ks(k))),
counts as (select lang, k, phrase, count(*) as a from grams group by all),
totals as (select lang, sum(a)::bigint as n from counts where k = 1 group by all),
candidates as (select lang, k, phrase, a, string_split(phrase, ' ') as w from counts where k > 1 and a >= 30),
cuts as (select lang, phrase, a, cut, array_to_string(w[1:cut], ' ') as first, array_to_string(w[cut + 1:], ' ') as rest
         from (select *, unnest(range(1, k)) as cut from candidates)),
scored as (select c.lang, c.phrase, c.a, cut, x.a as l, y.a as r, (2000000::hugeint * c.a // (x.a + y.a))::bigint as score
           from cuts c join counts x on x.lang = c.lang and x.phrase = c.first join counts y on y.lang = c.lang and y.phrase = c.rest),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inner_ones as (select lang, a, array_to_string(w[i:i + m - 1], ' ') as phrase
               from (select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from candidates))),
held as (select lang, phrase, max(a) as longer from inner_ones group by all),
ranked as (select o.*, row_number() over (partition by o.lang order by score desc, a desc, o.phrase) as rank
           from lowest o left join held h on h.lang = o.lang and h.phrase = o.phrase where longer is null or 100 * longer < 80 * a)
select lang, rank::bigint as rank, phrase, a, l, r, n, score from ranked join totals using (lang) where rank <= 2000
"""

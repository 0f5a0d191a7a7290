"""Similarity self-join on word n-gram sets with signature trees, and the components of its links.

1. Every text becomes its set of hashed n-grams; texts with equal sets form one class, so copies never meet in pairs.
   The same pass counts n-grams in a fixed table of hashed counters.
2. A set that must overlap others by a share of its size has to share one of its first few n-grams in any common
   order with them. The order here is by counter, then hash, so that frequent n-grams come last. Similar sets are of
   similar size, so a set meets others in the band of its size (and in the next one, if larger similar sets may lie
   there): classes that share such an n-gram in one band are put in one block, named by the smallest of them.
3. In each block the sets become the leaves of a signature tree: every node holds the OR of the token bitmaps and the
   range of sizes below it. A dual traversal from (root, root) drops each pair of nodes whose largest possible
   overlap is below the smallest one that a link needs. It runs twice: over the bitmaps of the first pass alone, which
   leaves the sets that may have a partner at all, and then over those with their texts. Pairs of leaves that stay are
   checked on the exact sets, unless they are connected already; a block returns a spanning forest of its links.
4. Blocks beyond ``BLOCK_SETS`` sets or ``BLOCK_BYTES`` bytes are dealt over tasks for all pairs of their parts, so
   no task holds more than two parts and no pair of sets is left out.
5. Links of all blocks are merged to components with large-star and small-star rounds.

Result: one row per input row with the size of its set and the smallest id of its component.

Nulls: a null text, or one without words, has an empty set, is linked with nothing and has its own id as component.
Null ids take part and never are the smallest unless all are null. Rows with the same id are documents of their own.
An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adinsight.llm.common import WORD, Generations, binary, groups, new_path, packed, remove, table, tidy, unpacked, worker_cache, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Hashed n-gram counters, 8 bytes each, sent to every worker: at least, at most, and bytes of input for each.
LEAST_COUNTERS, MOST_COUNTERS, BYTES_PER_COUNTER = 1 << 16, 1 << 22, 256
_COUNTER_BLOCK = 1 << 16
#: Size ratios between similar sets that a band is wide.
BAND = 2
#: Bytes of each generation of a task's memos, and of text that is worked on together.
MEMO, TOGETHER = 24 << 20, 4 << 20
#: Parts of the rows of one class when they get its name.
SALTS = 16
BLOCK_SETS = 4096
BLOCK_BYTES = 32 << 20
#: Children of a tree node, and node pairs looked at together.
FAN_OUT = 8
PAIRS_AT_ONCE = 1 << 17


# --- sets ----------------------------------------------------------------------------------------------------------

class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams, A-Z in lower case."""

    def __init__(self, n: int):
        import xxhash

        self.n = n
        self.words = Generations(xxhash.xxh64_intdigest, MEMO)

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # both on ASCII only, as bytes
        w = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        if not len(w):
            return w
        n = min(self.n, len(w))
        h = w[: len(w) - n + 1] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(1, n):
            h ^= h >> np.uint64(32)
            h = (h + w[k : len(w) - n + 1 + k]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h = (h + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return np.unique(h)


def _class(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _short(cls: bytes) -> int:
    """A class as a signed 64-bit number, for grouping candidates only."""
    return int.from_bytes(cls[:8], "little", signed=True)


def width_of(size: int) -> int:
    """Bits of a set's bitmap: a power of two, twice its size or more."""
    return min(1 << 16, max(512, 1 << (2 * size - 1).bit_length()))


def bitmap(shingles: np.ndarray, width: int) -> np.ndarray:
    """A bit for each n-gram; the first half OR the second one is the bitmap of half the width."""
    flags = np.zeros(width, bool)
    flags[(shingles >> np.uint64(40)).astype(np.int64) & (width - 1)] = True
    return np.packbits(flags)


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    while len(bits) * 8 > width:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def _shingler(n: int) -> Shingler:
    return worker_cache("shingler", lambda: Shingler(n), n)


def counters_for(docs: DataFrame) -> int:
    """How many counters the input calls for, by Spark's estimate of its size."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << (size // BYTES_PER_COUNTER).bit_length()))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The columns of batches, some of their rows at a time; the last column as bytes."""
    for batch in batches:
        *others, texts = batch.columns
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for start, stop in groups(lengths, int, TOGETHER):
            yield *(c.slice(start, stop - start) for c in others), binary(texts.slice(start, stop - start))


def _first_pass(docs: DataFrame, n: int, counters: int) -> DataFrame:
    """Rows (id, thash, cls, c, n, low, bits) of documents and rows (block, counts) of hashed counters.

    A task's counts stop at 65,535: the order of the n-grams asks no more.
    """
    schema = T.StructType([
        T.StructField("id", docs.schema["id"].dataType), T.StructField("thash", T.LongType()), T.StructField("cls", T.BinaryType()),
        T.StructField("c", T.LongType()), T.StructField("n", T.LongType()), T.StructField("low", T.LongType()),
        T.StructField("bits", T.BinaryType()), T.StructField("block", T.IntegerType()), T.StructField("counts", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, shingle = to_arrow_schema(schema), _shingler(n)
        counts = np.zeros(counters, np.int64)
        for ids, hashes, texts in _grouped(batches):
            classes, sizes, lows, maps = [], [], [], []
            for text in texts:
                s = shingle(text)
                np.add.at(counts, (s & np.uint64(counters - 1)).astype(np.int64), 1)
                classes.append(_class(s) if len(s) else None)
                sizes.append(len(s))
                lows.append(int(s[:1].view(np.int64)[0]) if len(s) else None)
                maps.append(bitmap(s, width_of(len(s))).tobytes() if len(s) else None)
            size = len(texts)
            yield pa.RecordBatch.from_arrays(
                [ids, hashes, pa.array(classes, pa.binary()),
                 pa.array([c and _short(c) for c in classes], pa.int64()), pa.array(sizes, pa.int64()),
                 pa.array(lows, pa.int64()), pa.array(maps, pa.binary()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], schema=arrow)
        used = np.flatnonzero(counts.reshape(-1, _COUNTER_BLOCK).any(1))
        for b in used:
            data = np.minimum(counts[b * _COUNTER_BLOCK : (b + 1) * _COUNTER_BLOCK], 65535).astype("<u2").tobytes()
            yield pa.RecordBatch.from_pylist([{"block": int(b), "counts": data}], schema=arrow)

    return docs.select("id", "thash", "text").mapInArrow(tidy(run, "shingler"), schema)


def _counters(first: DataFrame, counters: int) -> np.ndarray:
    """All counters, summed over tasks block by block; their number is fixed."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # no more than there are blocks
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                more = np.frombuffer(data, "<u2").astype(np.int64)
                sums[block] = sums[block] + more if block in sums else more
        for block, values in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": pa.array([values.tobytes()], pa.binary())})

    rows = first.filter("block is not null").select("block", "counts").repartition(min(8, counters // _COUNTER_BLOCK), "block")
    out = np.zeros(counters, np.int64)
    for row in rows.mapInArrow(add, "block int, counts binary").collect():
        out[row.block * _COUNTER_BLOCK : (row.block + 1) * _COUNTER_BLOCK] = np.frombuffer(row.counts, "<i8")
    return out


def prefix_size(size: int, num: int, den: int) -> int:
    """N-grams of which one must be shared by any set similar to one of this size."""
    return size - -(-size * num // den) + 1


def bands(size: int, num: int, den: int) -> list[int]:
    """The bands of sizes in which a set looks for others: its own, and the next one if larger similar sets lie there.

    Of two similar sets the smaller one looks in the other's own band. A band is a little wider than ``BAND`` ratios, so
    that rounding loses no pair.
    """
    place = math.log(size) / (math.log(den / num) * (1 + 1e-9)) / BAND
    return [int(place), int(place) + 1] if place % 1 >= 1 - 1 / BAND - 1e-6 else [int(place)]


def _prefixes(docs: DataFrame, counters: np.ndarray, n: int, num: int, den: int) -> DataFrame:
    """Rows (key, band, c): the first n-grams of each set in the common order, in the bands of its size."""
    shared = docs.sparkSession.sparkContext.broadcast(counters)  # at most MOST_COUNTERS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, counts = _shingler(n), shared.value
        told = Generations(lambda _: False, MEMO)  # classes of this task: copies add nothing
        for (texts,) in _grouped(batches):
            keys, places, classes = [], [], []
            for text in texts:
                s = shingle(text)
                c = _short(_class(s))
                if not len(s) or told[c]:
                    continue
                told.put(c, True)
                order = np.lexsort((s, counts[(s & np.uint64(len(counts) - 1)).astype(np.int64)]))
                first = s[order[: prefix_size(len(s), num, den)]]
                for band in bands(len(s), num, den):
                    keys.append(first.view(np.int64))
                    places.append(np.full(len(first), band, np.int32))
                    classes.append(np.full(len(first), c, np.int64))
            if keys:
                yield pa.RecordBatch.from_pydict({"key": np.concatenate(keys), "band": np.concatenate(places), "c": np.concatenate(classes)})

    return docs.select("text").mapInArrow(tidy(run, "shingler"), "key long, band int, c long")


# --- signature trees -----------------------------------------------------------------------------------------------

class SignatureTree:
    """Bitmaps under nodes of OR-combined bitmaps and size ranges; leaves stand in the order ``order``."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, lows: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        # Alike sets stand side by side: by size class, then by their smallest hash.
        self.order = np.lexsort((lows, (np.log(sizes) / np.log(den / num) / 2).astype(int)))
        bits, sizes = np.ascontiguousarray(bits[self.order]).view(np.uint64), sizes[self.order]
        hidden = sizes - np.bitwise_count(bits).sum(1, dtype=np.int64)  # tokens that share a bit with another of their set
        self.levels = [(bits, sizes, sizes, hidden)]
        while len(self.levels[-1][0]) > FAN_OUT:
            bits, low, high, hidden = self.levels[-1]
            cuts = np.arange(0, len(bits), FAN_OUT)
            self.levels.append((np.bitwise_or.reduceat(bits, cuts), np.minimum.reduceat(low, cuts),
                                np.maximum.reduceat(high, cuts), np.maximum.reduceat(hidden, cuts)))

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Node pairs that may hold a link: largest possible overlap against the smallest one needed."""
        bits, low, high, hidden = self.levels[level]
        num, den = self.num, self.den
        ok = (den * high[a] >= num * low[b]) & (den * high[b] >= num * low[a])
        a, b = a[ok], b[ok]
        common = np.zeros(len(a), np.int64)
        for start in range(0, len(a), 1 << 14):
            part = slice(start, start + (1 << 14))
            common[part] = np.bitwise_count(bits[a[part]] & bits[b[part]]).sum(1)
        most = np.minimum(common + np.minimum(hidden[a], hidden[b]), np.minimum(high[a], high[b]))
        # |x and y| / |x or y| >= num / den  <=>  (num + den) * |x and y| >= num * (|x| + |y|)
        ok[ok] = (num + den) * most >= num * (low[a] + low[b])
        return ok

    def pairs(self, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves that may be similar, of those that are still wanted, some thousand at a time."""
        top = len(self.levels) - 1
        stack = [(top, *np.triu_indices(len(self.levels[top][0])))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > PAIRS_AT_ONCE:
                half = len(a) // 2
                stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            if level == 0:
                ok = a < b
                ok[ok] = wanted(a[ok], b[ok])
                a, b = a[ok], b[ok]
            ok = self._possible(level, a, b)
            a, b = a[ok], b[ok]
            if level == 0:
                for start in range(0, len(a), 4096):  # what is found so far spares later pairs
                    x, y = a[start : start + 4096], b[start : start + 4096]
                    ok = wanted(x, y)
                    if ok.any():
                        yield x[ok], y[ok]
            elif len(a):
                below, kids = len(self.levels[level - 1][0]), np.arange(FAN_OUT)
                x = (a[:, None, None] * FAN_OUT + kids[:, None]).repeat(FAN_OUT, 2).ravel()
                y = (b[:, None, None] * FAN_OUT + kids[None, :]).repeat(FAN_OUT, 1).ravel()
                ok = (x < below) & (y < below) & (x <= y)
                stack.append((level - 1, x[ok], y[ok]))


def may_have_partner(bits: list[bytes], sizes: np.ndarray, lows: np.ndarray, num: int, den: int, side: np.ndarray | None = None) -> np.ndarray:
    """Which sets have a possible partner (on another side, where sides are given), by their bitmaps alone."""
    marked = np.zeros(len(bits), bool)
    widths = np.array([len(b) * 8 for b in bits])
    for width in np.unique(widths):
        longest = sizes[widths == width].max()
        # a set of twice the width is folded if it can be similar to one of this width
        chosen = np.flatnonzero((widths == width) | (widths > width) & (num * sizes <= den * longest))
        if len(chosen) < 2:
            continue
        rows = np.stack([folded(np.frombuffer(bits[i], np.uint8), width) for i in chosen])
        tree = SignatureTree(rows, sizes[chosen], lows[chosen], num, den)
        place = chosen[tree.order]

        def wanted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            ok = ~(marked[place[a]] & marked[place[b]])
            return ok if side is None else ok & (side[place[a]] != side[place[b]])

        for a, b in tree.pairs(wanted):
            marked[place[a]] = marked[place[b]] = True
    return marked


class Exact:
    """Overlaps of sets that stand together, by bitmaps over the tokens that two of them share."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = counts > 1
        kept = shared[inverse]
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[kept]
        column = (np.cumsum(shared) - 1)[inverse[kept]]
        words = -(-int(shared.sum()) // 64) or 1
        self.bits = None
        if len(sets) * words * 8 <= 128 << 20:
            self.bits = np.zeros((len(sets), words), np.uint64)
            np.bitwise_or.at(self.bits, (owner, column // 64), np.uint64(1) << (column % 64).astype(np.uint64))

    def overlap(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
        step = max(1, (1 << 20) // self.bits.shape[1])
        return np.concatenate([np.bitwise_count(self.bits[a[s : s + step]] & self.bits[b[s : s + step]]).sum(1, dtype=np.int64)
                               for s in range(0, len(a), step)])


def forest(sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of all links; with ``side``, of the links between different sides."""
    sizes = np.array([len(s) for s in sets], np.int64)
    width = min(1 << 14, width_of(4 * int(np.median(sizes))))
    tree = SignatureTree(np.stack([bitmap(s, width) for s in sets]), sizes, np.array([int(s[0]) for s in sets], np.uint64), num, den)
    exact, group, place = Exact(sets), np.arange(len(sets)), tree.order
    edges: list[tuple[int, int]] = []

    def wanted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = group[place[a]] != group[place[b]]
        return ok if side is None else ok & (side[place[a]] != side[place[b]])

    for a, b in tree.pairs(wanted):
        i, j = place[a], place[b]
        linked = (num + den) * exact.overlap(i, j) >= num * (sizes[i] + sizes[j])
        for x, y in zip(i[linked], j[linked]):
            if group[x] != group[y]:
                edges.append((int(x), int(y)))
                group[group == group[y]] = group[x]
    return edges


# --- the join ------------------------------------------------------------------------------------------------------

def _block_links(members: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between classes from rows (label, left, right, part, cls, text) that come sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = _shingler(n)
        block, classes, sets, parts = None, [], [], []

        def links():
            if len(sets) < 2:
                return None
            side = None if block[1] == block[2] else np.array(parts)
            found = forest(sets, num, den, side)
            if not found:
                return None
            return pa.RecordBatch.from_pydict({"a": pa.array([max(classes[i], classes[j]) for i, j in found], pa.binary()),
                                               "b": pa.array([min(classes[i], classes[j]) for i, j in found], pa.binary())})

        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(5)), binary(batch.column(5)))
            for label, left, right, part, cls, text in rows:
                if (label, left, right) != block:
                    if out := links():
                        yield out
                    block, classes, sets, parts = (label, left, right), [], [], []
                if classes and classes[-1] == cls:
                    continue  # the same row twice
                s = shingle(text)
                if _class(s) == cls:
                    classes.append(cls)
                    sets.append(s)
                    parts.append(part)
        if out := links():
            yield out

    return members.mapInArrow(tidy(run, "shingler"), "a binary, b binary")


def _with_partners(members: DataFrame, num: int, den: int) -> DataFrame:
    """Of rows (label, left, right, part, cls, of, hash, size, low, bits), sorted by block, those that may have a partner."""
    schema = T.StructType(members.schema[:7])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        block, rows = None, []

        def found():
            if len(rows) < 2:
                return None
            side = None if block[1] == block[2] else np.array([r[3] for r in rows])
            ok = may_have_partner([r[9] for r in rows], np.array([r[7] for r in rows], np.int64), np.array([r[8] for r in rows], np.int64), num, den, side)
            kept = [rows[i] for i in np.flatnonzero(ok)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept), arrow)], schema=arrow) if kept else None

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:3] != block:
                    if out := found():
                        yield out
                    block, rows = row[:3], []
                rows.append(row)
        if out := found():
            yield out

    return members.mapInArrow(tidy(run), schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) with a > b; root is the smallest node that can be reached."""

    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select("b", "a")) if large else pairs
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        joined = both.join(least, F.col("a") == F.col("c"))
        if large:
            moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        return moved.filter("a > b").distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    spark, pairs, before, old = edges.sparkSession, edges, None, None
    while True:
        path = new_path(spark, "stars")
        pairs = written(stars(stars(pairs, True), False), "", None, path)
        now = state(pairs)
        if old:
            remove(spark, old)
        old = path
        if now == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select("b", "b")).distinct()
        before = now


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Per row: id, n_shingles, cls (hash of the set) and component (smallest id); similar means num / den or more."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("thash", F.xxhash64("text"))
    spark, counters = docs.sparkSession, counters_for(docs)
    first = written(_first_pass(docs, n, counters), "jaccard-sets")
    rows = first.filter("block is null").select("id", "thash", "cls", "c", "n", "low", "bits")
    keys_path, asked_path = new_path(spark, "jaccard-keys"), new_path(spark, "jaccard-blocks")
    keys = written(_prefixes(docs, _counters(first, counters), n, num, den), "", "zstd", keys_path)
    # The sets of one n-gram and band are a block, named by the smallest; equal blocks of several n-grams are one.
    meetings = keys.groupBy("key", "band").agg(F.min("c").alias("least"), F.max("c").alias("other")).filter("least < other")
    asked = keys.join(meetings.drop("other"), ["key", "band"]).select(F.xxhash64("least", "band").alias("label"), "c")
    asked = written(asked.distinct(), "", "zstd", asked_path)
    remove(spark, keys_path)

    classes = rows.filter("cls is not null").groupBy("cls").agg(
        F.min("c").alias("c"), F.min("n").alias("size"), F.min("low").alias("low"), F.first("bits").alias("bits"),
        F.min(F.struct("id", "thash")).alias("one"), F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"))
    classes = written(classes, "jaccard-classes")
    members = asked.join(classes.drop("least", "rows"), "c").drop("c")
    blocks = members.groupBy("label").agg(F.count(F.lit(1)).alias("sets"), F.sum("size").alias("tokens"))
    parts = F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, 8 * F.col("tokens") / BLOCK_BYTES)).cast("int")
    blocks = blocks.filter("sets > 1").select("label", parts.alias("parts"))
    members = members.join(blocks, "label").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least("part", j).alias("left"), F.greatest("part", j).alias("right")))
    dealt = members.withColumn("cell", F.explode(cells)).select(
        "label", "cell.left", "cell.right", "part", "cls", F.col("one.id").alias("of"), F.col("one.thash").alias("hash"), "size", "low", "bits")
    dealt = dealt.repartition("label", "left", "right").sortWithinPartitions("label", "left", "right")
    hopeful = written(_with_partners(dealt, num, den), "jaccard-partners")

    cells_of = hopeful.groupBy("cls", "of", "hash").agg(F.collect_list(F.struct("label", "left", "right", "part")).alias("cells"))  # cells of one set
    texts = docs.join(cells_of.hint("merge"), F.col("id").eqNullSafe(F.col("of")) & (F.col("thash") == F.col("hash")))
    dealt = texts.select(F.explode("cells").alias("at"), "cls", "text").select("at.*", "cls", "text")
    dealt = dealt.repartition("label", "left", "right").sortWithinPartitions("label", "left", "right", "cls")
    edges = written(_block_links(dealt, n, num, den), "jaccard-links").distinct()

    roots = components(edges)
    least = roots.join(classes.select(F.col("cls").alias("node"), "least"), "node")
    merged = least.groupBy("root").agg(F.min("least").alias("component"))
    linked = roots.join(merged, "root").select(F.col("node").alias("cls"), "component")
    # Only classes of several rows or with links have another id than their row's. One class may be a third of all rows:
    # its rows are spread over salts, each of which gets its name.
    named = classes.join(linked, "cls", "left").filter(F.col("component").isNotNull() | (F.col("rows") > 1))
    named = named.select("cls", F.coalesce("component", "least").alias("component"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    alone = F.col("cls").isNull() | F.col("salt_of").isNull()
    named = named.withColumn("salt_of", F.col("salt"))
    return salted.join(named, ["cls", "salt"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "cls", "thash", F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the one with the smallest id stays.

    Ties of the id are broken by the hash of the text, the same row twice stays once; rows without words all stay.
    """
    found = similarity_classes(docs.select(id_col, text_col), id_col, text_col, n, num, den)
    first = found.filter("cls is not null").groupBy("component").agg(F.min(F.struct(F.col(id_col).alias("i"), F.col("thash").alias("h"))).alias("f"))
    keep = first.select("f.i", "f.h")
    marked = packed(docs, text_col, id_col).withColumn("hash", F.xxhash64("text"))
    wordless = ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    kept = marked.filter(~wordless).join(keep, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h"))).drop("i", "h")
    once = Window.partitionBy("id", "hash").orderBy(F.lit(0))  # rows of one id and one text
    kept = kept.withColumn("k", F.row_number().over(once)).filter("k = 1").drop("k").union(marked.filter(wordless))
    return kept.select(*unpacked(kept, docs, text_col))


def op8_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents that share nine tenths of their three-word shingles."""
    found = similarity_classes(table(spark, sf_dir, "documents"), n=3, num=9, den=10)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"))

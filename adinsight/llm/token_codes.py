"""Token ids as directly addressable codes: write, read back, fetch any token without decoding a block.

A shard is one self-contained binary value. Its ids are split into chunks of eight bits, lowest first. Level 0
holds the lowest chunk of every id; level k + 1 holds the next chunk of those ids of level k that have more bits.
A continuation bitmap over each level says which ids go on, and a rank directory (ones before each block of 512
bits) turns a position of one level into the position of the next. Fetching an id takes one byte and one rank a
level.

Layout, little-endian: ``DAC1``, uint32 levels, uint64 ids; then for each level uint64 entries, the chunk bytes, and
(for all levels but the last) the bitmap padded to 64 bits and the uint64 rank directory.

Nulls: a null text is encoded as an empty one, so it has the end id only. Documents are written in ascending id
order, null ids first, repeated ids as documents of their own in the order of the first 64 characters, then of the hash
of their texts. An empty table gives no shards and no rows. A text of any length is encoded as a whole; one longer than
a shard makes its shard longer. Further columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adinsight.llm.common import Generations, groups, new_path, whole, worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAGIC = b"DAC1"
BLOCK = 512
#: Ids of a shard, after which the document being written is its last.
SHARD_IDS = 1 << 20
#: Bytes of each of the two generations of a worker's memo of units.
MEMO = 56 << 20
#: Characters of text that are split and looked up together.
TOGETHER = 8 << 20
#: What stands between units while a text is split; a text that holds it is encoded as a whole.
_CUT = "\x01"


# --- the codes -----------------------------------------------------------------------------------------------------

def pack(ids: np.ndarray) -> bytes:
    """The codes of unsigned 32-bit ids."""
    rest = np.ascontiguousarray(ids, dtype=np.uint32)
    levels = []
    while True:
        chunk, rest = (rest & 0xFF).astype(np.uint8), rest >> np.uint32(8)
        more = rest > 0
        last = not more.any()
        body = struct.pack("<Q", len(chunk)) + chunk.tobytes()
        if not last:
            bits = np.packbits(more, bitorder="little").tobytes()
            bits += b"\0" * (-len(bits) % (BLOCK // 8))
            ones = np.unpackbits(np.frombuffer(bits, np.uint8)).reshape(-1, BLOCK).sum(1, dtype=np.uint64)
            body += bits + np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u8").tobytes()
        levels.append(body)
        if last:
            return MAGIC + struct.pack("<IQ", len(levels), len(ids)) + b"".join(levels)
        rest = rest[more]


class Codes:
    """Random access to packed ids."""

    def __init__(self, data: bytes):
        levels, self.size = struct.unpack_from("<IQ", data, 4)
        if data[:4] != MAGIC:
            raise ValueError("not a shard of token codes")
        self.levels, at = [], 16
        for k in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunk = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            bits = ranks = None
            if k + 1 < levels:
                blocks = -(-n // BLOCK)
                bits = np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at)
                ranks = np.frombuffer(data, "<u8", blocks, at + len(bits))
                at += len(bits) + 8 * blocks
            self.levels.append((chunk, bits, ranks))

    def __len__(self) -> int:
        return self.size

    def _rank(self, k: int, i: int) -> int:
        """Ones of level k's bitmap before position i."""
        _, bits, ranks = self.levels[k]
        block = i // BLOCK
        if block == len(ranks):
            if not block:
                return 0
            block -= 1
        before = bits[block * BLOCK // 8 : i // 8]
        ones = int(ranks[block]) + int(np.bitwise_count(before).sum())
        return ones + (int(bits[i // 8] & ((1 << (i % 8)) - 1)).bit_count() if i % 8 else 0)

    def __getitem__(self, i: int) -> int:
        """Id number i: one chunk and one rank a level."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for k, (chunk, bits, _) in enumerate(self.levels):
            value |= int(chunk[i]) << (8 * k)
            if bits is None or not bits[i // 8] >> (i % 8) & 1:
                break
            i = self._rank(k, i)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, touching only their own chunks."""
        out = np.zeros(stop - start, np.uint32)
        where = np.arange(stop - start)
        for k, (chunk, bits, _) in enumerate(self.levels):
            out[where] |= chunk[start:stop].astype(np.uint32) << np.uint32(8 * k)
            if bits is None or start == stop:
                break
            first = start // 8
            goes_on = np.unpackbits(bits[first : -(-stop // 8)], bitorder="little")[start - 8 * first : stop - 8 * first]
            start, stop = self._rank(k, start), self._rank(k, stop)
            where = where[goes_on.astype(bool)]
        return out


# --- encoding ------------------------------------------------------------------------------------------------------

class WordMemo:
    """Whole-text encoding by the tokenizers library that asks it for each distinct word once.

    A byte-level pattern with ``use_regex`` ends a token before every single space that a word follows, around every
    single line break between words, and between an ASCII letter and an ASCII punctuation mark other than an apostrophe,
    so the ids of a text are those of its units. Where a white space run is longer, and where a text holds an added
    token, the library gets the whole text. Other tokenizers always get whole texts. Units are split, numbered and
    gathered a batch at a time.
    """

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.model = self.library.model
        self.library.no_truncation()
        self.library.no_padding()
        pre = self.library.pre_tokenizer
        plain = self.library.normalizer is None and type(pre).__name__ == "ByteLevel" and "use_regex=True" in repr(pre)
        self.segmented = plain and not pre.add_prefix_space
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.memo = Generations(lambda _: None, MEMO)

    def _ids(self, texts: list[str]) -> list[bytes]:
        every = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        ends = list(accumulate(map(len, every), initial=0))
        data = np.fromiter(chain.from_iterable(every), "<u4", ends[-1]).tobytes()
        return [data[4 * a : 4 * b] for a, b in pairwise(ends)]

    def _word(self, word: str) -> bytes:
        """Ids of ASCII letters, after a space or not: what the pattern leaves whole goes straight to the model."""
        found = self.model.tokenize(word.replace(" ", "\u0120"))
        return struct.pack("<%dI" % len(found), *[t.id for t in found])

    def _units(self, names: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Ids of units, and which of them are irregular: white space runs across their ends."""
        odd, known, old = np.zeros(len(names), bool), self.memo.get, self.memo.old.get
        units = [known(n) for n in names]
        words, others = [], []
        for k in [k for k, ids in enumerate(units) if ids is None]:
            name = names[k]
            if (ids := old(name)) is not None:
                units[k] = ids
                self.memo.put(name, ids)
            elif name.isascii() and (name[1:] if name[:1] == " " else name).isalpha():
                words.append(k)
            elif name != "\n" and (not name or name[-1].isspace() or name[-1] == "\u180e" or name[:1] != " " and name[0].isspace() or name[1:2].isspace()):
                units[k], odd[k] = b"", True
            else:
                others.append(k)
        for k, ids in chain(((k, self._word(names[k])) for k in words), zip(others, self._ids([names[k] for k in others]))):
            units[k] = ids
            self.memo.put(names[k], ids)
        return units, odd

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.segmented:
            every = self._ids(texts.to_pylist())
            return np.frombuffer(b"".join(every), "<u4"), np.array([len(e) // 4 for e in every], np.int64)
        texts = texts.cast(pa.large_string())
        special = pc.match_substring(texts, _CUT)
        for content in self.added:
            special = pc.or_(special, pc.match_substring(texts, content))
        cut = pc.replace_substring_regex(texts, r"([A-Za-z])([!-&(-/:-@\[-`{-~])", r"\1%s\2" % _CUT)
        cut = pc.replace_substring(pc.replace_substring(cut, " ", _CUT + " "), "\n", _CUT + "\n" + _CUT)
        split = pc.split_pattern(cut, _CUT)
        starts = split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()
        numbered = split.flatten().dictionary_encode()
        unit = numbered.indices.to_numpy().astype(np.int64)
        units, odd = self._units(numbered.dictionary.to_pylist())
        ends = np.append(starts[1:], len(unit))
        irregular = np.flatnonzero(np.logical_or.reduceat(odd[unit], starts) | special.to_numpy(zero_copy_only=False))
        nothing = len(units)
        units.append(b"")
        for i, ids in zip(irregular.tolist(), self._ids(texts.take(pa.array(irregular)).to_pylist())):
            unit[starts[i] : ends[i]] = nothing
            unit[starts[i]] = len(units)
            units.append(ids)
        lengths = np.fromiter(map(len, units), np.int64, len(units)) // 4
        flat, at = np.frombuffer(b"".join(units), "<u4"), np.cumsum(lengths) - lengths
        sizes = lengths[unit]
        before = np.cumsum(sizes) - sizes
        out = flat[np.repeat(at[unit] - before, sizes) + np.arange(int(sizes.sum()))]
        return out, np.add.reduceat(sizes, starts)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text], pa.large_string()))[0].astype("<u4").tobytes()

    def batches(self, texts: pa.Array, end_id: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Bounds of consecutive texts (without nulls), their ids, each followed by the end id, and the ids of each."""
        sizes = pc.binary_length(texts).to_pylist()
        for start, stop in groups(sizes, lambda n: n, TOGETHER):
            ids, lengths = self.encode_all(texts.slice(start, stop - start))
            if end_id is not None:
                ids, lengths = np.insert(ids, np.cumsum(lengths), end_id), lengths + 1
            yield start, stop, ids, lengths


def word_memo(definition: str) -> WordMemo:
    return worker_cache("word-memo", lambda: WordMemo(definition), zlib.crc32(definition.encode()))


# --- writing and reading -------------------------------------------------------------------------------------------

def _shard_schema(id_type: T.DataType) -> T.StructType:
    doc = T.StructType([T.StructField("id", id_type), T.StructField("n_tokens", T.LongType())])
    return T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()),
        T.StructField("first", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("docs", T.ArrayType(doc)), T.StructField("codes", T.BinaryType()),
    ])


def write_codes(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id",
                text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode every text with the tokenizer file and write ``path/shards`` and ``path/parts``.

    Shards hold consecutive documents in id order. ``parts`` has a row per write task, with the number of ids before
    it; their number is that of the tasks, not of the documents.
    """
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(Path(tokenizer).read_text())
    schema = _shard_schema(docs.schema[id_col].dataType)
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    # Rows of one id may be many: they are ranged by the start and the hash of their texts, equal ones by their place.
    order = ["id", F.substring("text", 1, 64), F.xxhash64("text"), "place"]
    ordered = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        coder, arrow = word_memo(definition.value), to_arrow_schema(schema)
        part, shard, first = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        keys: list[pa.Array] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            values, lengths = np.concatenate(ids), np.concatenate(sizes)
            members = pa.StructArray.from_arrays([pa.chunked_array(keys).combine_chunks(), pa.array(lengths)], fields=list(arrow.field("docs").type.value_type))
            docs = pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), members)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([first]), pa.array([len(values)]),
                                               docs.cast(arrow.field("docs").type), pa.array([pack(values)], pa.binary())], schema=arrow)

        held = 0
        for batch in batches:
            for start, stop, values, lengths in coder.batches(batch.column(1), end_id):
                ends = np.cumsum(lengths)
                at = 0
                while at < stop - start:  # documents up to the one that fills the shard
                    before = int(ends[at - 1]) if at else 0
                    to = min(int(np.searchsorted(ends, before + shard_ids - held)) + 1, stop - start)
                    ids.append(values[before : ends[to - 1]])
                    keys.append(batch.column(0).slice(start + at, to - at))
                    sizes.append(lengths[at:to])
                    held += int(ends[to - 1]) - before
                    at = to
                    if held >= shard_ids:
                        yield flush()
                        shard, first, held = shard + 1, first + held, 0
                        ids, keys, sizes = [], [], []
        if keys:
            yield flush()

    ordered.mapInArrow(encode, schema).write.parquet(f"{path}/shards")
    totals = spark.read.schema(schema).parquet(f"{path}/shards").groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    before, parts = 0, []
    for row in sorted(totals):  # one row a write task
        parts.append((row.part, before))
        before += row.n
    spark.createDataFrame(parts, "part int, before long").coalesce(1).write.parquet(f"{path}/parts")


def read_codes(spark: SparkSession, path: str, id_type: T.DataType | None = None) -> DataFrame:
    """Per document of written codes: id, start (ids before it), n_tokens, ids_crc32 and the ids as bytes are decoded
    from the shards, each document on its own."""
    shards = spark.read.parquet(f"{path}/shards")
    id_type = id_type or shards.schema["docs"].dataType.elementType["id"].dataType
    parts = F.broadcast(spark.read.parquet(f"{path}/parts"))  # a row per write task
    placed = shards.join(parts, "part").select((F.col("before") + F.col("first")).alias("start"), "docs", "codes")
    schema = T.StructType([
        T.StructField("id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for start, members, data in zip(*(batch.column(i) for i in range(3))):
                codes, at, start, rows = Codes(data.as_py()), 0, start.as_py(), []
                for doc in members.as_py():
                    n = doc["n_tokens"]
                    rows.append((doc["id"], start + at, n, zlib.crc32(codes.slice(at, at + n).astype("<u4").tobytes())))
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, f.type) for column, f in zip(zip(*rows), arrow)], schema=arrow)

    return placed.mapInArrow(digest, schema)


def tokens_at(spark: SparkSession, path: str, positions: DataFrame, position: str = "position") -> DataFrame:
    """The id at each global position: a range lookup of its shard, then one access into the codes.

    Positions outside the written ids, and nulls, give no row.
    """
    shards = spark.read.parquet(f"{path}/shards")
    parts = F.broadcast(spark.read.parquet(f"{path}/parts"))
    placed = shards.join(parts, "part").withColumn("start", F.col("before") + F.col("first"))
    # Shards are cut by a count of ids, so a grid of that count names the few shards a position can lie in.
    cells = placed.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("start") / SHARD_IDS), F.floor((F.col("start") + F.col("n_tokens") - 1) / SHARD_IDS))))
    keys = cells.select("cell", "part", "shard", "start", "n_tokens")
    wanted = positions.select(F.col(position).cast("long").alias("position")).filter("position is not null")
    wanted = wanted.withColumn("cell", F.floor(F.col("position") / SHARD_IDS))
    hits = wanted.join(keys, "cell").filter("position >= start and position < start + n_tokens")
    grouped = hits.groupBy("part", "shard", F.col("position").bitwiseAND(63).alias("salt")).agg(
        F.collect_set(F.struct("position", (F.col("position") - F.col("start")).alias("at"))).alias("asked"))
    joined = grouped.join(shards.select("part", "shard", "codes"), ["part", "shard"]).select("asked", "codes")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, data in zip(batch.column(0), batch.column(1)):
                codes, asked = Codes(data.as_py()), asked.as_py()
                yield pa.RecordBatch.from_pydict({"position": pa.array([a["position"] for a in asked], pa.int64()),
                                                  "token": pa.array([codes[a["at"]] for a in asked], pa.int64())})

    return joined.mapInArrow(fetch, "position long, token long")


def op1_directly_addressable_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, write and read back all documents; one row per document from the files."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = new_path(spark, "token-codes")
    write_codes(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_codes(spark, path).withColumnRenamed("id", "doc_id")

"""Byte-pair encoding and decoding with a contiguous rank array.

Each word is a row of part slots; beside every slot stands the rank of its pair with the next one. A round takes the
lowest rank of the row (leftmost first), merges that pair, deletes the boundary between its parts and refreshes the
ranks of the two neighbouring pairs, until no pair of the row has a rank. Words of similar length run through the
rounds together as one matrix, whose rows all lose one slot a round. Words beyond ``LONG`` bytes, where scanning
grows with the square of the length, take the same merges from a queue of pairs instead.

Nulls: a null text is encoded as an empty one: no ids, decoded as "". Rows with the same id are documents of their
own. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adinsight.llm.common import Generations, groups, table, tidy, whole, worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NONE = np.int32(2**31 - 1)
#: Bytes beyond which a word is not scanned again for each merge.
LONG = 128
#: Bytes of each generation of a worker's two memos.
MEMO = 40 << 20
#: Bytes of text whose new words are encoded together.
TOGETHER = 1 << 21


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class RankArray:
    """Merges of a vocabulary: words in, ids out."""

    def __init__(self, vocab: dict[str, int], merges: Iterable, suffix: str = ""):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        symbols = byte_symbols()
        self.pad = max(vocab.values()) + 1
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocab[a] for a, _ in pairs], np.int64) * (self.pad + 1) + [vocab[b] for _, b in pairs]
        self.rank_of = {}
        for rank, key in enumerate(keys.tolist()):
            self.rank_of.setdefault(key, rank)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        for key, rank in self.rank_of.items():
            at = int(self._slot(np.array([key], np.int64))[0])
            while self.keys[at] >= 0:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.ranks[at] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it never merges."""
        keys = left.astype(np.int64) * (self.pad + 1) + right
        at = self._slot(keys)
        out, found = self.ranks[at], self.keys[at]
        out[found != keys] = NONE
        left_over = np.flatnonzero((found != keys) & (found >= 0))
        while len(left_over):
            at[left_over] = (at[left_over] + 1) % len(self.keys)
            found = self.keys[at[left_over]]
            hit = found == keys[left_over]
            out[left_over[hit]] = self.ranks[at[left_over[hit]]]
            left_over = left_over[~hit & (found >= 0)]
        return out

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; an empty word has none."""
        out: list = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        for i in np.flatnonzero(sizes == 0):
            out[i] = np.zeros(0, np.int32)
        start = 0
        while start < len(order):
            low = sizes[order[start]]
            if low > LONG:
                out[order[start]] = self._queue(words[order[start]])
                start += 1
                continue
            most = min(low + 1 + low // 4, LONG)
            stop = min(np.searchsorted(sizes[order], most, "right"), start + max(1, 400_000 // int(most)))
            chosen = order[start:stop]
            for i, ids in zip(chosen, self._matrix([words[i] for i in chosen], sizes[chosen])):
                out[i] = ids
            start = stop
        return out

    def _matrix(self, words: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
        out: list = [None] * len(words)
        width = int(sizes.max())
        parts = np.full((len(words), width), self.pad, np.int32)
        raw = np.frombuffer(b"".join(words), np.uint8)
        parts[np.arange(width) < sizes[:, None]] = self.inner[raw]
        parts[np.arange(len(words)), sizes - 1] = self.final[raw[np.cumsum(sizes) - 1]]
        ranks = np.full(parts.shape, NONE, np.int32)
        ranks[:, :-1] = self.rank(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(words), -1)
        row, left = np.arange(len(words)), sizes.copy()
        while len(row):
            at = ranks.argmin(1)
            lowest = ranks[np.arange(len(row)), at]
            on = lowest < NONE
            if not on.all():
                for i in np.flatnonzero(~on):
                    out[row[i]] = parts[i, : left[i]].copy()
                parts, ranks, row, left, at, lowest = parts[on], ranks[on], row[on], left[on], at[on], lowest[on]
                if not len(row):
                    break
            line = np.arange(len(row))
            keep = np.ones(parts.shape, bool)
            keep[line, at + 1] = False  # the boundary between the merged parts goes
            parts[line, at] = self.merged[lowest]
            parts, ranks = parts[keep].reshape(len(row), -1), ranks[keep].reshape(len(row), -1)
            left = left - 1
            inside = at > 0
            ranks[line[inside], at[inside] - 1] = self.rank(parts[line[inside], at[inside] - 1], parts[line[inside], at[inside]])
            right = np.minimum(at + 1, parts.shape[1] - 1)
            following = np.where(at + 1 < parts.shape[1], parts[line, right], self.pad)
            ranks[line, at] = self.rank(parts[line, at], following)
        return out

    def _queue(self, word: bytes) -> np.ndarray:
        ids = self.inner[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.final[word[-1]])
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        rank, base = self.rank_of, self.pad + 1
        queue = [(r, i) for i in range(len(ids) - 1) if (r := rank.get(ids[i] * base + ids[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            j = after[i] if ids[i] >= 0 else len(ids)
            if j >= len(ids) or rank.get(ids[i] * base + ids[j]) != r:
                continue  # a part of this pair has merged meanwhile
            ids[i], ids[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(ids) and (s := rank.get(ids[a] * base + ids[b])) is not None:
                    heapq.heappush(queue, (s, a))
        return np.array([x for x in ids if x >= 0], np.int32)


class WordBpe:
    """Texts to ids and back, as the definition file of a word-end vocabulary says.

    Understands the normalizer NFC, white space, lower case; the split into contractions, letter runs, single digits
    and runs of the rest; byte-level symbols; a suffix at word ends; special tokens found in the text first.
    """

    # The split pattern of the definition, and what its library counts as white space.
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, definition: str):
        import regex

        spec = json.loads(definition)
        model = spec["model"]
        splits = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or [p["pattern"] for p in splits] != [{"Regex": self.PIECES}]:
            raise ValueError("not a lower-case byte-level vocabulary with word ends")
        self.array = RankArray(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # Python, the regex module and the library know different Unicode versions: where a letter or digit is newer
        # than Python's tables, the library is asked how it splits and lower-cases it.
        from tokenizers import Regex, normalizers, pre_tokenizers

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        newer = "".join(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c)[0] not in "LN")
        known = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed", invert=True).pre_tokenize_str(newer)
        late = "".join(sorted(set(newer) - {c for c, _ in known}))
        lowered = normalizers.Lowercase().normalize_str("\n".join(newer)).split("\n")
        self.lower = str.maketrans({c: x for c, x in zip(newer, lowered) if c != x})
        self.newer = frozenset(newer)
        self.pieces = regex.compile(self.PIECES)
        self.ascii_pieces = re.compile(self.PIECES.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", r"\t-\r\x20"))
        pattern = self.PIECES
        if late:
            late = regex.escape(late)
            pattern = (pattern.replace(r"[\p{L}]", rf"[\p{{L}}--[{late}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{late}]]")
                       .replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{late}]]"))
        self.exact_pieces = regex.compile(pattern, regex.V1)
        strings = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.special.items()}
        self.strings = [strings.get(i, "") for i in range(max(strings) + 1)]
        self.words = Generations(lambda w: self._new([w])[0], MEMO)
        self.parts = Generations(lambda p: self.array.encode([p.encode()])[0].astype("<u4").tobytes(), MEMO)

    def _split(self, word: str) -> list[str]:
        if word.isalpha():  # no letter that is newer than Python's tables
            return [word]
        if word.isascii():
            return self.ascii_pieces.findall(word)
        if self.newer.isdisjoint(word):
            return self.pieces.findall(word)
        return self.exact_pieces.findall(word.translate(self.lower))

    def _new(self, words: list[str]) -> list[bytes]:
        """Ids of words that are not in the memo, their new pieces merged together."""
        split = [self._split(w) for w in words]
        new = [p for p in {p for s in split for p in s} if p not in self.parts and p not in self.parts.old]
        made = {p: ids.astype("<u4").tobytes() for p, ids in zip(new, self.array.encode([p.encode() for p in new]))}
        out = [b"".join([made.get(p) or self.parts[p] for p in s]) for s in split]
        for p, ids in made.items():
            self.parts.put(p, ids)
        return out

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case without the rule of final letters
        return text.lower()

    def _words(self, text: str) -> list[str]:
        text = self.normal(text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for split(), not for the pattern
            return self.exact_pieces.findall(text.translate(self.lower))
        return text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        for start, stop in groups(texts, len, TOGETHER):
            split = [self._sections(t) for t in texts[start:stop]]
            seen = set().union(*(w for s in split for w in s if isinstance(w, list)))
            new = [w for w in seen if w not in self.words and w not in self.words.old]
            for w, ids in zip(new, self._new(new)):
                self.words.put(w, ids)
            for i, s in enumerate(split, start):
                out[i] = b"".join([w if isinstance(w, bytes) else b"".join(map(self.words.__getitem__, w)) for w in s])
        return out

    def _sections(self, text: str) -> list:
        """Word lists, and the ids of the special tokens between them."""
        if not self.marks or not any(s in text for s in self.special):
            return [self._words(text)]
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [self._words(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return [*out, self._words(text[at:])]

    def decode(self, ids: bytes) -> str:
        """Token strings joined by a space, as the definition names no decoder; special tokens stay."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _coder(definition: str) -> WordBpe:
    return worker_cache("word-bpe", lambda: WordBpe(definition), zlib.crc32(definition.encode()))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False,
           keep: bool = True) -> DataFrame:
    """Per row: its id, n_tokens, ids (little-endian unsigned 32-bit integers) and, if asked for, their decoding.

    Workers keep their memos for later tasks, unless told not to.
    """
    definition = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text())
    schema = T.StructType([
        docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
        *[T.StructField("decoded", T.StringType())] * decoded,
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(definition.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for start, stop in groups(texts, len, TOGETHER):
                ids = coder.encode(texts[start:stop])
                columns = [keys.slice(start, stop - start), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([coder.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(id_col), whole(text_col)).mapInArrow(tidy(run, *["word-bpe"] * (not keep)), schema)


def decode(rows: DataFrame, tokenizer: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the decoding of their ids in a column; null ids stay null."""
    definition = rows.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text())
    schema = T.StructType([f for f in rows.schema if f.name != out] + [T.StructField(out, T.StringType())])
    at = [f.name for f in rows.schema if f.name != out].index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(definition.value)
        for batch in batches:
            texts = [None if x is None else coder.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return rows.drop(out).mapInArrow(run, schema)


def op2_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents; the digests of both per document."""
    import public_tokenizers

    rows = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))

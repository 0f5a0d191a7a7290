"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all benchmark items make one automaton, whose states stand for sets of word sequences that
end at the same places of the items. A document's words are streamed through it: each word moves on to the longest
suffix of what was read that occurs in some item, whose length is the matching length there. A matching length of a
window's size says that the words up to here are a window of an item (or of several); items shorter than the window
are one window each, marked on the states where they end whole.

The automaton grows with the benchmark, not with the documents. It is built on the driver and broadcast, after a check
of the benchmark's size against ``BENCHMARK_BYTES``; larger benchmarks are dealt with in parts, one automaton and one
pass over the documents each, whose hits are united per document.

Nulls: a null text, or one without words, has no words and no hits; an item like that has no window. An item without an id gives hits but is not listed. Rows with the
same document id are documents of their own; items with the same id count once. Empty tables give no rows or no hits.
Further columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from adinsight.llm.common import packed, table, tidy, unpacked, worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 13
#: Text bytes of the benchmark items of one automaton.
BENCHMARK_BYTES = 32 << 20

#: Separators (ASCII without letters and digits) become spaces, A-Z lower case.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class SuffixAutomaton:
    """States of all factors of the given word sequences."""

    def __init__(self, sequences: Iterable[list[bytes]], window: int):
        self.window = window
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set[int] | None] = [None]  # items that have a window at this state
        self.short: list[set[int] | None] = [None]  # items that are this state's longest sequence
        ends: list[tuple[int, int, int]] = []
        for item, words in enumerate(sequences):
            state = 0
            for i, word in enumerate(words, 1):
                state = self._extend(state, word)
                if i >= window:
                    ends.append((state, item, window))
            if 0 < len(words) < window:
                ends.append((state, item, len(words)))
        for state, item, size in ends:
            # the state whose sequences include the last `size` words read here
            while self.link[state] >= 0 and self.length[self.link[state]] >= size:
                state = self.link[state]
            held = self.items if size == window else self.short
            held[state] = held[state] or set()
            held[state].add(item)
        # A document's match can be longer than a short item: what ends whole at a state also ends at those below it.
        self.ending: dict[int, list[tuple[int, frozenset[int]]]] = {}
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        for state in order[1:]:
            found = list(self.ending.get(self.link[state], ()))
            if self.short[state]:
                found.append((self.length[state], frozenset(self.short[state])))
            if found:
                self.ending[state] = found

    def _new(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.items.append(None)
        self.short.append(None)
        return len(self.next) - 1

    def _split(self, state: int, word: bytes, target: int) -> int:
        copy = self._new(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: bytes) -> int:
        target = self.next[last].get(word)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new = self._new(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            target = self.next[last][word]
            self.link[new] = target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        return new


class Matcher:
    """Streams documents through an automaton."""

    def __init__(self, sequences: list[list[bytes]], window: int):
        self.automaton = SuffixAutomaton(sequences, window)
        known = {w for s in sequences for w in s}
        self.number = dict(zip(known, range(1, len(known) + 1)))
        a = self.automaton
        self.moves = [{self.number[w]: t for w, t in moves.items()} for moves in a.next]
        self.shortest = min([window, *(len(s) for s in sequences if s)], default=window)
        self.window_state = self._window_states()

    def _window_states(self) -> list[int]:
        """The state of the last `window` words below each state, or -1 if it is shorter."""
        a, out = self.automaton, [-1] * len(self.automaton.length)
        for s in sorted(range(len(a.length)), key=a.length.__getitem__):
            if a.length[s] >= a.window:
                up = a.link[s]
                out[s] = out[up] if up >= 0 and a.length[up] >= a.window else s
        return out

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], list[int]]:
        """Merged hit spans (start, end), items found, and the longest matching length within each span."""
        ids = list(map(self.number.get, words))
        a, moves, link, length = self.automaton, self.moves, self.automaton.link, self.automaton.length
        window, ending, at_window = a.window, a.ending, self.window_state
        spans: list[list[int]] = []
        longest: list[int] = []
        items: set[int] = set()
        state = matched = 0

        def hit(start: int, end: int, size: int) -> None:
            while spans and spans[-1][1] >= start:  # a longer window may reach back over shorter ones
                start = min(start, spans.pop()[0])
                size = max(size, longest.pop())
            spans.append([start, end])
            longest.append(size)

        for i, w in enumerate(ids):
            if w is None:
                state = matched = 0
                continue
            to = moves[state].get(w)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = moves[state].get(w)
            if to is None:
                continue
            state, matched = to, matched + 1
            if matched >= window:
                hit(i + 1 - window, i + 1, matched)
                found = a.items[at_window[state]]
                if found:
                    items |= found
            if state in ending:
                for size, found in ending[state]:
                    if size <= matched:
                        hit(i + 1 - size, i + 1, size)
                        items |= found
        return [tuple(s) for s in spans], items, longest


def _benchmark_parts(items: DataFrame, id_col: str, text_col: str, most: int) -> list[list[tuple[str | None, bytes]]]:
    """Items as (id, text), in parts of bounded size."""
    rows = (items.filter(F.col(text_col).isNotNull())
            .select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).distinct().orderBy("i", "t"))
    parts: list[list[tuple[str | None, bytes]]] = [[]]
    size = 0
    for row in rows.toLocalIterator():
        if size + len(row.t) > most and parts[-1]:
            parts.append([])
            size = 0
        parts[-1].append((row.i, bytes(row.t)))
        size += len(row.t)
    return parts


def find_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text", window: int = WINDOW, carry: bool = False, part_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """Per document: id, n_words, spans (array of start, end, longest in words), items (sorted ids as strings).

    ``carry`` keeps the document's own columns beside them. With a benchmark of several parts the spans of a document
    may overlap between parts; :func:`n_hit` counts words once.
    """
    parts = _benchmark_parts(items, item_col, item_text_col, part_bytes)
    span = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end", "longest")])
    found = [T.StructField("__n_words", T.LongType()), T.StructField("__spans", T.ArrayType(span)), T.StructField("__items", T.ArrayType(T.StringType()))]
    rows = docs if carry else docs.select(id_col, text_col)
    base = list(rows.schema) if carry else [docs.schema[id_col]]
    for k, part in enumerate(parts):
        shipped = docs.sparkSession.sparkContext.broadcast(part)  # at most part_bytes of text, see above
        key = f"{window}-{zlib.crc32(repr(part).encode())}-{k}"
        last, first = k == len(parts) - 1, k == 0

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, key=key, first=first, last=last) -> Iterator[pa.RecordBatch]:
            def build():
                return Matcher([words_of(t) for _, t in shipped.value], window), [i for i, _ in shipped.value]

            from pyspark.sql.pandas.types import to_arrow_schema

            matcher, ids = worker_cache("matcher", build, key)
            arrow = to_arrow_schema(T.StructType(found))
            added = set(arrow.names)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col))
                counts, spans, lists = [], [], []
                for text in texts.cast(pa.binary()):
                    words = words_of(text.as_py() or b"")
                    got, hits, longest = matcher.spans(words) if len(words) >= matcher.shortest else ([], set(), [])
                    counts.append(len(words))
                    spans.append([{"start": s, "end": e, "longest": m} for (s, e), m in zip(got, longest)])
                    lists.append(sorted({ids[h] for h in hits} - {None}))
                if not first:
                    before = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("__spans", "__items")]
                    spans = [sorted(a + b, key=lambda x: (x["start"], x["end"])) for a, b in zip(before[0], spans)]
                    lists = [sorted({*a, *b}) for a, b in zip(before[1], lists)]
                kept = [n for n in batch.schema.names if n not in added and (n != text_col or carry or not last)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(batch.schema.get_field_index(n)) for n in kept), pa.array(counts, pa.int64()),
                     pa.array(spans, arrow.field(1).type), pa.array(lists, arrow.field(2).type)],
                    names=[*kept, *(f.name for f in found)])

        keep = base if carry or last else [*base, docs.schema[text_col]]
        rows = rows.mapInArrow(tidy(run), T.StructType([*keep, *found]))
    return rows


def n_hit(spans: str = "__spans") -> F.Column:
    """Words inside any span, overlapping spans counted once (they come sorted by start)."""
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
    return F.aggregate(spans, zero, lambda a, s: F.struct(
        F.greatest(a["to"], s["end"]).alias("to"),
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["to"]))).alias("n")), lambda a: a["n"].cast("long"))


def contaminated(spans: str = "__spans", n_words: str = "__n_words") -> F.Column:
    """A twentieth of the words or more is hit."""
    return (n_hit(spans) > 0) & (20 * n_hit(spans) >= F.col(n_words))


_WORD = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # as words_of, before A-Z become lower case


def without_spans(text: str, spans: list[dict], least: int) -> str:
    """The text without the words of spans of ``least`` words or more, from the first one's start to the last one's end."""
    if not any(s["end"] - s["start"] >= least for s in spans):
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    parts, at = [], 0
    for s in spans:
        if s["end"] - s["start"] >= least:
            parts.append(text[at : max(at, places[s["start"]][0])])
            at = max(at, places[s["end"] - 1][1])
    return "".join([*parts, text[at:]])


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, least_span: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents, and the others without their hit spans of ``least_span`` words or more."""
    rows = packed(docs, text_col, id_col)
    found = find_hits(rows, items, "id", "text", item_col, item_text_col, window, carry=True).filter(~contaminated())
    at = rows.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:-1])
            spans = batch.column(batch.num_columns - 1).to_pylist()
            if any(spans):
                texts = [t if not s or t is None else without_spans(t, s, least_span) for t, s in zip(columns[at].to_pylist(), spans)]
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    clean = found.select(*rows.columns, "__spans").mapInArrow(tidy(cut), rows.schema)
    return clean.select(*unpacked(clean, docs, text_col))


def op9_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of 13-word benchmark windows in all documents."""
    found = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = n_hit()
    return found.select("doc_id", F.col("__n_words").alias("n_words"), hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
                        ((hit > 0) & (20 * hit >= F.col("__n_words"))).alias("contaminated"))

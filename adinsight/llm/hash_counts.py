"""Counts of 64-bit hashes that travel as sorted arrays, one row for each bucket of the hash range.

A task packs what it has counted, Spark moves the rows by bucket, and the arrays of a bucket are merged in its task. An
entry takes six bytes or so once Spark has compressed it, a fifth of a row of the same counts, and the JVM handles
bytes only. The number of buckets follows the input, so that a bucket's size does not. Counts stop at 2^32 - 1.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from adinsight.llm.common import tidy

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Hashes, repeats included, that call for a bucket of their own.
BUCKET = 1 << 20
MOST = (1 << 32) - 1


def bits_for(n: int) -> int:
    """Leading bits of a hash that name its bucket, for so many hashes."""
    return min(16, max(3, (n // BUCKET).bit_length()))


def pack(hashes: np.ndarray, *counts: np.ndarray) -> bytes:
    """Sorted hashes and their counts; differences and counts stand byte by byte, so that they compress."""
    planes = [np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T]
    planes += [np.minimum(c, MOST).astype(np.uint32).view(np.uint8).reshape(-1, 4).T for c in counts]
    return np.concatenate(planes).tobytes()


def unpack(data: bytes, counts: int) -> list[np.ndarray]:
    """The hashes, and so many counts of each as 64-bit numbers."""
    planes = np.frombuffer(data, np.uint8).reshape(8 + 4 * counts, -1)
    out = [np.cumsum(np.ascontiguousarray(planes[:8].T).view(np.uint64).ravel(), dtype=np.uint64)]
    for k in range(counts):
        out.append(np.ascontiguousarray(planes[8 + 4 * k : 12 + 4 * k].T).view(np.uint32).ravel().astype(np.int64))
    return out


def buckets(bits: int, hashes: np.ndarray, *counts: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Buckets and packed entries of sorted distinct hashes."""
    cuts = np.searchsorted(hashes, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(hashes)]
    used = [b for b in range(1 << bits) if cuts[b] < cuts[b + 1]]
    return used, [pack(hashes[cuts[b] : cuts[b + 1]], *(c[cuts[b] : cuts[b + 1]] for c in counts)) for b in used]


def distinct(hashes: np.ndarray, *counts: np.ndarray, by: tuple[np.ufunc, ...] = ()) -> list[np.ndarray]:
    """Sorted distinct hashes with the sums of their counts, or what ``by`` names for each."""
    order = np.argsort(hashes, kind="stable")  # runs that are sorted already are merged
    hashes = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    ways = by or (np.add,) * len(counts)
    return [hashes[first], *(way.reduceat(c[order], first) if len(first) else c for way, c in zip(ways, counts))]


def merged(rows: DataFrame, merge: Callable[[list[tuple]], Iterator[pa.RecordBatch]], schema: str, *keys: str) -> DataFrame:
    """Rows that ``merge`` makes of all rows (as tuples) of each key; the keys are the first columns of ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[: len(keys)] != key:
                    if held:
                        yield from merge(held)
                    key, held = row[: len(keys)], []
                held.append(row)
        if held:
            yield from merge(held)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), schema)

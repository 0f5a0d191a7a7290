"""Helpers that the training-data operators share: shared tables, Arrow columns, worker caches."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not import this module

#: A word of the contracts: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_own_folder: list[str] = []
#: Spark's setting that deletes shuffle files when their query has ended, instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a temporary folder; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="adinsight-llm-"))
    return _own_folder[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/adinsight-llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, which cuts its lineage.

    The caller may name the path, to :func:`remove` the table when its reader is done. Shuffle files of the write are
    deleted with it.
    """
    spark = df.sparkSession
    path, before = path or new_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(spark: SparkSession) -> None:
    """Delete every table that :func:`written` made for this application."""
    remove(spark, f"{shared_folder(spark)}/adinsight-llm/{spark.sparkContext.applicationId}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: Column | str) -> Column:
    """The text, a null as an empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def packed(docs: DataFrame, text_col: str, id_col: str | None = None) -> DataFrame:
    """``docs`` as (id, text, rest): whatever its columns are called, they can clash with no other name."""
    rest = F.struct(F.lit(True).alias("_"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col])
    return docs.select(F.col(id_col or text_col).alias("id"), F.col(text_col).alias("text"), rest.alias("rest"))


def unpacked(rows: DataFrame, docs: DataFrame, text_col: str) -> list[Column]:
    """The columns of ``docs`` from rows made by :func:`packed`."""
    return [(rows["text"] if c == text_col else rows["rest"][f"c{i}"]).alias(c) for i, c in enumerate(docs.columns)]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def worker_cache(name: str, make: Callable[[], Any], version: object = None) -> Any:
    """``make()``, kept by a Python worker for all its tasks until another name or version is asked for.

    A worker holds one entry in all, so that the stages of a pipeline do not add up in its memory.
    """
    store = sys.modules.setdefault("_adinsight_worker_cache", types.ModuleType("_adinsight_worker_cache")).__dict__
    if "entry" not in store or store["entry"][0] != (name, version):
        store.pop("entry", None)
        store["entry"] = (name, version), make()
    return store["entry"][1]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *drop: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, after which the worker gives free memory back, and its cache if that has a name of ``drop``.

    Workers wait for their next task beside the executor's heap, with all that they hold.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        store = sys.modules.get("_adinsight_worker_cache", types.ModuleType("none")).__dict__
        if drop and "entry" in store and store["entry"][0][0] in drop:
            store.pop("entry")
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return tidied


def binary(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, a null as b""."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in column.to_pylist()]


def groups(items: list, size_of: Callable[[Any], int], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive groups whose sizes add up to about ``most``; a larger item is a group of its own."""
    start, total = 0, 0
    for i, item in enumerate(items):
        total += size_of(item)
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(items):
        yield start, len(items)


class Generations(dict):
    """A memo bounded by bytes: a full generation becomes the old one, and what is asked for again moves to the new one.

    Two generations of ``limit`` bytes are held at most; an entry counts its key, its value if that is text, and the
    table's own share.
    """

    ENTRY = 220

    def __init__(self, make: Callable[[Any], Any], limit: int):
        super().__init__()
        self.make, self.limit, self.held, self.old = make, limit, 0, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if self.held >= self.limit:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += self.ENTRY + (0 if type(key) is int else len(key)) + (len(value) if type(value) is bytes else 0)
        self[key] = value

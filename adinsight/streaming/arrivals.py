"""Load report files as they arrive.

The stream tracks file names only (the content column is pruned away, unless the
headers lie in a store that only Spark opens); each
micro-batch loads its files through the snapshot-replace path, which is
idempotent, so a batch that is retried after a failure changes nothing.

``watch_folder`` serves one client, ``watch_clients`` a folder that holds one folder a
client; the latter keeps the last accepted name of each client and report type as keyed
state in the checkpoint.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from adinsight.sources.report_files import describe_files, headers_of, opens
from adinsight.sources.warehouse import Warehouse, load_files

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
#: A new file counts however old its modification time is; by default those a week older than the newest are ignored.
#: The names seen, some hundred bytes each, are kept by the driver.
FILE_AGE = "36500d"
ACCEPTED = "client_id string, report_type string, file string"


def _local(path: str) -> str:
    """A path without the scheme of the local file system."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _names(spark: SparkSession, folder: str, files_per_batch: int, nested: bool = False, content: bool = False) -> DataFrame:
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.csv")
    files = files.option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", nested).option("maxFileAge", FILE_AGE)
    return files.load(folder).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), *["content"] * content)


def watch_folder(warehouse: Warehouse, client_id: str, folder: str, checkpoint: str,
                 files_per_batch: int = 200) -> StreamingQuery:
    """Start a run that loads all files not seen before and then stops.

    ``checkpoint`` must lie in shared storage.  A batch holds at most
    ``files_per_batch`` names, which is all that reaches the driver.  A file whose
    name comes before the loaded one of its report type is left out, so the last
    by name wins however the files fall into batches.
    """
    stream = _names(warehouse.spark, folder, files_per_batch)

    def load(batch: DataFrame, _: int) -> None:
        names = sorted({r["path"] for r in batch.collect()})  # Spark may list a file twice beside one whose name is a pattern
        if names:
            load_files(warehouse, client_id, names, keep_newer=True)

    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def accept(key: tuple[str, str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The files of a client and report type that do not come before the last accepted name."""
    last = state.get[0] if state.exists else ""
    arrived = sorted(pair for frame in frames for pair in zip(frame["source_file"], frame["file"]))
    fresh = [(name, file) for name, file in arrived if name >= last]
    if fresh:
        state.update((fresh[-1][0],))
        yield pd.DataFrame({"client_id": key[0], "report_type": key[1], "file": [file for _, file in fresh]})


def accepted_files(names: DataFrame, root: str) -> DataFrame:
    """Rows (client_id, report_type, file) of a stream of paths, or of paths and contents, below ``root/<client>/``.

    Files directly in ``root``, and files that are no report, are left out.
    """
    base = _local(root).rstrip("/") + "/"
    below = F.substring("path", len(base) + 1, 1 << 20)
    files = names.filter(F.startswith("path", F.lit(base)) & F.contains(below, F.lit("/"))).withColumnRenamed("path", "file")
    known = describe_files(headers_of(files)).filter(F.col("report_type").isNotNull())
    client = F.substring_index(F.substring("file", len(base) + 1, 1 << 20), "/", 1)
    keyed = known.select(client.alias("client_id"), "report_type", "source_file", "file").groupBy("client_id", "report_type")
    return keyed.applyInPandasWithState(accept, ACCEPTED, "last string", "append", GroupStateTimeout.NoTimeout)


def watch_clients(warehouse: Warehouse, root: str, checkpoint: str, files_per_batch: int = 200) -> StreamingQuery:
    """Start a run that loads all new files of all clients and then stops.

    Each folder in ``root`` is a client.  The state store below ``checkpoint``, in shared
    storage, remembers the last accepted name per client and report type; a file whose name
    comes before it is left out, whichever batch or run it arrives in.  A batch and its state
    are committed together: a batch that is done again finds the earlier state and loads the
    same files, which changes nothing.  The ledger is asked, too, so that a new checkpoint
    does not bring back older files.
    """
    accepted = accepted_files(_names(warehouse.spark, root, files_per_batch, nested=True, content=not opens(root)), root)

    def load(batch: DataFrame, _: int) -> None:
        found = batch.collect()  # at most files_per_batch rows
        for client in sorted({r["client_id"] for r in found}):
            load_files(warehouse, client, sorted({r["file"] for r in found if r["client_id"] == client}), keep_newer=True)

    writer = accepted.writeStream.outputMode("append").foreachBatch(load).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()

"""JSON sink for the sections of a client."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bundle_rows(sections: Mapping[str, DataFrame], client_id: str) -> DataFrame:
    """All sections as (client_id, section, row), the row being a JSON object."""
    parts = [
        df.select(F.lit(client_id).alias("client_id"), F.lit(name).alias("section"),
                  F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
        for name, df in sections.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def write_bundle(sections: Mapping[str, DataFrame], client_id: str, path: str) -> None:
    """One JSON-lines folder per client and section; a re-write replaces its sections."""
    writer = bundle_rows(sections, client_id).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("client_id", "section").text(path)

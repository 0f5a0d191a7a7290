"""Access to fields of records, whatever form they are stored in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_get(df: DataFrame, record: str, key: str) -> Column:
    """The text of a record's field: of a map, a struct, or JSON text; null where it is missing."""
    kind = df.schema[record].dataType
    if isinstance(kind, T.MapType):
        return F.try_element_at(F.col(record), F.lit(key)).cast("string")
    if isinstance(kind, T.StructType):
        return F.col(record).getField(key).cast("string") if key in kind.names else F.lit(None).cast("string")
    if isinstance(kind, T.StringType):
        return F.get_json_object(record, "$['{}']".format(key.replace("'", "\\'")))
    raise TypeError(f"{record} is neither a map, a struct nor text: {kind.simpleString()}")

"""Joins of a large fact table with a lookup whose size is measured first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
_ROW_OVERHEAD = 32


def _width(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value, however nested; NULL has none beyond its place."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(value).cast("long")
    elif isinstance(kind, T.ArrayType):
        flat = isinstance(kind.elementType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))
        size = F.size(value).cast("long") * 8 if flat else F.aggregate(
            value, F.lit(0).cast("long"), lambda total, x: total + _width(x, kind.elementType)
        )
    elif isinstance(kind, T.MapType):
        size = _width(F.map_keys(value), T.ArrayType(kind.keyType)) + _width(F.map_values(value), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        size = sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(0).cast("long"))
    elif isinstance(kind, (T.NumericType, T.BooleanType, T.DatetimeType)):
        return F.lit(16 if isinstance(kind, T.DecimalType) else 8).cast("long")
    else:  # types of learners and the like
        size = F.octet_length(F.to_json(F.struct(value.alias("x")))).cast("long")
    return F.greatest(F.coalesce(size, F.lit(0).cast("long")), F.lit(0).cast("long")) + 16


def measured_bytes(df: DataFrame) -> int:
    """In-memory size of a table: what its texts, binaries and nested values hold, and fixed widths.

    One aggregation.  Run it on a stored table, not on an expensive query.
    """
    width: Column = F.lit(_ROW_OVERHEAD).cast("long")
    for field in df.schema.fields:
        width = width + _width(F.col(f"`{field.name}`"), field.dataType)
    return df.agg(F.sum(width).alias("b")).first()["b"] or 0


def lookup_join(
    facts: DataFrame, lookup: DataFrame, on: list[str], limit_bytes: int = BROADCAST_BYTES, size: int | None = None
) -> DataFrame:
    """Left join of ``facts`` with a keyed lookup.

    The lookup is broadcast only when its size (measured here unless given) is within
    ``limit_bytes``, so the facts are not shuffled.  Beyond it the join shuffles on the
    key, where AQE splits the partitions of hot and of missing keys and replicates their
    few lookup rows.
    """
    if (measured_bytes(lookup) if size is None else size) <= limit_bytes:
        lookup = F.broadcast(lookup)
    return facts.join(lookup, on, "left")

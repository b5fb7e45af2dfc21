"""Missing values: one meaning, NULL, in every column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latelane import schemas as S
from latelane.functions.numbers import nan_to_null

_FLOATING = (T.DoubleType, T.FloatType)


def text_or_null(c: Column, missing: tuple[str, ...] = S.MISSING_TEXTS) -> Column:
    """NULL where the text is one of the spellings of a missing value."""
    return F.when(~c.isin(*missing), c) if missing else c


def normalise_missing(df: DataFrame, missing: tuple[str, ...] = S.MISSING_TEXTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """NULL for NaN in floating columns and for missing-value texts in string columns but ``keep``.

    Spark tells NULL and NaN apart and sorts NaN above every number, so a NaN rate would
    pass ``rate >= bound``.  One projection at the source removes the difference.
    """
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, _FLOATING):
            c = nan_to_null(c)
        elif isinstance(field.dataType, T.StringType) and field.name not in keep:
            c = text_or_null(c, missing)
        columns.append(c.alias(field.name))
    return df.select(*columns)


def typed_columns(schema: T.StructType, date_format: str = "yyyy-MM-dd") -> list[Column]:
    """Text columns cast to ``schema``; a text that does not parse is NULL.

    ``12.0`` is accepted for an integer column.
    """
    columns = []
    for field in schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            c = F.try_to_timestamp(c, F.lit(date_format)).cast("date")
        elif isinstance(field.dataType, T.IntegerType):
            number = c.try_cast("double")
            c = F.when(number == F.floor(number), number).try_cast("int")
        elif not isinstance(field.dataType, T.StringType):
            c = c.try_cast(field.dataType)
        columns.append(c.alias(field.name))
    return columns


def without_gaps(texts: list[Column]) -> Column:
    """The texts that are not NULL, as an array.  The texts differ, so that a set difference, which is compiled, keeps all of them."""
    return F.array_except(F.array(*texts), F.array(F.lit(None).cast("string")))

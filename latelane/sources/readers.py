"""Readers with declared schemas: CSV tables, JSON requests, training logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latelane import schemas as S
from latelane.errors import SourceError
from latelane.sources.cleaning import normalise_missing, text_or_null, typed_columns, without_gaps

BROKEN = "broken_record"


def _text_schema(schema: T.StructType) -> T.StructType:
    """Every field as text, and the whole record where it does not fit."""
    return T.StructType([*(T.StructField(f.name, T.StringType()) for f in schema.fields), T.StructField(BROKEN, T.StringType())])


def _csv_text(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Cells as text.  Quotes inside a quoted cell are doubled and a quoted cell may hold line breaks."""
    reader = spark.read.schema(_text_schema(schema)).option("header", True).option("enforceSchema", False)
    return reader.option("escape", '"').option("multiLine", True).option("columnNameOfCorruptRecord", BROKEN).csv(path)


def _bad_cells(schema: T.StructType) -> list[Column]:
    """Per typed column whether a row's text does not fit the type."""
    return [F.col(f"`{n}`").isNotNull() & F.col(f"typed.{n}").isNull() for n in _typed_names(schema)]


def _typed_names(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if not isinstance(f.dataType, T.StringType)]


def _with_typed(text: DataFrame, schema: T.StructType, date_format: str) -> DataFrame:
    """Cleaned text cells, and the same row cast to its types as ``typed``."""
    names = [f.name for f in schema.fields]
    clean = normalise_missing(text.select(*names, BROKEN), keep=(BROKEN,))
    return clean.withColumn("typed", F.struct(*typed_columns(schema, date_format)))


def read_csv(spark: SparkSession, path: str, schema: T.StructType, date_format: str = "yyyy-MM-dd", strict: bool = False) -> DataFrame:
    """A CSV table with a header, every cell read as text and then cast.

    Reading text first lets ``NA``, ``NaN`` and an empty cell all become NULL whatever
    the column's type.  ``strict`` raises an error that counts the rows with too many or too few
    cells and the cells that do not fit; otherwise use :func:`malformed` to see them.
    """
    if strict:
        _refuse(path, {r["column_name"]: r["malformed_cells"] for r in malformed(spark, path, schema, date_format).collect()})
    both = _with_typed(_csv_text(spark, path, schema), schema, date_format)
    return normalise_missing(both.select("typed.*"))


def _refuse(path: str, counts: dict[str, int]) -> None:
    if bad := {name: n for name, n in counts.items() if n}:
        raise SourceError(f"{path}: " + ", ".join(f"{n} malformed in {name}" for name, n in sorted(bad.items())))


def checked_csv(spark: SparkSession, path: str, schema: T.StructType, date_format: str = "yyyy-MM-dd") -> tuple[DataFrame, Callable[[], None]]:
    """(the table of :func:`read_csv`, a check) for a caller that writes the table: the cells are judged while they are written.

    The check, called after the write, raises the error of a strict reading.  The files are read once.
    """
    seen = Observation()
    both = _with_typed(_csv_text(spark, path, schema), schema, date_format).observe(seen, *_malformed_counts(schema))
    return normalise_missing(both.select("typed.*")), lambda: _refuse(path, seen.get)


def _malformed_counts(schema: T.StructType) -> list[Column]:
    return [
        F.count_if(F.col(BROKEN).isNotNull()).alias("(row)"),
        *[F.count_if(c).alias(n) for n, c in zip(_typed_names(schema), _bad_cells(schema))],
    ]


def malformed(spark: SparkSession, path: str, schema: T.StructType, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Count per column of cells that hold a text which does not fit the column's type; under ``(row)`` the rows of another width."""
    both = _with_typed(_csv_text(spark, path, schema), schema, date_format)
    return both.agg(*_malformed_counts(schema)).unpivot([], ["(row)", *_typed_names(schema)], "column_name", "malformed_cells")


def request_text_schema(extra: T.StructType | None = None) -> T.StructType:
    """What request files are read with: request fields as text, ``extra`` fields as they are, and broken lines."""
    return T.StructType(_text_schema(S.REQUESTS).fields + (extra.fields if extra else []))


def typed_requests(text: DataFrame) -> DataFrame:
    """Request fields cast to their types, with ``type_errors``: a message per value of another type or per broken line.

    A number or truth value given as text is accepted if it reads as one; a broken line keeps its text.
    """
    names = S.REQUESTS.fieldNames()
    clean = text.withColumns({n: text_or_null(F.col(n), ()) for n in names})
    cast = clean.withColumn("typed", F.struct(*typed_columns(S.REQUESTS)))
    kinds = {f.name: f.dataType.simpleString() for f in S.REQUESTS.fields if not isinstance(f.dataType, T.StringType)}
    errors = [F.when(F.col(BROKEN).isNotNull(), F.lit("record: not valid JSON"))]
    errors += [
        F.when(F.col(n).isNotNull() & F.col(f"typed.{n}").isNull(), F.lit(f"{n}: not a valid {kind}")) for n, kind in kinds.items()
    ]
    kept = [c for c in text.columns if c not in names]
    with_errors = cast.withColumn("type_errors", without_gaps(errors))
    return normalise_missing(with_errors.select("typed.*", *kept, "type_errors"), missing=())


def read_requests(spark: SparkSession, path: str, extra: T.StructType | None = None) -> DataFrame:
    """Shipment records, one JSON object per line, with their type errors.  JSON texts are taken as they are."""
    reader = spark.read.schema(request_text_schema(extra)).option("columnNameOfCorruptRecord", BROKEN)
    return typed_requests(reader.json(path))


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """Per-iteration log: tab-separated iteration, macro F1 and loss under a header."""
    return spark.read.schema(S.TRAINING_LOG).option("sep", "\t").option("header", True).csv(path)


def best_iteration(log: DataFrame) -> DataFrame:
    """The iteration with the highest macro F1, the earliest one of a tie, and how far the log ran on."""
    return log.agg(
        F.max_by("iteration", F.struct(F.col("macro_f1"), -F.col("iteration"))).alias("best_iteration"),
        F.max("macro_f1").alias("best_macro_f1"),
        F.max("iteration").alias("last_iteration"),
    ).withColumn("rounds_after_best", F.col("last_iteration") - F.col("best_iteration"))


#: What the multi-task preparation uses of the training frame.
PREPARED_COLUMNS = (
    "quantity", "weight_kg", "value_inr", "gst_rate", "risk_score", *S.REQUEST_TEXT, "will_delay", "delay_days", "delay_reason",
)


def prepared_frame(stored: DataFrame, name: str) -> DataFrame:
    """A stored training frame narrowed to :data:`PREPARED_COLUMNS`; an error if it holds no rows."""
    df = stored.select(*PREPARED_COLUMNS)
    if df.isEmpty():
        raise SourceError(f"training frame {name} holds no rows")
    return df


def read_training_frame(spark: SparkSession, path: str) -> DataFrame:
    """The prepared training frame at a path."""
    return prepared_frame(spark.read.parquet(path), f"at {path}")

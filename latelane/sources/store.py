"""The feature store: Parquet tables under one root, opened by name.

Every save is a numbered version.  A table's log lists the versions that can still be read; each
commit writes the whole log under the next number, a file that may not exist yet, so of two writers
that started from the same version one is told, and then drops the logs before.  A version holds
one table or several that belong together and are replaced together.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latelane import schemas as S
from latelane.errors import SourceError, StoreError
from latelane.sources import folders
from latelane.sources.readers import checked_csv

#: Versions of a table that stay readable.
KEPT_VERSIONS = 5
_ONE = "rows"


class FeatureStore:
    """Named Parquet tables with their last ``kept`` versions.  Nothing is held open and nothing is cached."""

    def __init__(self, spark: SparkSession, root: str, kept: int = KEPT_VERSIONS) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.kept = kept

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _log(self, name: str) -> list[dict]:
        """Entries of the versions that can be read, the oldest first: ``number``, ``at`` (ns), ``path``, ``parts``."""
        for _ in range(5):
            files = folders.names(self.spark, f"{self.path(name)}/log")
            if not files:
                return []
            text = folders.read_text(self.spark, f"{self.path(name)}/log/{max(files)}")
            if text is not None and text.endswith("\n"):
                return json.loads(text)
            time.sleep(0.1)  # a writer has just replaced it
        raise StoreError(f"the log of {name!r} at {self.path(name)} cannot be read")

    def _commit(self, name: str, log: list[dict]) -> None:
        """The log with a new last entry, if no other writer has added that entry's number meanwhile."""
        folder, number = f"{self.path(name)}/log", log[-1]["number"]
        gone, left = log[: -self.kept], log[-self.kept :]
        if not folders.create(self.spark, f"{folder}/{number:012d}.json", json.dumps(left) + "\n"):
            folders.delete(self.spark, log[-1]["path"])
            raise StoreError(f"{name!r} was replaced by another writer (version {number}); nothing was saved")
        for file in folders.names(self.spark, folder):
            if file < f"{number:012d}.json":
                folders.delete(self.spark, f"{folder}/{file}")
        for entry in gone:
            folders.delete(self.spark, entry["path"])

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Replace table ``name`` by ``df`` and return it as stored.

        A table points to the last version that was written whole: a failed write leaves the old one, and a
        table may be rebuilt from itself.  Versions beyond the last ``kept`` are deleted, and so are lost to
        a query that still reads them.  If another writer has saved the table meanwhile, nothing changes and
        the call fails.
        """
        self._save({_ONE: df}, name, partition_by)
        return self.table(name)

    def save_together(self, parts: dict[str, DataFrame], name: str) -> int:
        """Replace the tables ``parts`` of group ``name`` as one version, and return its number; rules as in :meth:`save`."""
        return self._save(parts, name)

    def _save(
        self, parts: dict[str, DataFrame], name: str, partition_by: list[str] | None = None, check: Callable[[], None] | None = None,
    ) -> int:
        """``check`` is called when all is written, before it is a version; if it raises an error, nothing has changed."""
        log = self._log(name)
        number = log[-1]["number"] + 1 if log else 1
        path = f"{self.path(name)}/version={number}-{uuid.uuid4().hex}"
        for part, df in parts.items():
            df.write.partitionBy(*partition_by or []).parquet(f"{path}/{part}")
        if check:
            try:
                check()
            except Exception:
                folders.delete(self.spark, path)
                raise
        self._commit(name, [*log, {"number": number, "at": time.time_ns(), "path": path, "parts": list(parts)}])
        return number

    def save_bucketed(
        self, df: DataFrame, name: str, key: str, buckets: int, finish: Callable[[DataFrame], DataFrame] | None = None
    ) -> DataFrame:
        """Replace catalog table ``name``, bucketed and sorted on ``key``, a file per bucket.

        Two tables with the same buckets on the join key are joined without a shuffle or a sort: the form for the
        shipment and route tables when the join is run again and again.  Rows with one key share a bucket, so
        this is for keys with few rows each; rows without a key match nothing and belong in a table of their own.
        ``finish`` makes the table's columns of the dealt rows, so that what can be computed does not travel; it keeps ``key``
        and shuffles nothing.
        """
        dealt = df.repartition(buckets, key)
        (
            (finish(dealt) if finish else dealt).write.mode("overwrite").format("parquet").option("path", self.path(name))
            .bucketBy(buckets, key).sortBy(key).saveAsTable(name)
        )
        return self.spark.table(name)

    def versions(self, name: str) -> DataFrame:
        """``version``, ``saved_at`` and ``is_last`` of the versions that can be read."""
        log = self._log(name)
        rows = [(e["number"], e["at"] / 1e9, e is log[-1]) for e in log]
        df = self.spark.createDataFrame(rows, "version long, at double, is_last boolean")
        return df.select("version", F.timestamp_seconds("at").alias("saved_at"), "is_last")

    def _entry(self, name: str, version: int | None) -> dict:
        log = self._log(name)
        found = [e for e in log if version is None or e["number"] == version]
        if not found:
            which = "" if version is None else f" version {version}"
            raise StoreError(f"no table {name!r}{which} at {self.path(name)}")
        return found[-1]

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """The last version of a table, or an older one that is still kept."""
        return self.spark.read.parquet(f"{self._entry(name, version)['path']}/{_ONE}")

    def together(self, name: str, version: int | None = None) -> tuple[int, dict[str, DataFrame]]:
        """(version, tables) of a group: all of one version."""
        entry = self._entry(name, version)
        return entry["number"], {p: self.spark.read.parquet(f"{entry['path']}/{p}") for p in entry["parts"]}

    def load_raw_tables(self, primary: str, vendors: str, routes: str, date_format: str = "yyyy-MM-dd") -> None:
        """Read the three CSV files and replace the three store tables.  Malformed rows or cells are an error."""
        for name, path in zip(S.STORE_TABLES, (primary, vendors, routes)):
            try:
                table, check = checked_csv(self.spark, path, S.STORE_TABLES[name], date_format)
                self._save({_ONE: table}, name, check=check)
            except SourceError:
                raise
            except Exception as exc:
                raise SourceError(f"could not load {name} from {path}") from exc

    def register(self, *names: str) -> None:
        """Expose stored tables to SQL under their own names."""
        for name in names or S.STORE_TABLES:
            self.table(name).createOrReplaceTempView(name)

    def health(self) -> DataFrame:
        return health(*(self.table(n) for n in S.STORE_TABLES))

    def is_healthy(self) -> bool:
        return self.health().first()["healthy"]


def row_count(df: DataFrame) -> "F.Column":
    """Row count of ``df`` as a scalar subquery."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def health(primary: DataFrame, vendors: DataFrame, routes: DataFrame) -> DataFrame:
    """One row: the three row counts and whether all are above zero."""
    counts = primary.agg(F.count(F.lit(1)).alias("primary_rows")).select(
        "primary_rows", row_count(vendors).alias("vendor_rows"), row_count(routes).alias("route_rows")
    )
    return counts.withColumn(
        "healthy", (F.col("primary_rows") > 0) & (F.col("vendor_rows") > 0) & (F.col("route_rows") > 0)
    )


def lookup_health(vendor_lookup: DataFrame, route_lookup: DataFrame) -> DataFrame:
    """One row: sizes of the two lookups and the service status they allow."""
    sizes = vendor_lookup.agg(F.count(F.lit(1)).alias("vendor_count")).select(
        "vendor_count", row_count(route_lookup).alias("route_count")
    )
    ready = (F.col("vendor_count") > 0) & (F.col("route_count") > 0)
    return sizes.select(
        F.when(ready, "healthy").otherwise("unhealthy").alias("status"), ready.alias("enrichment_enabled"),
        "vendor_count", "route_count",
    )


def describe(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, filled and missing cells."""
    spark = df.sparkSession
    names = df.columns
    counted = df.agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count(F.col(f"`{n}`")).alias(n) for n in names]
    ).unpivot(["__rows"], names, "column_name", "filled")
    types = spark.createDataFrame(
        [(i, n, t) for i, (n, t) in enumerate(df.dtypes)], "position long, column_name string, column_type string"
    )
    return (
        counted.join(F.broadcast(types), "column_name")
        .select("position", "column_name", "column_type", "filled", (F.col("__rows") - F.col("filled")).alias("missing"))
    )


def preview(df: DataFrame, order_by: list[str], n: int = 3) -> DataFrame:
    """First ``n`` rows in a stated order."""
    return df.orderBy(*order_by).limit(n)


def list_tables(spark: SparkSession) -> list[str]:
    """Names of the tables and views SQL can see."""
    return sorted(t.name for t in spark.catalog.listTables())

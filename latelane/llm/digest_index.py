"""Exact dedup against a persistent digest index.

The index is a table of (digest, keep_id, batch), bucketed and sorted by digest, that stays where it
was made and is opened again by its path.  A batch is reduced to one row per digest, sort-merge
anti-joined with the index, and only unseen digests are appended.  All of it is DataFrame work; texts
are read once and never shuffled.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latelane.errors import StoreError
from latelane.llm.common import normalised, unused, without
from latelane.session import materialise, new_path
from latelane.sources import folders

#: A file beside the folder of the rows that says how they are bucketed.
_ABOUT, _ROWS = "digest_index.json", "rows"


def digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of a text whose runs of white space count as one blank; null counts as empty."""
    return F.sha2(normalised(text), 256)


class DigestIndex:
    """The digests seen so far, in the shared workspace or at ``path``.

    A path that holds an index is opened with all it holds, in this session or a later one, and keeps its
    buckets; at a new path an empty one is made.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or new_path(spark, "digest_index")
        about = folders.read_text(spark, f"{self.path}/{_ABOUT}") if path else None
        if about:
            self.buckets = json.loads(about)["buckets"]
        elif folders.names(spark, self.path):
            raise StoreError(f"{self.path} holds files but no digest index")
        else:
            # As many buckets as shuffle partitions: the batch's reduced rows then meet the index without another shuffle.
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            folders.create(spark, f"{self.path}/{_ABOUT}", json.dumps({"buckets": self.buckets}))
        # The catalog of a session only names the files: the table is declared over them and nothing is written.
        self.table = f"digests_{uuid.uuid4().hex}"
        place = f"{self.path}/{_ROWS}".replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )

    @staticmethod
    def open(spark: SparkSession, path: str) -> DigestIndex:
        """The index at a path, which must be there."""
        if folders.read_text(spark, f"{path}/{_ABOUT}") is None:
            raise StoreError(f"no digest index at {path}")
        return DigestIndex(spark, path)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def _append(self, unseen: DataFrame, batch: str) -> None:
        rows = unseen.select("digest", "keep_id", F.lit(batch).alias("batch"))
        writer = rows.write.format("parquet").option("path", f"{self.path}/{_ROWS}").bucketBy(self.buckets, "digest").sortBy("digest")
        writer.mode("append").saveAsTable(self.table)

    def deduplicate(self, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Match a batch with the index and add its unseen digests.

        One row per input row: ``key``, ``keep_id`` (key of the row that stays, from this batch
        or an earlier one), ``group_size`` (rows of this batch with that text), ``kept`` (this row
        is the one that stays), ``text_sha256``.  Of equal texts in a batch the smallest key stays;
        a null key is larger than all others.  Rows that repeat key and text are told apart by
        their place in the written batch, so exactly one of them is kept.  Null and empty texts
        are equal.  Other columns, whatever their names, are not read.

        A batch is known by its keys and texts.  The same batch given again, for instance because a job failed before
        it had used the result, has the same result and changes nothing.
        """
        batch = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.unhex(digest(F.col(f"`{text}`"))).alias("digest"))
        batch = materialise(batch.withColumn("at", F.monotonically_increasing_id()), "digests")
        groups = batch.groupBy("digest").agg(
            F.min(F.struct(F.col("k").isNull().alias("no_key"), "k", "at")).alias("first"),
            F.count(F.lit(1)).alias("group_size"),
        )
        groups = materialise(groups, "digest_groups")
        mark = batch.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(k, digest))"), F.expr("bit_xor(hash(digest, k))")).first()
        name = "-".join(str(x) for x in mark)
        again = not self.rows().filter(F.col("batch") == name).isEmpty()
        seen = self.rows().filter(F.col("batch") != name) if again else self.rows()
        unseen = groups.hint("merge").join(seen.select("digest").hint("merge"), "digest", "left_anti")
        unseen = materialise(unseen.select("digest", F.col("first.k").alias("keep_id")), "digests_unseen")
        # Earlier batches' rows stay; of this batch's only the first row of an unseen digest.
        old = seen.join(groups.select("digest"), "digest").select("digest", "keep_id", F.lit(False).alias("new"))
        known = materialise(
            groups.join(old.unionByName(unseen.withColumn("new", F.lit(True))), "digest").select(
                "digest", "keep_id", "group_size", F.when(F.col("new"), F.col("first.at")).alias("kept_at")
            ), "digests_known",
        )
        if not again:  # an append is written whole or not at all
            self._append(unseen, name)
        # Both sides are shuffled for this join, so AQE splits the partitions of a hot digest.
        return batch.join(known, "digest").select(
            F.col("k").alias(key), "keep_id", "group_size",
            F.coalesce(F.col("at") == F.col("kept_at"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )

    def keep_first(self, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """The rows of ``df``, all columns, without copies of earlier ones; rules as in :meth:`deduplicate`."""
        found = materialise(self.deduplicate(df, key, text).select(F.col(f"`{key}`").alias("key"), "text_sha256", "kept"), "copies")
        kept = found.filter("kept").select(F.col("key").alias("k"), F.col("text_sha256").alias("h"))
        gone = found.filter("not kept").select("key", "text_sha256").distinct()
        same = F.col("key").eqNullSafe(F.col("k")) & (F.col("text_sha256") == F.col("h"))
        sha, = unused(df.columns, "__sha256")
        others = gone.join(kept, same, "left_anti").select(F.col("key").alias(key), F.col("text_sha256").alias(sha))
        left = without(df.withColumn(sha, digest(F.col(f"`{text}`"))), materialise(others, "copies_gone"), [key, sha])
        # Rows that repeat both key and text: none is gone by its key, so one of them is kept here.
        if not gone.join(kept, same, "left_semi").isEmpty():
            left = left.dropDuplicates([key, sha])
        return left.drop(sha)

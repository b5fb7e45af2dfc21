"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a row's hash.  A bucket splits on its next
bit only while it holds more bytes than a shard may have, so small and large regions of
the hash space end at different depths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latelane.llm.common import unused
from latelane.session import materialise, new_path

#: Bits decided per pass: a pass groups rows into 2^20 cells at most, the largest directory kept in one table.
STEP = 20
#: Bits of a key's hash: 15 hexadecimal digits of its MD5.  Rows beyond are told apart by their place.
HASH_BITS = 60


def key_bits(key: Column) -> Column:
    """The first 60 bits of the MD5 of a key's text; a null key counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _matched(rows: DataFrame, cells: DataFrame, on: list[str]) -> DataFrame:
    """An inner join that sorts and merges, whatever the files' sizes: a table that packs well, or has a row for each of 21 depths,
    is far larger in memory than they tell, and the driver would hold it whole."""
    return rows.join(cells.hint("merge"), on)


def _leaves(cells: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Of ``cells`` (``region``, ``cell``: 20 bits, bytes, docs): the leaf of each cell, and the cells that must split on."""
    levels = cells.select(
        "region", F.explode(F.sequence(F.lit(0), F.lit(STEP))).alias("d"), "cell", "bytes", "docs"
    ).withColumn("prefix", F.expr(f"shiftright(cell, {STEP} - d)"))
    sums = materialise(
        levels.groupBy("region", "d", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs")),
        "directory",
    )
    whole = (F.col("bytes") <= limit) | (F.col("docs") == 1)
    parents = sums.filter(~whole).select("region", (F.col("d") + 1).alias("d"), F.col("prefix").alias("up"))
    below = _matched(sums.withColumn("up", F.expr("shiftright(prefix, 1)")), parents, ["region", "d", "up"])
    leaf = sums.filter("d = 0").unionByName(below.select(*sums.columns)).filter(whole)
    at_cell = cells.select(
        "region", "cell", F.explode(F.sequence(F.lit(0), F.lit(STEP))).alias("d")
    ).withColumn("prefix", F.expr(f"shiftright(cell, {STEP} - d)"))
    placed = _matched(at_cell, leaf, ["region", "d", "prefix"])
    return placed, sums.filter((F.col("d") == STEP) & ~whole).select("region", F.col("prefix").alias("cell"))


def assign(df: DataFrame, limit: int, key: str = "doc_id", text: str = "text", place: str | None = None) -> DataFrame:
    """The shard of every row: ``key``, ``n_bytes``, ``shard`` (bits), ``depth``, ``shard_bytes``, ``shard_docs``, ``oversized``.

    ``shard`` is the text of the leading bits ('' when one shard holds all).  A shard has at
    most ``limit`` bytes, or is one row of more than that (``oversized``).  A row's bytes are
    its text's in UTF-8; null has none.  Rows with the same key share all 60 bits; when they
    exceed a shard, splitting goes on over the bits of their place in the written table, so
    even one key with a third of all rows ends in small shards.  An empty table has no shards.
    ``place`` names a column of a stored ``df`` that tells its rows apart; it is then returned as well.
    """
    at = F.col(f"`{place}`") if place else F.monotonically_increasing_id()
    rows = df.select(
        F.col(f"`{key}`").alias("k"), F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("n_bytes"),
        key_bits(F.col(f"`{key}`")).alias("bits"), at.alias("at"),
    )
    rows = materialise(rows.withColumn("region", F.lit("")), "shard_rows")
    done, used = [], 0
    while True:
        if used == HASH_BITS:  # equal keys only: their places give the further bits
            rows = rows.withColumn("bits", F.expr(f"shiftrightunsigned(xxhash64(at, {used}), {64 - HASH_BITS})"))
        left = HASH_BITS - STEP - used % HASH_BITS
        rows = rows.withColumn("cell", F.expr(f"shiftright(bits, {left}) & {(1 << STEP) - 1}"))
        cells = rows.groupBy("region", "cell").agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"))
        leaves, full = _leaves(materialise(cells, "shard_cells"), limit)
        bits = F.when(F.col("d") > 0, F.lpad(F.bin("prefix"), F.col("d"), F.lit("0"))).otherwise("")
        done.append(_matched(rows, leaves, ["region", "cell"]).select(
            F.col("k").alias(key), "n_bytes", F.concat("region", bits).alias("shard"), (F.col("d") + used).alias("depth"),
            F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"), (F.col("bytes") > limit).alias("oversized"),
            *([F.col("at").alias(place)] if place else []),
        ))
        full = materialise(full, "shard_splits")
        if full.isEmpty():
            break
        used += STEP
        rows = materialise(
            _matched(rows, full, ["region", "cell"]).select(
                "k", "n_bytes", "bits", "at",
                F.concat("region", F.lpad(F.bin("cell"), F.lit(STEP), F.lit("0"))).alias("region"),
            ), "shard_rows",
        )
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def write_shards(df: DataFrame, limit: int, path: str | None = None, key: str = "doc_id", text: str = "text") -> str:
    """Write every row of ``df`` once, into one folder per shard (``shard=``, with underscores before it if ``df`` has such a
    column); returns the path.  Keys may repeat or be null."""
    path = path or new_path(df.sparkSession, "shards")
    place, shard = unused(df.columns, "place", "shard")
    stored = materialise(df.withColumn(place, F.monotonically_increasing_id()), "shard_input")
    shards = materialise(assign(stored, limit, key, text, place).select(F.col(place), F.col("shard").alias(shard)), "shard_of")
    placed = stored.join(shards, place).drop(place)
    placed.repartition(F.col(shard)).write.partitionBy(shard).parquet(path)
    return path

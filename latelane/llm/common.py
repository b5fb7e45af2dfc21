"""Helpers shared by the text operators: bounded broadcasts, packed long arrays, connected components."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latelane.operators.joins import measured_bytes
from latelane.session import materialise

#: Keys of this many bytes at most are broadcast; more are joined by a shuffle.
KEYS_BYTES = 32 * 1024 * 1024

#: The white space of every contract: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(columns: list[str], *names: str) -> list[str]:
    """Each name, with underscores added until no column has it, whatever the case of its letters."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def normalised(text: Column) -> Column:
    """A text with each run of white space replaced by one blank; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def small(keys: DataFrame, limit: int = KEYS_BYTES) -> DataFrame:
    """``keys``, to be broadcast only when its measured size is within ``limit``.  Pass a stored table."""
    return F.broadcast(keys) if measured_bytes(keys) <= limit else keys


def without(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose ``on`` is not in the stored table ``keys``.  A null key matches a null key."""
    names = unused(df.columns, *[f"__{c}" for c in on])
    renamed = keys.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(on, names)])
    same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`{n}`")) for c, n in zip(on, names)])
    return df.join(small(renamed), same, "left_anti")


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the ``n + 1`` offsets of a string or binary column; a null is empty.  No copy per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, ends - ends[0]


def joined(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers packed into a binary column, row after row."""
    return text_buffers(column)[0].view(kind)


def slices(batches, rows: int = 256):
    """Batches of few rows: what a worker holds beside the batch it was sent."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)


def pieces(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes each; one row of more bytes is a range of its own."""
    found, start, n = [], 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
        found.append((start, min(end, n)))
        start = found[-1][1]
    return found


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over all output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE, _powers, _inverses = 0x9E3779B97F4A7C15, np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = n + (n >> 2)
        _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _BASE, np.uint64), dtype=np.uint64)])
        back = np.uint64(pow(_BASE, -1, 1 << 64))
        _inverses = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, back, np.uint64), dtype=np.uint64)])
    return _powers, _inverses


#: A random 64-bit value for each byte: the hashes' alphabet.
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which :func:`range_hashes` gets the hash of any range of ``data``."""
    powers, _ = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * powers[: len(data)], out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of bytes: equal ranges have equal hashes, wherever they stand."""
    _, inverses = _power_table(len(sums))
    return mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges`` (``a``, ``b``, long): ``node``, ``component`` (smallest node), for nodes with an edge.

    Alternating star contraction: every round hooks each node's neighbours to its smallest
    neighbour.  Minima are combined before the shuffle, and the joins are plain shuffle joins
    whose hot nodes AQE splits.  Each round is written, so no lineage grows; the rounds end
    when the edges stay as they are.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = materialise(e, f"{name}_edges"), None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if mark == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = mark
        if not mark[0]:
            continue
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        hooked = large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(
            hooked.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), f"{name}_round"
        )

"""Near-duplicate vectors by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform and hashed to
the nearest corner of the cross-polytope, that is its largest coordinate with its sign.  A table
joins several such hashes; as the rows grow, more hashes are joined, so that buckets stay small.
Each vector lies in its own bucket of every table and looks into the neighbouring ones that its
next-largest coordinates name.  Every pair found is verified by its exact cosine and counted in
the first table that finds it, so tasks return counts and spanning links, never lists of pairs.
Equal vectors are one class from the start.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latelane.llm.common import components
from latelane.session import materialise

TABLES, PROBES = 10, 6
#: A bucket of more rows is split, and pairs of its parts are compared in tasks of their own.
BUCKET = 4096
#: Rows of a bucket compared with the others at a time.
STRIPE = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows of ``x`` (a power of two columns), of unchanged length."""
    n, width, h = *x.shape, 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, width)
        h *= 2
    return x / math.sqrt(width)


def joined_hashes(rows: int, dim: int) -> int:
    """Hashes per table, two at least: enough buckets that 32 unrelated rows share one."""
    corners = 2 << (dim - 1).bit_length() if dim > 1 else 2
    return max(2, math.ceil(math.log(max(rows / 32, 2)) / math.log(max(corners, 4))))


def codes(x: np.ndarray, per_table: int, seed: int) -> np.ndarray:
    """Bucket codes, (rows, TABLES, PROBES): the own bucket first, then neighbours by what they give up."""
    n, dim = x.shape
    width = 1 << (dim - 1).bit_length() if dim > 1 else 1
    padded = np.zeros((n, width))
    padded[:, :dim] = x
    rng = np.random.default_rng([seed, dim])
    out = np.zeros((n, TABLES, PROBES), np.uint32)
    row = np.arange(n)
    for t in range(TABLES):
        corner, value = [], []
        for _ in range(per_table):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            depth = min(4, width)
            top = np.argpartition(-np.abs(y), depth - 1, axis=1)[:, :depth]
            top = np.take_along_axis(top, np.argsort(-np.abs(np.take_along_axis(y, top, 1)), axis=1, kind="stable"), 1)
            best = np.take_along_axis(y, top, 1)
            corner.append(top * 2 + (best < 0))
            value.append(np.abs(best))
        choice, cost = [np.zeros((n, per_table), np.int64)], [np.zeros(n)]
        for h in range(per_table):  # one hash moved on to its next corners
            for step in range(1, corner[h].shape[1]):
                moved = np.zeros((n, per_table), np.int64)
                moved[:, h] = step
                choice.append(moved)
                cost.append((value[h][:, 0] - value[h][:, step]) ** 2)
        for h in range(per_table):  # two hashes moved on
            for g in range(h):
                if corner[h].shape[1] > 1 and corner[g].shape[1] > 1:
                    moved = np.zeros((n, per_table), np.int64)
                    moved[:, [g, h]] = 1
                    choice.append(moved)
                    cost.append(sum((value[k][:, 0] - value[k][:, 1]) ** 2 for k in (g, h)))
        order = np.argsort(np.stack(cost, 1), axis=1, kind="stable")[:, :PROBES]
        steps = np.stack(choice, 1)
        for p in range(PROBES):
            pick = steps[row, order[:, min(p, order.shape[1] - 1)]]
            code = np.full(n, t + 1, np.uint64)
            for h in range(per_table):
                code = code * np.uint64(2 * width + 1) + corner[h][row, pick[:, h]].astype(np.uint64)
            code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out[:, t, p] = (code >> np.uint64(32)).astype(np.uint32)
    return out


def _usable(values) -> np.ndarray | None:
    """The vector in double precision, or None if it links with nothing."""
    if values is None or not len(values) or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64)
    return x if np.isfinite(x).all() and x.any() else None


def _classes(batches):
    """(id, class of equal vectors, dimension, vector in double precision)."""
    for batch in batches:
        out = [], [], []
        for values in batch.column("v").to_pylist():
            x = _usable(values)
            if x is None:
                for column in out:
                    column.append(None)
            else:
                raw = (x + 0.0).tobytes()  # -0.0 is 0.0
                name = hashlib.blake2b(raw, digest_size=8).digest()
                for column, value in zip(out, (int.from_bytes(name, "little", signed=True), len(x), raw)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column("k"), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.binary())))],
            names=["k", "cls", "dim", "vector"],
        )


def _hashed(rows: int, seed: int):
    """Classes with their vectors of length one and all their bucket codes."""

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = np.frombuffer(b"".join(part.column("vector").to_pylist()), np.float64).reshape(-1, dim)
                x = x / np.abs(x).max(1, keepdims=True)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                found = codes(unit, joined_hashes(rows, int(dim)), seed)
                yield pa.RecordBatch.from_arrays([
                    part.column("cls"), part.column("dim"), part.column("copies"),
                    pa.array([r.tobytes() for r in unit], pa.binary()), pa.array([r.tobytes() for r in found], pa.binary()),
                ], names=["cls", "dim", "copies", "unit", "codes"])

    return run


def _entries(batches):
    """A row for each bucket that a vector lies in or looks into, without the vector."""
    for batch in batches:
        n, every = len(batch), np.arange(TABLES * PROBES)
        flat = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint32)
        table, probe = np.tile(every // PROBES, n), np.tile(every % PROBES, n)
        dims = np.repeat(batch.column("dim").to_numpy().astype(np.int64), len(every))
        bucket = (dims << 40) + (table.astype(np.int64) << 32) + flat
        # Probes of one table may name one bucket twice; the first stands for both.
        per_table = flat.reshape(-1, PROBES)
        fresh = np.stack([(per_table[:, :p] != per_table[:, p : p + 1]).all(1) for p in range(PROBES)], 1).ravel()
        take = pa.array(np.repeat(np.arange(n), len(every))[fresh])
        yield pa.RecordBatch.from_arrays(
            [pa.array(bucket[fresh]), pa.array((probe == 0)[fresh]), batch.column("cls").take(take)], names=["bucket", "own", "cls"]
        )


def _earlier(a: np.ndarray, b: np.ndarray, table: int, bucket: np.uint32, mutual: np.ndarray) -> np.ndarray:
    """Of pairs with codes ``a`` (looking) and ``b`` (lying here): whether another bucket counts them."""
    seen = np.zeros(len(a), bool)
    for t in range(table):
        seen |= (a[:, t] == b[:, t, :1]).any(1) | (b[:, t] == a[:, t, :1]).any(1)
    # In this table: both may look into each other's bucket; the smaller bucket counts.
    back = (b[:, table] == a[:, table, :1]).any(1)
    return seen | (~mutual & back & (a[:, table, 0] < bucket))


def _compared(threshold: float):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        table, code = (key[0].as_py() >> 32) & 0xFF, np.uint32(key[0].as_py() & 0xFFFFFFFF)
        group = group.sort_by("cls")
        cls, copies = group["cls"].to_numpy(), group["copies"].to_numpy()
        own, side = group["own"].to_numpy(), group["side"].to_numpy()
        unit = np.frombuffer(b"".join(group["unit"].to_pylist()), np.float64).reshape(len(cls), -1)
        found = np.frombuffer(b"".join(group["codes"].to_pylist()), np.uint32).reshape(len(cls), TABLES, PROBES)
        here = np.flatnonzero(own & (side != 1))
        look = np.flatnonzero(side != 2)
        links, parent = np.zeros(len(cls), np.int64), {}

        def root(i):
            while parent.get(i, i) != i:
                parent[i] = parent.get(parent[i], parent[i])
                i = parent[i]
            return i

        edges = []
        for a in range(0, len(look), STRIPE):
            rows = look[a : a + STRIPE]
            i, j = np.nonzero(unit[rows] @ unit[here].T >= threshold)
            i, j = rows[i], here[j]
            # Both lie here: once.  A vector looks at its own class only by lying here.
            once = np.where(own[i], cls[i] < cls[j], cls[i] != cls[j])
            i, j = i[once], j[once]
            fresh = ~_earlier(found[i], found[j], table, code, own[i])
            i, j = i[fresh], j[fresh]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            for x, y in zip(i.tolist(), j.tolist()):
                p, q = root(x), root(y)
                if p != q:
                    parent[q] = p
                    edges.append((x, y))
        some = np.flatnonzero(links)
        left, right = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        return pa.table({
            "a": pa.array(np.concatenate([cls[some], cls[left]])), "n": pa.array(np.concatenate([links[some], np.zeros(len(left), np.int64)])),
            "b": pa.array([None] * len(some) + cls[right].tolist(), pa.int64()),
        })

    return run


def near_duplicates(
    df: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding", seed: int = 11
) -> DataFrame:
    """Links between vectors with a cosine of ``threshold`` or more: ``key``, ``n_links``, ``component_id``, ``kept``.

    One row per input row.  ``n_links`` counts the other rows linked directly, ``component_id`` is
    the smallest key reachable by links, itself included, and ``kept`` says that it is the key.
    A vector that is null, empty, all zero or has a null or non-finite component links with nothing; so
    do vectors of different dimensions.  Equal vectors always link, however many.  Rows that repeat
    a key are rows of their own; a null key has no component of its own and is never kept.  An
    empty table gives no rows.  Other columns are not read.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{vector}`").alias("v"))
    rows = materialise(rows.mapInArrow(_classes, "k long, cls long, dim int, vector binary"), "vectors")
    classes = rows.filter("cls is not null").groupBy("cls").agg(
        F.first("dim").alias("dim"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies")
    )
    classes = materialise(classes, "vector_classes")
    classes = materialise(classes.mapInArrow(
        _hashed(classes.count(), seed), "cls long, dim int, copies long, unit binary, codes binary"
    ), "vector_codes")
    entries = classes.mapInArrow(_entries, "bucket long, own boolean, cls long")
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.bool_or("own").alias("lies"))
    shared = sizes.filter("rows > 1 and lies").withColumn("parts", F.expr(f"cast(ceil(rows / {BUCKET}) as int)"))
    placed = entries.join(shared.select("bucket", "parts"), "bucket")
    # Part i looks into part j in task (i, j); in task (i, i) a part is compared with itself.
    part = F.expr("cast(pmod(xxhash64(cls), parts) as int)")
    cells = placed.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    looks = cells.select("*", F.col("part").alias("i"), F.col("other").alias("j"), F.when(
        F.col("part") == F.col("other"), 0).otherwise(1).alias("side"))
    lies = cells.filter("own and part <> other").select(
        "*", F.col("other").alias("i"), F.col("part").alias("j"), F.lit(2).alias("side"))
    found = looks.unionByName(lies).drop("parts", "part", "other").join(classes.drop("dim"), "cls")
    found = found.groupBy("bucket", "i", "j").applyInArrow(_compared(threshold), "a long, n long, b long")
    found = materialise(found, "vector_links")
    linked = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    groups = components(found.filter("b is not null").select("a", "b"), "vector_groups")
    named = classes.select("cls", "copies").join(linked, F.col("cls") == F.col("a"), "left").join(
        groups, F.col("cls") == F.col("node"), "left"
    ).select("cls", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("g"))
    named = materialise(rows.select("k", "cls").join(named, "cls", "left"), "vector_groups")
    least = materialise(named.filter("g is not null").groupBy("g").agg(F.min("k").alias("component_id")), "vector_least")
    return named.join(least, "g", "left").select(
        F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "k").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("component_id") == F.col(key), F.lit(False)))

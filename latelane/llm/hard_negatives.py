"""Hard negatives by exact integer scores, computed in a residue number system.

Vectors of whole numbers are multiplied modulo a few small primes, each product as one float32
matrix product: residues lie around zero and are so small that no sum leaves the 24 bits that
float32 holds exactly.  Chinese remaindering puts the residues together to the signed score.

Anchors are a stated set of rows and are scored with all rows in blocks.  A first pass finds each
anchor's best rows of its own label, a second one the best rows of other labels whose score lies
in the window that each positive sets.  Tasks return only what can be among the first few.
"""

from __future__ import annotations

from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latelane.errors import ScoringError
from latelane.session import materialise

#: Bytes of anchors' numbers held by the driver and each worker; more anchors are answered in further passes.
ANCHOR_BYTES = 16 * 1024 * 1024
#: Rows and anchors whose scores are computed at once.
BLOCK_ROWS, BLOCK_ANCHORS = 4096, 512
#: Components multiplied before residues are reduced again.
STRIP = 1024
#: Every whole number up to here is a float32.
_FLOAT32_EXACT = 1 << 24
_NONE = np.iinfo(np.int64).min


def moduli(bound: int, width: int) -> list[int]:
    """Descending primes whose product exceeds ``2 * bound`` and whose products of ``width`` residues stay exact in float32."""
    found, product, p = [], 1, 2 * isqrt(_FLOAT32_EXACT // max(width, 1)) + 1
    while product <= 2 * bound:
        if p < 3:
            raise ScoringError("scores are too large for the residue system")
        if all(p % q for q in range(2, isqrt(p) + 1)):
            found.append(p)
            product *= p
        p -= 1
    return found


def residues(numbers: np.ndarray, prime: int) -> np.ndarray:
    """Residues between ``-(prime // 2)`` and ``prime // 2``, as float32."""
    r = numbers % prime
    return np.where(r > prime // 2, r - prime, r).astype(np.float32)


def exact_products(a: np.ndarray, b: np.ndarray, primes: list[int]) -> np.ndarray:
    """``a @ b.T`` of int64 matrices, exactly, given that no product exceeds half the product of ``primes``."""
    value, product = np.zeros((len(a), len(b)), np.int64), 1
    for p in primes:
        r = np.zeros(value.shape, np.int64)
        for start in range(0, a.shape[1], STRIP):
            cut = slice(start, start + STRIP)
            r += (residues(a[:, cut], p) @ residues(b[:, cut], p).T).astype(np.int64)
        # The next digit, around zero like the residues: the signed value needs no last correction.
        digit = (r - value) % p * pow(product, -1, p) % p if product > 1 else r % p
        value += product * np.where(digit > p // 2, digit - p, digit)
        product *= p
    return value


def _leading(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of entries among the ``k`` largest of their row, ties included; ``_NONE`` entries never."""
    if scores.shape[1] > k:
        least = np.partition(scores, -k, axis=1)[:, -k]
        return np.nonzero((scores >= least[:, None]) & (scores != _NONE))
    return np.nonzero(scores != _NONE)


class _Kept:
    """The first ``k`` (score descending, id, place) of each group, over the blocks of a task."""

    def __init__(self, groups: int, k: int):
        self.k, self.held, self.waiting = k, [np.zeros(0, np.int64)] * 5, []
        self.least = np.full(groups, _NONE, np.int64)  # a score below this is not among the first k

    def add(self, group, score, ids, missing, place) -> None:
        ok = score >= self.least[group]
        self.waiting.append([x[ok] for x in (group, score, ids, missing, place)])
        if sum(len(x[0]) for x in self.waiting) > 200_000:
            self.settle()

    def settle(self) -> list[np.ndarray]:
        group, score, ids, missing, place = (np.concatenate(x) for x in zip(self.held, *self.waiting))
        order = np.lexsort((place, ids, missing, -score, group))
        ordered = [x[order] for x in (group, score, ids, missing, place)]
        rank = np.arange(len(order)) - np.searchsorted(ordered[0], ordered[0])
        last = rank == self.k - 1
        self.least[ordered[0][last]] = ordered[1][last]
        self.held, self.waiting = [x[rank < self.k] for x in ordered], []
        return self.held


def _numbers(column) -> tuple[np.ndarray, np.ndarray]:
    """(flat int64 numbers, offsets) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets - offsets[0]


class Rows:
    """Vectors with their ids and labels, as matrices by length: those of one length are multiplied together."""

    def __init__(self, table):
        self.place, self.label = table.column("place").to_numpy(), table.column("label").to_numpy()
        column = table.column("vec_id")
        self.missing, self.ids = np.asarray(column.is_null()), column.fill_null(0).to_numpy()
        flat, offsets = _numbers(table.column("numbers"))
        lengths = np.diff(offsets)
        self.parts = []
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            # In the order of ids, so that the first of equal scores is the one with the smallest id.
            at = at[np.lexsort((self.place[at], self.ids[at], self.missing[at]))]
            self.parts.append((at, flat[offsets[at][:, None] + np.arange(n)]))


def _passes(rows: DataFrame, anchors: Rows, primes: list[int], groups: int, k: int, wanted) -> DataFrame:
    """Each task's first ``k`` rows per group.  ``wanted(scores, anchors' rows, other labels, other places)`` yields
    (group per anchor, scores with ``_NONE`` where a row does not count)."""

    def score(batches):
        kept = _Kept(groups, k)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                block = Rows(batch.slice(start, BLOCK_ROWS))
                for at, matrix in block.parts:
                    for mine, own in anchors.parts:
                        n = min(matrix.shape[1], own.shape[1])
                        for a in range(0, len(mine), BLOCK_ANCHORS):
                            some = mine[a : a + BLOCK_ANCHORS]
                            scores = exact_products(own[a : a + BLOCK_ANCHORS, :n], matrix[:, :n], primes)
                            for group, masked in wanted(scores, some, block.label[at], block.place[at]):
                                i, j = _leading(masked, k)
                                kept.add(group[i], masked[i, j], block.ids[at[j]], block.missing[at[j]], block.place[at[j]])
        group, found, ids, missing, place = kept.settle()
        for a in range(0, len(group), 100_000):
            cut = slice(a, a + 100_000)
            yield pa.RecordBatch.from_arrays([
                pa.array(group[cut], pa.int64()), pa.array(found[cut], pa.int64()),
                pa.array(ids[cut], pa.int64(), mask=missing[cut].astype(bool)), pa.array(place[cut], pa.int64()),
            ], ["group", "score", "vec_id", "place"])

    found = rows.mapInArrow(score, "group long, score long, vec_id long, place long")
    order = Window.partitionBy("group").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "place")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def prepared(df: DataFrame, label: Column) -> tuple[DataFrame, int, int]:
    """Rows that take part, with their place, label and whole numbers ``floor(256 * x)``, stored and evenly dealt out; a bound
    of all scores; the longest vector's length."""
    spark = df.sparkSession
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    rows = df.select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    ).filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound)
    squared = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + F.pow(F.floor(256 * x), F.lit(2.0)))
    figures = rows.agg(
        F.count(F.lit(1)).alias("n"), F.max(squared).alias("norm"), F.max(F.array_max(F.transform("embedding", lambda x: F.abs(256 * x)))).alias("c"),
        F.sum(F.size("embedding")).alias("components"), F.max(F.size("embedding")).alias("width"),
    ).first()
    if (figures["norm"] or 0) >= 2.0**61:
        raise ScoringError("scores of these vectors do not fit a 64-bit number")
    kind = "smallint" if (figures["c"] or 0) < 32000 else "int"
    rows = rows.select("vec_id", "label", scaled.cast(f"array<{kind}>").alias("numbers"))
    # The work is scores, not bytes, so also a small table is dealt to all cores.
    tasks = max(3 * spark.sparkContext.defaultParallelism, (figures["components"] or 0) * 4 // (128 << 20))
    rows = rows.repartition(tasks).withColumn("place", F.monotonically_increasing_id())
    return materialise(rows, "negative_rows"), int((figures["norm"] or 0) * 1.001) + 1, figures["width"] or 0


def mine(
    df: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90),
) -> DataFrame:
    """Negatives whose score lies between ``window`` per cent of a positive's: ``anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score``.

    ``df`` has ``vec_id`` and ``embedding``; ``label`` is its class (a null one takes no part) and ``is_anchor`` says, of
    ``vec_id``, which rows are anchors (a null answer is no).  Vectors that are null or hold a null or non-finite component
    take no part.  Scores are integer inner products of ``floor(256 * x)``, of vectors of unequal length over their common
    first components; where 64 bits cannot hold them, the call fails.  An anchor's positives are the first rows of its label
    but itself; ranks go by score, then ``vec_id`` (null last), then the row's place.  Rows that repeat an id are rows of
    their own.  Anchors without a positive, and positives without a negative in the window, have no rows; an empty table gives
    none.  Other columns are not read.
    """
    spark = df.sparkSession
    rows, bound, width = prepared(df, label)
    primes = moduli(bound, min(width, STRIP))
    low, high = window
    asked = rows.filter(F.coalesce(is_anchor, F.lit(False)))
    size = asked.agg(F.sum(8 * F.size("numbers") + 64)).first()[0] or 0
    parts, answers = -(-size // ANCHOR_BYTES), []
    for part in range(parts):
        anchors = Rows(asked.filter(F.pmod(F.xxhash64("place"), F.lit(parts)) == part).toArrow())

        def same_label(scores, some, labels, places, anchors=anchors):
            other = (anchors.label[some][:, None] != labels) | (anchors.place[some][:, None] == places)
            yield some, np.where(other, _NONE, scores)

        found = materialise(_passes(rows, anchors, primes, len(anchors.place), positives, same_label), "negative_positives")
        pairs = found.orderBy("group", "rank").collect()  # a few for each anchor of this part
        group = np.full((len(anchors.place), positives), -1, np.int64)
        lows, highs = np.full(group.shape, 1, np.int64), np.zeros(group.shape, np.int64)  # an empty window
        named = []
        for i, r in enumerate(pairs):
            at = r["group"], r["rank"] - 1
            group[at], lows[at], highs[at] = i, -(-low * r["score"] // 100), high * r["score"] // 100
            a = r["group"]
            named.append((i, None if anchors.missing[a] else int(anchors.ids[a]), r["vec_id"], r["score"]))

        def in_window(scores, some, labels, places, anchors=anchors, group=group, lows=lows, highs=highs):
            other = anchors.label[some][:, None] != labels
            for j in range(group.shape[1]):
                inside = other & (scores >= lows[some, j][:, None]) & (scores <= highs[some, j][:, None])
                yield group[some, j], np.where(inside, scores, _NONE)

        if not named:
            continue
        names = spark.createDataFrame(named, "group long, anchor_id long, positive_id long, positive_score long")
        best = _passes(rows, anchors, primes, len(named), negatives, in_window)
        # There are a few positives for each anchor of this part, whose bytes are bounded.
        answers.append(best.join(F.broadcast(names), "group").select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ))
    if not answers:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        )
    return reduce(DataFrame.unionAll, answers)

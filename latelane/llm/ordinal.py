"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades 0 < 1 < ... < K-1 share one weight per hashed feature and have ordered thresholds t_1 < ... :
P(grade >= k | x) = sigmoid(w . x - t_k).  Features are the distinct words and runs of other signs of
a text, and a few bins of its make-up (share of signs, of capitals, of repeated words, word length).  The model is fitted
on a bounded sample of rated documents, with a penalty that leaves most weights at zero, and applied to
all documents in one pass over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latelane.llm.common import pieces, prefix_sums, range_hashes, text_buffers
from latelane.session import materialise

HASH_BITS = 18
#: Bins of make-up follow the hashed features.
BINS, MEASURES = 12, 6
WIDTH = (1 << HASH_BITS) + BINS * MEASURES
#: Rated documents that the model is fitted on at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Features of all of them together at most, four bytes each.
SAMPLE_FEATURES = 16_000_000
PIECE = 1 << 20

_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 letter or digit or part of a longer character, 2 other sign
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_CAPITAL = np.zeros(256, np.int64)
_CAPITAL[ord("A") : ord("Z") + 1] = 1
_SMALL = np.zeros(256, np.int64)
_SMALL[ord("a") : ord("z") + 1] = 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each text, ascending, and the ``n + 1`` bounds of the texts' features."""
    n = len(offsets) - 1
    kind = _KIND[data]
    head = np.ones(len(data), bool)
    head[1:] = kind[1:] != kind[:-1]
    head[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(head)
    ends = np.concatenate([starts[1:], [len(data)]]) if len(data) else starts
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    row = np.searchsorted(offsets, starts, "right") - 1
    number = (range_hashes(prefix_sums(_LOWER[data]), starts, ends) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
    word = kind[starts] == 1
    size = ends - starts
    capitals = np.add.reduceat(np.concatenate([_CAPITAL[data], [0]]), starts) if len(starts) else size
    smalls = np.add.reduceat(np.concatenate([_SMALL[data], [0]]), starts) if len(starts) else size
    # Reduceat runs on to the next start: white space in between counts nothing, so the sums are the runs' own.
    shouted = word & (capitals > 1) & (smalls == 0)
    words = np.bincount(row[word], minlength=n).astype(float)
    safe = np.maximum(words, 1)
    same = row[word][1:][(number[word][1:] == number[word][:-1]) & (row[word][1:] == row[word][:-1])]
    runs = np.bincount(row[~word & (size > 1)], minlength=n)
    signs = np.bincount(row[~word], weights=size[~word], minlength=n)
    shares = [
        runs / safe, signs / safe / 2, np.bincount(row[shouted], minlength=n) / safe,
        np.bincount(row[word], weights=size[word], minlength=n) / safe / 16, np.log2(1 + words) / 16,
        np.bincount(same, minlength=n) / safe,
    ]
    made = [(1 << HASH_BITS) + m * BINS + np.minimum((x * BINS).astype(np.int64), BINS - 1) for m, x in enumerate(shares)]
    pairs = np.concatenate([row, *[np.arange(n)] * MEASURES]) * WIDTH + np.concatenate([number, *made])
    pairs = np.unique(pairs)
    return pairs % WIDTH, np.searchsorted(pairs, np.arange(n + 1) * WIDTH)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[numbers])])
        return total[bounds[1:]] - total[bounds[:-1]]

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., one column each."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def fit(
    numbers: np.ndarray, bounds: np.ndarray, grades: np.ndarray, steps: int = 300, rate: float = 0.3, penalty: float = 3e-4,
) -> Model:
    """Cumulative-link regression by adaptive proximal gradient steps over all rows; grades count from 0.

    Each cut between grades weighs its two sides so that a rare grade counts as much as the square
    root of its share allows.  The penalty includes the weight of one row, so no feature of a single row is learnt.
    """
    rows, cuts = len(grades), max(1, int(grades.max()) if len(grades) else 1)
    owner = np.repeat(np.arange(rows), np.diff(bounds))
    above = (grades[:, None] > np.arange(cuts)[None, :]).astype(float)
    share = np.clip(above.mean(0) if rows else np.full(cuts, 0.5), 1 / (rows + 2), 1 - 1 / (rows + 2))
    side = np.where(above > 0, np.sqrt(0.5 / share), np.sqrt(0.5 / (1 - share)))
    penalty += 1 / max(rows, 1)
    weights, seen = np.zeros(WIDTH), np.full(WIDTH, 1e-8)
    thresholds = np.sort(-np.log(share / (1 - share)))
    push = np.full(cuts, 1e-8)
    for _ in range(steps if rows else 0):
        model = Model(weights, thresholds)
        miss = side * (model.tails(model.scores(numbers, bounds)) - above) / rows
        slope = np.bincount(numbers, weights=miss.sum(1)[owner], minlength=WIDTH)
        seen += slope**2
        step = rate / np.sqrt(seen)
        moved = weights - step * slope
        weights = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        down = -miss.sum(0)
        push += down**2
        thresholds = np.sort(thresholds - rate / np.sqrt(push) * down)
    return Model(weights, thresholds)


def _numbered(batches):
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        for a, b in pieces(offsets, PIECE):
            numbers, bounds = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            packed = [x.tobytes() for x in np.split(numbers.astype(np.int32), bounds[1:-1])]
            kept = [batch.column(c).slice(a, b - a) for c in ("k", "grade")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(np.diff(bounds), pa.int64()), pa.array(packed, pa.binary())], names=["k", "grade", "n", "numbers"]
            )


def sampled(
    docs: DataFrame, ratings: DataFrame, grade: Column, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, most: int = SAMPLE_FEATURES,
) -> DataFrame:
    """Grade and packed features of at most ``sample`` rated documents with at most ``most`` features together.

    They are those with the smallest hashes of their keys.  Of rows that repeat a key one is taken, so what reaches the driver
    is bounded in rows and in bytes (four a feature) whatever the table holds.
    """
    rated = ratings.select(F.col(f"`{key}`").alias("k"), grade.cast("int").alias("grade")).filter("grade is not null and k is not null")
    chosen = rated.groupBy("k").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("k")).limit(sample)
    chosen = materialise(chosen, "rated_sample")  # ``sample`` rows at most: small enough for every task
    texts = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "k")
    kind = texts.schema["k"].dataType.simpleString()
    numbered = texts.select("k", "grade", "text").mapInArrow(_numbered, f"k {kind}, grade int, n long, numbers binary")
    one = numbered.groupBy("k").agg(F.min_by(F.struct("grade", "n", "numbers"), F.xxhash64("numbers")).alias("row")).select("k", "row.*")
    one = materialise(one, "rated_features")
    total = F.sum("n").over(Window.orderBy(F.xxhash64("k"), "k"))  # over ``sample`` rows at most
    return one.join(F.broadcast(one.select("k", total.alias("total")).filter(F.col("total") <= most).select("k")), "k")


def train(
    docs: DataFrame, ratings: DataFrame, grade: Column, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, **settings
) -> Model:
    """Fit on the documents of :func:`sampled`, whatever the table's order.

    ``grade`` is an integer expression over ``ratings``; rows where it is null, and ratings without a document, teach nothing.
    """
    grades, lists = [], []
    for row in sampled(docs, ratings, grade, key, text, sample).select("grade", "numbers").toLocalIterator():
        grades.append(row["grade"])
        lists.append(np.frombuffer(bytes(row["numbers"]), np.int32))
    # Rows arrive in any order; the sums of the fit must not depend on it.
    order = sorted(range(len(grades)), key=lambda i: (grades[i], lists[i].tobytes()))
    numbers = np.concatenate([lists[i] for i in order]) if order else np.zeros(0, np.int32)
    bounds = np.concatenate([[0], np.cumsum([len(lists[i]) for i in order])]).astype(np.int64)
    return fit(numbers, bounds, np.array([grades[i] for i in order], np.int64), **settings)


def _scored(model: Model):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for a, b in pieces(offsets, PIECE):
                numbers, bounds = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                tails = model.tails(model.scores(numbers, bounds))
                columns = [*batch.slice(a, b - a).columns[:-1], pa.array(tails.sum(1)), pa.array(tails[:, -1])]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "expected_grade", "tail"])

    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``expected_grade`` (sum of the tails) and ``tail`` (probability of the highest grade) of every row.

    Whole texts are read.  Null and empty texts have the features of a text without words and get a score
    like others; null keys and repeated rows too.  An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["k"].dataType.simpleString()
    scored = rows.mapInArrow(_scored(model), f"k {kind}, expected_grade double, tail double")
    return scored.withColumnRenamed("k", key)


def select(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose probability of the highest grade is ``least`` or more, with all their columns."""
    names = docs.columns
    kept = docs.schema

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(text))
            for a, b in pieces(offsets, PIECE):
                numbers, bounds = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                keep = model.tails(model.scores(numbers, bounds))[:, -1] >= least
                if keep.any():
                    yield batch.slice(a, b - a).filter(pa.array(keep))

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, kept)


def grade_of_labels() -> Column:
    """0 toxic, 1 of low quality, 2 good; unknown where the labels do not say."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)

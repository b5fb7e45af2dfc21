"""Conflict-constrained best-fit packing of documents into training sequences.

A bin holds at most ``capacity`` words, one document of a source and one document of a
group of copies.  Bins stand in order of the room they have left and carry bitmaps of
the sources and groups in them.  A piece goes to the tightest bin that is compatible:
from the first bin with enough room the search moves on to its successors.

Every domain of about ``ROWS`` pieces is packed on its own, so the work is spread over as
many tasks as the corpus asks for and no task grows with it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latelane.llm.common import normalised, slices, small, unused
from latelane.session import materialise

ROWS = 4096

_WORD = "[^\\x20\\x09-\\x0D]+"
_SCHEMA = "k long, piece int, n_pieces int, first_word long, n_words int, bin_id long, slot int, bin_words int, at long"


def place(lengths: list[int], conflicts: list[int], capacity: int) -> list[int]:
    """The bin of each piece, in the given order.  ``conflicts``: a bitmap; no two pieces of a bin share a bit."""
    room: list[tuple[int, int]] = []  # (words left, bin), ascending
    taken: list[int] = []
    bins = []
    for n, bits in zip(lengths, conflicts, strict=True):
        i = bisect_left(room, (n, -1))
        while i < len(room) and taken[room[i][1]] & bits:
            i += 1
        if i < len(room):
            left, b = room.pop(i)
            taken[b] |= bits
        else:
            left, b = capacity, len(taken)
            taken.append(bits)
        insort(room, (left - n, b))
        bins.append(b)
    return bins


def conflict_bits(sources: list, clusters: list) -> list[int]:
    """A bit per source and per group of copies; what occurs once needs none, and null conflicts with nothing."""
    counts, bits = Counter(), {}
    pairs = [(("s", s), ("c", c)) for s, c in zip(sources, clusters, strict=True)]
    for pair in pairs:
        counts.update(x for x in pair if x[1] is not None)
    for x, n in counts.items():
        if n > 1:
            bits[x] = 1 << len(bits)
    return [bits.get(s, 0) | bits.get(c, 0) for s, c in pairs]


def _packed(capacity: int):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        # Longest first; ties by document, piece and place, so that a domain packs one way only.
        table = table.sort_by([("n_words", "descending"), ("k", "ascending"), ("piece", "ascending"), ("at", "ascending")])
        lengths = table["n_words"].to_pylist()
        bins = place(lengths, conflict_bits(table["source"].to_pylist(), table["cluster"].to_pylist()), capacity)
        full, slots = Counter(), []
        filled = [0] * len(bins)
        for b, n in zip(bins, lengths, strict=True):
            slots.append(full[b])
            full[b] += 1
            filled[b] += n
        return pa.table({
            "k": table["k"], "piece": table["piece"], "n_pieces": table["n_pieces"], "first_word": table["first_word"],
            "n_words": table["n_words"],
            "bin_id": pa.array([(key[0].as_py() << 32) + b for b in bins], pa.int64()), "slot": pa.array(slots, pa.int32()),
            "bin_words": pa.array([filled[b] for b in bins], pa.int32()), "at": table["at"],
        })

    return pack


def pack(
    df: DataFrame, capacity: int, key: str = "doc_id", text: str = "text", source: str = "source",
    cluster: str | None = None, rows: int = ROWS, place: str | None = None,
) -> DataFrame:
    """Bins for every document: ``key``, piece, n_pieces, first_word, n_words, bin_id, slot, bin_words.

    A document longer than ``capacity`` words is cut into pieces of ``capacity`` words and a
    rest, none of it dropped.  ``cluster`` names a column with the group of copies; without it,
    rows whose texts differ only in white space are a group.  Pieces of one document share its
    source and group, so they never share a bin.  A null source or group conflicts with nothing;
    null and empty texts are pieces of no words, which any compatible bin takes.  Repeated rows
    are packed like others: each is its own piece.  An empty table gives no bins.  ``place`` names a column
    of a stored ``df`` that tells its rows apart; it is then returned as well.
    """
    words = F.regexp_count(F.col(f"`{text}`"), F.lit(_WORD))
    group = F.xxhash64(normalised(F.col(f"`{text}`"))) if cluster is None else F.col(f"`{cluster}`")
    docs = df.select(
        F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{source}`").cast("string").alias("source"),
        group.cast("string").alias("cluster"), F.coalesce(words, F.lit(0)).cast("long").alias("words"),
        (F.col(f"`{place}`") if place else F.monotonically_increasing_id()).alias("at"),
    )
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("words") / capacity)).cast("int")
    docs = docs.withColumn("n_pieces", n_pieces)
    cut = docs.select(
        "k", "source", "cluster", "words", "n_pieces", "at",
        F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"),
    )
    cut = materialise(cut.select(
        "k", "source", "cluster", "n_pieces", "piece", "at", (F.col("piece").cast("long") * capacity).alias("first_word"),
        F.least(F.lit(capacity), F.col("words") - F.col("piece").cast("long") * capacity).cast("int").alias("n_words"),
    ), "pieces")
    domains = max(1, -(-cut.count() // rows))
    spread = cut.withColumn("domain", F.expr(f"pmod(xxhash64(at, piece), {domains}L)"))
    bins = spread.groupBy("domain").applyInArrow(_packed(capacity), _SCHEMA)
    return bins.withColumnsRenamed({"k": key, "at": place}) if place else bins.drop("at").withColumnRenamed("k", key)


def _cut(capacity: int):
    word = re.compile(_WORD.encode())

    def cut(batches):
        for batch in slices(batches, 64):
            places, numbers, texts = [], [], []
            for at, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                starts = [m.start() for i, m in enumerate(word.finditer(text)) if i % capacity == 0]
                bounds = [0, *starts[1:], len(text)]
                places += [at] * (len(bounds) - 1)
                numbers += range(len(bounds) - 1)
                texts += [text[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(places, pa.int64()), pa.array(numbers, pa.int32()), pa.array(texts, pa.binary()).cast(pa.string())], ["at", "piece", "text"]
            )

    return cut


def pack_texts(df: DataFrame, capacity: int, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """:func:`pack` with the ``text`` of each piece and ``row_place``, which tells the rows of ``df`` apart.

    A piece's text begins at its first word, the first piece's at the start, and ends where the next one begins, so the
    pieces of a row put together are its text; a null text is one null piece.
    """
    at, = unused(df.columns, "row_place")
    stored = materialise(df.withColumn(at, F.monotonically_increasing_id()), "to_pack")
    bins = materialise(pack(stored, capacity, key, text, place=at, **options), "bins")
    whole = stored.select(F.col(at).alias("at"), F.col(f"`{text}`").alias("text"))
    is_long = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)) > capacity
    short = whole.filter(~is_long).select("at", F.lit(0).alias("piece"), "text")
    pieces = short.unionByName(whole.filter(is_long).mapInArrow(_cut(capacity), "at long, piece int, text string"))
    return pieces.join(small(bins.withColumnRenamed(at, "at")), ["at", "piece"]).withColumnRenamed("at", "row_place")

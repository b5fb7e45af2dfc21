"""Ranked lexical search: whole documents scored term at a time, with a limit on the accumulators.

Documents are reduced once to a stored row of (term number, occurrences) for the terms that any
item asks for.  Counts over all documents give the weights.  A task then takes its documents in
blocks; in a block an item's terms are added rarest first, one accumulator per document that holds
one.  As soon as the terms that are left cannot lift a new document to the best ``k`` partial
scores, no accumulator is created any more, and the terms left only update the survivors, exactly.

The ``k``-th score of each item over one document in ``PILOT`` is found first.  It is a lower
bound of the final one, so the pass over all documents returns little more than the answer.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latelane.llm.common import joined, slices, text_buffers
from latelane.session import materialise

#: Bytes of items' terms that are held by the driver and each worker; more are answered in further passes.
ITEM_BYTES = 4 * 1024 * 1024
#: One document in so many gives the first lower bounds.
PILOT = 32
#: Documents and (term, document) pairs of a block; a block ends with the document that reaches either.
BLOCK_DOCS, BLOCK_PAIRS = 16384, 2_000_000
#: A text is cut into words by pieces of about this many bytes.
PIECE = 4 * 1024 * 1024

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(text: Column) -> Column:
    """The different terms of a text: letters, digits and everything beyond ASCII, only A-Z in lower case."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_distinct(F.filter(F.split(lower, _APART), lambda w: w != ""))


def _words(raw: bytes) -> Iterator[list[bytes]]:
    """All terms of a text, with repeats, piece by piece; a term is never cut."""
    raw, start = raw.lower(), 0  # of bytes only A-Z changes
    while start < len(raw):
        end = min(start + PIECE, len(raw))
        inside = _WORD.match(raw, end)
        end = inside.end() if inside else end
        yield _WORD.findall(raw, start, end)
        start = end


def postings(docs: DataFrame, vocabulary: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document with a term: ``key``, ``n`` (its terms), ``terms`` (sorted int32 numbers) and ``tfs`` (int32), packed."""
    size = max(len(vocabulary), 1)

    def reduce_texts(batches):
        get = vocabulary.get
        for batch in slices(batches):
            data, offsets = text_buffers(batch.column(1))
            raw, numbers, known, lengths = data.tobytes(), [], [], []
            for a, b in zip(offsets[:-1], offsets[1:]):
                n, found = 0, []
                for words in _words(raw[a:b]):
                    n += len(words)
                    ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                    found.append(ids[ids >= 0])
                ids = np.concatenate(found) if found else np.zeros(0, np.int64)
                lengths.append(n)
                known.append(len(ids))
                numbers.append(ids)
            rows = np.repeat(np.arange(len(lengths)), known)
            pairs, tfs = np.unique(rows * size + np.concatenate(numbers) if numbers else rows, return_counts=True)
            ends = np.searchsorted(pairs, np.arange(len(lengths) + 1) * size)
            pairs, tfs = (pairs % size).astype(np.int32), tfs.astype(np.int32)
            cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())
            made = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lengths, pa.int64()), cut(pairs), cut(tfs)], ["id", "n", "terms", "tfs"]
            )
            yield made.filter(pa.array(np.array(lengths) > 0, pa.bool_()))

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(reduce_texts, "id long, n long, terms binary, tfs binary")


def document_counts(stored: DataFrame) -> DataFrame:
    """``term``, ``df``: documents that hold it.  Each task adds up its own before the shuffle."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(joined(batch.column(0), np.int32))
            if len(found) > len(total):
                found[: len(total)] += total
                total = found
            else:
                total[: len(found)] += found
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["term", "df"])

    return stored.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Block:
    """The postings of some documents, term by term."""

    def __init__(self, ids: np.ndarray, missing: np.ndarray, m: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, tfs: np.ndarray):
        self.ids, self.missing = ids, missing
        docs = np.repeat(np.arange(len(ids)), sizes)
        order = np.argsort(numbers, kind="stable")  # within a term by document
        docs, tfs = docs[order], tfs[order].astype(np.int64)
        held, starts = np.unique(numbers[order], return_index=True)
        impacts = (1_000_000_000 * tfs) // (1000 * tfs + 20 * m[docs])
        self.lists = {
            int(t): (docs[a:b], impacts[a:b], int(impacts[a:b].max()))
            for t, a, b in zip(held, starts, [*starts[1:], len(docs)])
        }

    def best(self, query: list[tuple[int, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of those of the block's best ``k`` that reach ``least``; ties at the end are all returned.

        ``query`` lists (term, weight), rarest first.
        """
        lists = [(w, *self.lists[t]) for t, w in query if t in self.lists and w > 0]
        rest = [0] * (len(lists) + 1)  # the most that the terms from here on can add
        for j in range(len(lists) - 1, -1, -1):
            rest[j] = rest[j + 1] + lists[j][0] * lists[j][3]
        scores, kth, j = np.zeros(len(self.ids), np.int64), max(least, 1), 0
        while j < len(lists) and rest[j] >= kth:  # a document not met so far can still be among the best
            weight, docs, impacts, _ = lists[j]
            scores[docs] += weight * impacts
            j += 1
            if len(scores) > k and rest[j] < scores.max():
                kth = max(kth, int(np.partition(scores, -k)[-k]))
        alive = np.flatnonzero(scores)
        for weight, docs, impacts, _ in lists[j:]:
            alive = alive[scores[alive] + rest[j] >= kth]
            j += 1
            if 8 * len(alive) < len(docs):
                at = np.minimum(np.searchsorted(docs, alive), len(docs) - 1)
                same = docs[at] == alive
                scores[alive[same]] += weight * impacts[at[same]]
            else:
                survives = np.zeros(len(scores), bool)
                survives[alive] = True
                same = survives[docs]
                scores[docs[same]] += weight * impacts[same]
            if len(alive) > k:
                kth = max(kth, int(np.partition(scores[alive], -k)[-k]))
        alive = alive[scores[alive] >= kth]
        return alive, scores[alive]


def _blocks(batches, documents: int, words: int):
    """The rows of a task as blocks; ``documents`` and ``words`` are the counts N and L of the whole corpus."""
    held, n_docs, n_pairs = [], 0, 0

    def made():
        table = pa.Table.from_batches(held)
        n = table.column("n").to_numpy()
        wide = int(n.max()) * documents * 50 >= 1 << 63
        share = np.array([50 * int(x) * documents // words for x in n], np.int64) if wide else 50 * n * documents // words
        sizes = np.diff(text_buffers(table.column("terms"))[1]) // 4
        missing = table.column("id").is_null().to_numpy()
        ids = table.column("id").fill_null(0).to_numpy()
        return Block(ids, missing, 50 + share, sizes, joined(table.column("terms"), np.int32), joined(table.column("tfs"), np.int32))

    for batch in slices(batches, 1024):
        held.append(batch)
        n_docs += batch.num_rows
        n_pairs += len(joined(batch.column(2), np.int32))
        if n_docs >= BLOCK_DOCS or n_pairs >= BLOCK_PAIRS:
            yield made()
            held, n_docs, n_pairs = [], 0, 0
    if n_docs:
        yield made()


def _search(stored: DataFrame, queries: list[list[tuple[int, int]]], least: list[int], documents: int, words: int, k: int) -> DataFrame:
    """Each task's best ``k`` documents per item number: ``item``, ``score``, ``doc``."""

    def score(batches):
        bounds, found = list(least), [None] * len(queries)
        for block in _blocks(batches, documents, words):
            for i, query in enumerate(queries):
                rows, scores = block.best(query, k, bounds[i])
                if not len(rows):
                    continue
                ids, missing = block.ids[rows], block.missing[rows]
                if found[i] is not None:
                    scores, ids, missing = (np.concatenate(x) for x in zip(found[i], (scores, ids, missing)))
                order = np.lexsort((ids, missing, -scores))[:k]
                found[i] = scores[order], ids[order], missing[order]
                if len(order) == k:
                    bounds[i] = max(bounds[i], int(found[i][0][-1]))
        for i, held in enumerate(found):
            if held is not None:
                scores, ids, missing = held
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(scores), i, np.int32)), pa.array(scores), pa.array(ids, mask=missing)], ["item", "score", "doc"]
                )

    return stored.select("id", "n", "terms", "tfs").mapInArrow(score, "item int, score long, doc long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each item with their ``rank``; first among the results of some tasks, then among those that are left."""
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    part = found.withColumn("part", F.spark_partition_id() % 64)
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The ``k`` highest-scoring documents of each item: ``item_key``, ``rank`` (from 1), ``key``, ``score``.

    Scores are integers (weights and lengths as in the query's contract); only those above 0 count, and equal
    ones go by ascending key, null keys last.  Every row of ``docs`` and of ``items`` is one of its own, also where
    keys repeat or are null: an item that occurs twice is answered twice.  Null and empty texts have no terms: such a
    document is not counted and never found, such an item has no rows.  Empty tables give no rows.  Other columns of
    either table, whatever their names, are not read.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(f"`{item_key}`").cast("long").alias("item_id"), terms(F.col(f"`{text}`")).alias("terms"))
    asked = materialise(asked.withColumn("place", F.monotonically_increasing_id()), "search_items")
    size = asked.agg(F.sum(F.octet_length(F.concat_ws(" ", "terms")) + 64)).first()[0] or 0
    parts = -(-size // ITEM_BYTES)
    answers = []
    for part in range(parts):
        # Items are dealt out by a hash of their place, so a part has about ITEM_BYTES at most.
        mine = asked.filter(F.pmod(F.xxhash64("place"), F.lit(parts)) == part).orderBy("place").collect()
        vocabulary = {w: i for i, w in enumerate(sorted({t.encode() for r in mine for t in r["terms"]}))}
        placed = postings(docs, vocabulary, key, text).withColumn("place", F.monotonically_increasing_id())
        stored = materialise(placed, "search_postings")
        counted = stored.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("words")).first()
        documents, words = counted["documents"], counted["words"]
        if not documents:
            continue
        df = {r["term"]: r["df"] for r in document_counts(stored).collect()}  # at most one row per term of this part's items
        weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in df.items()}
        queries = []
        for r in mine:
            known = [vocabulary[t.encode()] for t in r["terms"] if vocabulary[t.encode()] in df]
            queries.append([(t, weight[t]) for t in sorted(known, key=lambda t: (df[t], t))])
        pilot = stored.filter(F.pmod(F.xxhash64("place"), F.lit(PILOT)) == 0)
        least = [0] * len(queries)
        for r in _first(_search(pilot, queries, least, documents, words, k), k).filter(F.col("rank") == k).collect():  # one row per item
            least[r["item"]] = r["score"]
        ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(mine)], f"item int, `{item_key}` long")
        best = _first(_search(stored, queries, least, documents, words, k), k)
        # Of a part's items there are as many as fit ITEM_BYTES.
        answers.append(best.join(F.broadcast(ids), "item").select(item_key, "rank", F.col("doc").alias(key), "score"))
    if not answers:
        return spark.createDataFrame([], f"`{item_key}` long, rank int, `{key}` long, score long")
    return reduce(DataFrame.unionAll, answers)

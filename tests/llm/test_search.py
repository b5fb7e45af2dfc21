"""Ranked search against a plain loop over all documents and items."""

import math
import random
import re

import numpy as np
import pytest

from latelane.llm import ranked_search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    words = [(d, WORD.findall((t or "").translate(LOWER))) for d, t in docs]
    words = [(d, w) for d, w in words if w]
    n_docs, total, found = len(words), sum(len(w) for _, w in words), []
    for item, text in items:
        asked, scored = set(WORD.findall((text or "").translate(LOWER))), []
        df = {t: sum(t in w for _, w in words) for t in asked}
        for d, w in words:
            m = 50 + 50 * len(w) * n_docs // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * w.count(t) // (1000 * w.count(t) + 20 * m))
                for t in asked if t in w
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        found += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return found


def frame(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


def rows(df, key="doc_id"):
    return [(r["item_id"], r["rank"], r[key], r["score"]) for r in df.collect()]


def order(found):
    return sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[1], str(r[2])))


@pytest.mark.parametrize("k", [1, 3, 50])
@pytest.mark.parametrize("small_blocks", [True, False])
def test_equals_a_plain_loop(spark, monkeypatch, k, small_blocks):
    if small_blocks:
        monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 7)
        monkeypatch.setattr(ranked_search, "PILOT", 3)
        monkeypatch.setattr(ranked_search, "PIECE", 16)
    draw = random.Random(k)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ärger", "naïve", "日本", "X9"]
    docs = [(i, " ".join(draw.choices(vocabulary, [1 / (j + 1) for j in range(44)], k=draw.randint(0, 60)))) for i in range(150)]
    items = [(i, ", ".join(draw.choices(vocabulary, k=draw.randint(1, 12)))) for i in range(9)]
    got = ranked_search.search(frame(spark, docs).repartition(5), frame(spark, items, "item_id long, text string"), k)
    assert order(rows(got)) == order(brute(docs, items, k))


def test_parts_of_items_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "ITEM_BYTES", 150)
    docs = [(i, "common " * (i % 5) + f"rare{i % 7}") for i in range(40)]
    items = [(i, f"Common rare{i}") for i in range(7)]
    got = ranked_search.search(frame(spark, docs), frame(spark, items, "item_id long, text string"), 4)
    assert order(rows(got)) == order(brute(docs, items, 4))


def test_edges(spark):
    """Nulls, empty texts, ties, repeated rows and ids, words nobody has, columns with clashing names, a very long text."""
    long = "Needle " + "hay " * 300_000 + "needle"
    docs = [(3, "needle hay"), (None, "needle hay"), (1, "needle hay"), (1, "needle hay"), (2, None), (4, ""), (5, "... !"), (9, long)] + [
        (i, "hay only") for i in range(20, 60)]
    items = [(7, "NEEDLE"), (7, "needle hay unheard"), (None, "needle"), (8, None), (10, "unheard"), (11, "")]
    df = frame(spark, [(*d, 1, 2, 3, 4) for d in docs], "doc_id long, text string, n int, score int, item int, place int")
    asked = frame(spark, [(*i, 1, 2) for i in items], "item_id long, text string, rank int, terms int")
    got = order(rows(ranked_search.search(df, asked, 5)))
    assert got == order(brute(docs, items, 5))
    assert [r[2] for r in got if r[0] is None][:4] == [1, 1, 3, None]


def test_empty_tables(spark):
    docs, items = frame(spark, [(1, "a b")]), frame(spark, [(1, "a")], "item_id long, text string")
    assert rows(ranked_search.search(docs.limit(0), items)) == []
    assert rows(ranked_search.search(docs, items.limit(0))) == []
    assert ranked_search.search(docs.limit(0), items).columns == ranked_search.search(docs, items).columns


def test_accumulators_stop_and_results_stay(monkeypatch):
    """A block scored with and without the limit; with it the common list creates no accumulator."""
    draw = np.random.default_rng(1)
    lists = {0: draw.choice(500, 30, False), 1: draw.choice(500, 120, False), 2: draw.choice(500, 480, False)}
    numbers = np.concatenate([np.full(len(d), t) for t, d in lists.items()])
    docs = np.concatenate(list(lists.values()))
    at = np.argsort(docs, kind="stable")
    sizes = np.bincount(docs, minlength=500)
    block = ranked_search.Block(np.arange(500), np.zeros(500, bool), np.full(500, 100), sizes, numbers[at], draw.integers(1, 4, len(at)))
    query = [(0, 5000), (1, 900), (2, 3)]
    all_docs, all_scores = block.best(query, 500, 0)
    some, scores = block.best(query, 10, 0)
    keep = np.argsort(-all_scores, kind="stable")[:10]
    assert set(all_docs[all_scores > all_scores[keep[-1]]]) <= set(some) and sorted(scores)[::-1][:10] == list(all_scores[keep])
    assert len(some) < len(all_docs)
    nothing, _ = block.best(query, 10, 10**12)
    assert len(nothing) == 0

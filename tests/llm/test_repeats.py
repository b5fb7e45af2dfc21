"""Suffix dedup and the n-gram join against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from latelane.llm import ngram_join, queries, suffix_dedup
from tests.conftest import SF


def docs(spark, rows):
    full = [(d, t, 1, "a", b"n", 2, [3]) for d, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, doc int, tie string, names binary, cls int, n array<int>")


# --- repeated strings -----------------------------------------------------------------


def brute_repeats(rows):
    """(doc_id, text) -> kept bytes and spans, for rows with distinct document and text."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), {}
    for d, t in order:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone])))
        spans = [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]
        out[d, t] = (spans, bytes(b for b, g in zip(raw, gone) if not g))
    return out


def check_repeats(spark, rows, **settings):
    got = suffix_dedup.deduplicate(docs(spark, rows).repartition(5)).collect()
    want = brute_repeats(list(dict.fromkeys(rows)))
    assert len(got) == len(rows)
    left = {}
    for d, t in rows:
        left.setdefault(d, []).append((len((t or "").encode()), *want[d, t]))
    for r in got:
        left[r.doc_id].remove((r.n_bytes, [(s.start, s.end) for s in r.spans], r.kept))


def test_repeats_in_and_across_documents(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeéß") for _ in range(rnd.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(n)) for n in (30, 60, 200)]
    rows = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rnd.randrange(0, 40)))]
        for _ in range(rnd.randrange(0, 4)):
            p = rnd.choice(passages)
            a = rnd.randrange(0, len(p) // 2)
            parts += [p[a : a + rnd.randrange(50, 900)], word()]
        rows.append((i, " ".join(parts)))
    rows += [(100 + i, rows[i][1]) for i in range(8)]  # exact copies
    rows += [(200, "x" * 350), (201, "x" * 99), (202, "x" * 100), (203, "ab" * 200), (204, None), (205, ""), (None, rows[0][1])]
    check_repeats(spark, rows)


def test_repeated_rows_are_one_document(spark):
    text = " ".join(str(i) for i in range(100))
    check_repeats(spark, [(1, text), (1, text), (2, text), (0, "short")])


def test_long_text_is_cut_into_parts(spark, monkeypatch):
    rnd = random.Random(5)
    unit = "".join(rnd.choice("abcdef ") for _ in range(400))
    rows = [(1, unit + "".join(rnd.choice("ghij ") for _ in range(900)) + unit), (2, unit[50:300] * 2)]
    monkeypatch.setattr(suffix_dedup, "PIECE", 256)
    parts = list(suffix_dedup._parts(suffix_dedup.pa.RecordBatch.from_pydict(
        {"text": [t for _, t in rows], "doc": [1, 2], "tie": [0, 0]}) for _ in range(1)))
    assert len(parts) > 6 and all(len(p[2]) <= 256 + 99 for p in parts)
    check_repeats(spark, rows)


def test_ends_of_a_frequent_passage(spark, monkeypatch):
    """Every text holds one passage between words of its own: the names at its ends have a run per text."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9)))
    passage = " ".join(word() for _ in range(50))
    rows = [(i, " ".join([*(word() for _ in range(25)), passage, *(word() for _ in range(25))])) for i in range(80)]
    rows += [(100 + i, f"{i % 3} " + passage[i % 7 :] + rows[i][1][-120:]) for i in range(40)]
    monkeypatch.setattr(suffix_dedup, "HOT", 10)
    check_repeats(spark, rows)


def test_suffix_query_on_the_table(spark):
    got = {r.doc_id: r for r in queries.op4_suffix_dedup(spark, SF).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for (d, _), (spans, kept) in brute_repeats(rows).items():
        r = got[d]
        assert (r.n_spans, r.n_removed) == (len(spans), sum(b - a for a, b in spans))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
    assert suffix_dedup.deduplicate(docs(spark, [])).count() == 0


# --- n-gram join -------------------------------------------------------------------------


def brute_sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]+", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_join(rows):
    sets = [brute_sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                inter = len(sets[i] & sets[j])
                if 100 * inter >= 80 * (len(sets[i]) + len(sets[j]) - inter) or rows[i][0] == rows[j][0] is not None:
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def edited(rnd, words, k):
    words = list(words)
    for _ in range(k):
        at = rnd.randrange(len(words))
        kind = rnd.randrange(3)
        if kind == 0:
            words[at] = f"e{rnd.randrange(10**6)}"
        elif kind == 1 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, f"i{rnd.randrange(10**6)}")
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    boiler = [rnd.choice(vocab) for _ in range(60)]
    rows = []
    for _ in range(45):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 4, 5, 6, 8, 9, 11, 13, 20, 40, 90, 300]))]
        if rnd.random() < 0.3:
            words += boiler
        group = [words]
        for _ in range(rnd.randrange(0, 6)):
            group.append(edited(rnd, rnd.choice(group), rnd.randrange(0, 1 + len(words) // 20)))
        rows += [(len(rows) + i, "  ".join(g).title() if rnd.random() < 0.2 else " ".join(g)) for i, g in enumerate(group)]
    rows += [(900, None), (901, ""), (902, " \n"), (None, rows[0][1]), (903, rows[5][1])]
    got = ngram_join.join(docs(spark, rows).repartition(4)).collect()
    assert sorted(map(tuple, got), key=str) == brute_join(rows)


def test_join_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op1_ngram_join(spark, SF).collect()), key=str) == brute_join(rows)


def test_frequent_shingles_and_group_without_a_hub(spark, monkeypatch):
    """Hundreds of copies around a base that is not there: they link in chains, and their shingles are frequent."""
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rnd, base, rnd.randrange(1, 4)))) for i in range(160)]
    rows += [(1000 + i, " ".join([*base[:100], *(f"u{i}x{j}" for j in range(rnd.randrange(10, 60)))])) for i in range(60)]
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    got = ngram_join.join(docs(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == brute_join(rows)


@pytest.mark.parametrize("rounds", [2, 4])
def test_no_group_is_one_task(spark, monkeypatch, rounds):
    """A group that no hub settles, some of it linked to hubs, is compared block by block; each two blocks are of bounded size."""
    rnd = random.Random(12)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rnd, base, rnd.choice([0, 1, 2, 3, 4, 6])))) for i in range(150)]
    compared, dealt = [], ngram_join.block_pairs

    def watched(sets):
        pairs = dealt(sets)
        groups = sets.groupBy("comp").agg({"*": "count"}).collect()
        compared.append((max(r[1] for r in groups), pairs.groupBy("comp", "i", "j").count().agg({"count": "max"}).first()[0]))
        return pairs

    monkeypatch.setattr(ngram_join, "block_pairs", watched)
    monkeypatch.setattr(ngram_join, "SIDE", 10)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    got = ngram_join.join(docs(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == brute_join(rows)
    whole, largest = compared[0]
    assert whole > 60 and largest <= 45


def test_block_links(monkeypatch):
    rnd = random.Random(4)
    sets = [np.array(sorted(rnd.sample(range(60), rnd.randrange(1, 60))), np.uint64) for _ in range(40)] + [np.arange(50, dtype=np.uint64)] * 3
    monkeypatch.setattr(ngram_join, "CELLS", 43 * 7)
    every = np.arange(len(sets))
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (ngram_join._shared(sets, every, every) == want).all()
    sizes = np.array([len(s) for s in sets])
    links = ngram_join.block_links(every + 100, sizes, sets, every[:20], every[20:])
    assert len(links) < len(sets) and all(ngram_join.linked(want[a - 100][b - 100], sizes[a - 100], sizes[b - 100]) for a, b in links)
    equal = {frozenset((a - 100, b - 100)) for a, b in ngram_join.block_links(every + 100, sizes, sets, every[40:], every[40:])}
    assert len(equal) == 2 and frozenset.union(*equal) == {40, 41, 42}


def test_boundary_weighs_enumeration_against_lists():
    assert ngram_join.enumerated(1) == 1 and ngram_join.boundary({}) == ngram_join.SMALL
    assert ngram_join.boundary({n: 10 for n in range(1, 33)}) < 12
    assert ngram_join.boundary({9: 5}) == 8


def test_empty_table(spark):
    assert ngram_join.join(docs(spark, [])).count() == 0
    assert ngram_join.join(docs(spark, [(1, None)])).collect() == [(1, 0, 1)]

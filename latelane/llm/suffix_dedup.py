"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes when some string of ``LENGTH`` bytes over it also starts earlier: in a smaller
document, or earlier in the same one.  Equal strings must meet in one task without every
string being sent:

1. each window of LENGTH bytes is named by the smallest hash of the GRAM-byte strings in it.
   Neighbouring windows mostly share that string, so a text falls into runs of windows, each
   with one name.  Equal windows have equal names;
2. the names of all runs are counted, with a hash of the run.  A run whose name is its own cannot
   hold a repeated window.  Names met twice, and names of different runs, are kept as two bitmaps of
   bounded size; full bitmaps would only let more runs pass;
3. runs whose name was met twice are sent to the task of their name, with their text if the name has
   different runs.  Equal runs are first reduced to the earliest one in each task, so a passage
   that a third of all documents share is sent once per task;
   A name of very many different runs (the end of such a passage, with other text behind it in each
   document) would gather them all in one task: its windows are sent one by one instead, each under its own
   hash, so they spread over all tasks and equal ones are again reduced to one per task;
4. there equal runs go but for the earliest.  The windows of different runs with one name are put in
   suffix order, and the previous and next smaller positions in that order give each window's
   longest previous factor.  Where it is LENGTH or more, the window has an earlier copy;
5. the windows with earlier copies are merged into spans per document, and each document is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latelane.llm.common import joined, mixed, pieces, prefix_sums, range_hashes, slices, small, text_buffers
from latelane.session import materialise

LENGTH, GRAM = 100, 32
#: Texts are worked on in pieces of about this many bytes; a longer text is cut into overlapping parts.
PIECE = 1 << 19
#: Bytes of run texts that a task gathers before it reduces and sends them.
BLOCK = 4 << 20
#: Names of runs, and windows, that one task handles at a time on average or at most.
NAMES, WINDOWS = 1 << 19, 100_000
#: A name of more different runs (and of more than one in 2^20 of all runs) has its windows sent one by one.
HOT = 20_000
#: Bits of the two bitmaps of names: four per run, and this many at most (32 MB each).
MOST_BITS = 28

_INDEX_BITS = 20  # places in a piece


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: of the rest of one block and the beginning of the next."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    grid = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, name, prefix sums) of the runs of windows inside the texts of a piece."""
    sums = prefix_sums(data)
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty, np.zeros(0, np.uint64), sums
    starts = np.arange(len(data) - GRAM + 1)
    hashes = range_hashes(sums, starts, starts + GRAM)
    bits = np.uint64(_INDEX_BITS)
    least = _sliding_min((hashes >> bits << bits) | starts.astype(np.uint64), LENGTH - GRAM + 1)
    place = (least & np.uint64((1 << _INDEX_BITS) - 1)).astype(np.int64)
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - LENGTH + 1, 0)
    at = np.concatenate([[0], np.cumsum(windows)])
    inside = np.repeat(offsets[:-1] - at[:-1], windows) + np.arange(at[-1])
    if not len(inside):
        return empty, empty, np.zeros(0, np.uint64), sums
    own = place[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (own[1:] != own[:-1]) | (inside[1:] != inside[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(inside)]]) - 1
    # The smallest hashes are all small; mixed once more they spread evenly again.
    return inside[first], inside[last], mixed(hashes[own[first]]), sums


def _parts(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(document, tie, bytes, offsets, offset of the first byte in its text) of pieces of the texts."""
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        docs, ties = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "tie"))
        for a, b in pieces(offsets, PIECE):
            lo, hi = int(offsets[a]), int(offsets[b])
            if b - a == 1 and hi - lo > PIECE:
                for base in range(0, hi - lo, PIECE):  # windows that start in this part end in it
                    part = data[lo + base : min(hi, lo + base + PIECE + LENGTH - 1)]
                    yield docs[a:b], ties[a:b], part, np.array([0, len(part)]), base
            else:
                yield docs[a:b], ties[a:b], data[lo:hi], offsets[a : b + 1] - lo, 0


# --- which names repeat ------------------------------------------------------------------


def _names(parts: int):
    """Names of a task's runs by ranges, each with the hash of its run, and a mark on those met twice."""
    schema = pa.schema([("part", pa.int32()), ("names", pa.binary()), ("codes", pa.binary()), ("twice", pa.binary())])

    def rows(held):
        names, codes = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((codes, names))
        names, codes = names[order], codes[order]
        heads = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (codes[1:] != codes[:-1])]))
        twice = np.diff(np.concatenate([heads, [len(names)]])) > 1
        names, codes = names[heads], codes[heads]
        part = _part(names, parts)
        edges = np.searchsorted(part, np.arange(parts + 1))
        low = codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
        out = [
            (p, names[a:b].tobytes(), low[a:b].tobytes(), twice[a:b].tobytes())
            for p, (a, b) in enumerate(zip(edges, edges[1:])) if b > a
        ]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)

    def run(batches):
        held, size = [], 0
        for _, _, data, offsets, _ in _parts(batches):
            first, last, names, sums = runs(data, offsets)
            held.append((names, range_hashes(sums, first, last + LENGTH)))
            size += len(names)
            if size >= NAMES:
                yield rows(held)
                held, size = [], 0
        if size:
            yield rows(held)

    return run


def _part(names: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of names, ascending."""
    return ((names >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def _bit(names: np.ndarray, bits: int) -> np.ndarray:
    """The bit of a name: ascending with the name, so that each range of names owns a range of bits."""
    return (names >> np.uint64(64 - bits)).astype(np.int64)


def _repeated(bits: int, hot: int):
    """One range's slices of the two bitmaps (names met twice, names of different runs), and its names of over ``hot`` runs."""

    def sliced(kind: int, names: np.ndarray) -> tuple[int, int, bytes]:
        found = np.unique(_bit(names, bits))
        first = int(found[0]) >> 3
        flags = np.zeros((int(found[-1]) >> 3) - first + 1, np.uint8)  # at most this range's share of the bitmap
        np.bitwise_or.at(flags, (found >> 3) - first, np.left_shift(1, found & 7).astype(np.uint8))
        return kind, first, flags.tobytes()

    def run(key: tuple, table: pa.Table) -> pa.Table:
        names, twice = joined(table["names"], np.uint64), joined(table["twice"], np.bool_)
        codes = np.zeros((len(names), 8), np.uint8)
        codes[:, :6] = joined(table["codes"], np.uint8).reshape(-1, 6)
        codes = codes.view("<u8").ravel()
        order = np.lexsort((codes, names))
        names, codes, twice = names[order], codes[order], twice[order]
        same = names[1:] == names[:-1]
        found = [(0, np.concatenate([names[twice], names[1:][same]])), (1, names[1:][same & (codes[1:] != codes[:-1])])]
        heads = np.flatnonzero(np.concatenate([[True], ~same]))
        many = names[heads][np.diff(np.concatenate([heads, [len(names)]])) > hot]
        slices_ = [sliced(kind, x) for kind, x in found if len(x)] + [(2, 0, many.tobytes())] * bool(len(many))
        out = list(zip(*slices_)) or [(), (), ()]
        return pa.table({"kind": pa.array(out[0], pa.int32()), "at": pa.array(out[1], pa.int64()), "bits": pa.array(out[2], pa.binary())})

    return run


# --- runs of repeated names ---------------------------------------------------------------

_SENT = "part int, docs binary, ties binary, starts binary, sizes binary, names binary, codes binary, given binary, texts binary"
_SENT_SCHEMA = pa.schema(
    [("part", pa.int32()), *((c, pa.binary()) for c in ("docs", "ties", "starts", "sizes", "names", "codes", "given", "texts"))]
)
_FOUND = "shard int, docs binary, ties binary, starts binary, sizes binary"


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return data[np.repeat(starts - ends + sizes, sizes) + np.arange(total)]


def _earliest(names, codes, docs, ties, starts) -> tuple[np.ndarray, np.ndarray]:
    """Order by run, then by place, and a mark on the earliest of equal runs."""
    order = np.lexsort((starts, ties, docs, codes, names))
    first = np.ones(len(order), bool)
    n, c = names[order], codes[order]
    first[1:] = (n[1:] != n[:-1]) | (c[1:] != c[:-1])
    # Rows that share document and text are one document: none of them is earlier than another.
    same = ~first
    d, t, s = docs[order], ties[order], starts[order]
    head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    same &= (d != d[head]) | (t != t[head]) | (s != s[head])
    return order, ~same


def _marked(flags: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (flags[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def _runs_to_send(bitmaps, bits: int, parts: int):
    """Runs whose name repeats: the earliest of equal ones, with its text where the name has different runs, and the
    others as spans that go (parts from ``parts`` on)."""

    def rows(held):
        docs, ties, starts, sizes, names, codes, lengths = (np.concatenate([h[i] for h in held]) for i in range(7))
        texts = np.concatenate([h[7] for h in held])
        at = np.cumsum(lengths) - lengths
        order, keep = _earliest(names, codes, docs, ties, starts)
        part = np.where(keep, _part(names[order], parts), parts + _shard(docs[order], ties[order], parts))
        by = np.argsort(part, kind="stable")
        order, part = order[by], part[by]
        # Of rows that are one document, one run is enough.
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        out = []
        for a, b in zip(edges[:-1], edges[1:]):
            own, p = order[a:b], int(part[a])
            fields = [x[own].tobytes() for x in (docs, ties, starts, sizes.astype(np.int32))]
            if p < parts:
                own_text = _gather(texts, at[own], lengths[own]).tobytes()
                out.append((p, *fields, names[own].tobytes(), codes[own].tobytes(), (lengths[own] > 0).tobytes(), own_text))
            else:
                out.append((p, *fields, b"", b"", b"", b""))
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _SENT_SCHEMA)], schema=_SENT_SCHEMA)

    def run(batches):
        (twice, different, hot), held, size = bitmaps.value, [], 0
        for docs, ties, data, offsets, base in _parts(batches):
            first, last, names, sums = runs(data, offsets)
            some = _marked(twice, _bit(names, bits))
            if not some.any():
                continue
            first, ends, names = first[some], last[some] + LENGTH, names[some]
            codes, single = range_hashes(sums, first, ends), np.isin(names, hot)
            if single.any():  # a window under its own hash, told apart by its run's name too
                n = (ends - first - LENGTH + 1)[single]
                place = np.repeat(first[single] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                own = range_hashes(sums, place, place + LENGTH)
                codes = np.concatenate([codes[~single], np.repeat(names[single], n)])
                names, first = np.concatenate([names[~single], own]), np.concatenate([first[~single], place])
                ends = np.concatenate([ends[~single], place + LENGTH])
                alone = np.arange(len(names)) >= len(names) - len(own)
            else:
                alone = single
            row = np.searchsorted(offsets, first, "right") - 1
            sizes = ends - first
            lengths = np.where(~alone & _marked(different, _bit(names, bits)), sizes, 0)
            held.append((
                docs[row], ties[row], first - offsets[row] + base, sizes, names, codes, lengths, _gather(data, first, lengths),
            ))
            size += len(held[-1][7]) + 48 * len(names)
            if size >= BLOCK:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)

    return run


def _shard(docs: np.ndarray, ties: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(docs.view(np.uint64) ^ mixed(ties.view(np.uint64))) % np.uint64(parts)).astype(np.int32)


# --- suffix order and longest previous factors --------------------------------------------


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller value, or -1: jumps over places known to be larger."""
    found = np.arange(len(values)) - 1
    while True:
        jump = np.flatnonzero((found >= 0) & (values[np.maximum(found, 0)] >= values))
        if not len(jump):
            return found
        found[jump] = found[found[jump]]


def has_earlier(windows: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Whether each window's longest previous factor covers it, given each window's position in the corpus.

    In suffix order the nearest window with a smaller position, before or after, is the earlier
    one with the longest common prefix.  Windows at one position are the same one.
    """
    order = np.argsort(windows, kind="stable")
    equal = windows[order][1:] == windows[order][:-1]
    # Common prefixes of LENGTH tie neighbours together; the longest previous factor cannot reach past a break.
    group = np.concatenate([[0], np.cumsum(~equal)])
    order = order[(np.bincount(group) > 1)[group]]
    if not len(order):
        return np.zeros(len(windows), bool)
    group = np.concatenate([[0], np.cumsum(windows[order][1:] != windows[order][:-1])])
    at = position[order]
    before, after = previous_smaller(at), len(at) - 1 - previous_smaller(at[::-1])[::-1]
    found = np.zeros(len(at), bool)
    ok = before >= 0
    found[ok] = group[before[ok]] == group[ok]
    ok = after < len(at)
    found[ok] |= group[after[ok]] == group[ok]
    result = np.zeros(len(windows), bool)
    result[order] = found
    return result


def _window_spans(docs, ties, starts, sizes, text, at) -> list[tuple]:
    """Runs of windows that go, among runs of shared names (``at``: where each run's text begins in ``text``).

    A window whose hash no other one has cannot be repeated, so only the others are put in suffix order, and of
    those some hashes at a time: a name that very many runs share takes no more memory than others.
    """
    windows = sizes - LENGTH + 1
    ends = np.cumsum(windows)
    place = np.repeat(at - ends + windows, windows) + np.arange(int(ends[-1]))
    own_text, first = _gather(text, at, sizes), np.cumsum(sizes) - sizes
    inside = np.repeat(first - ends + windows, windows) + np.arange(int(ends[-1]))
    hashes = range_hashes(prefix_sums(own_text), inside, inside + LENGTH)
    by = np.argsort(hashes, kind="stable")
    same = hashes[by][1:] == hashes[by][:-1]
    shared = by[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    if not len(shared):
        return []
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), windows)
    heads = np.flatnonzero(np.concatenate([[True], hashes[shared][1:] != hashes[shared][:-1]]))
    chunk = heads // WINDOWS
    cuts = heads[np.concatenate([[True], chunk[1:] != chunk[:-1]])]
    gone = []
    for a, b in zip(cuts, [*cuts[1:], len(shared)]):
        w = shared[a:b]
        o = owner[w]
        d, t, s = docs[o], ties[o], starts[o] + place[w] - at[o]
        order = np.lexsort((s, t, d))
        step = np.ones(len(order), np.int64)
        step[1:] = (d[order][1:] != d[order][:-1]) | (t[order][1:] != t[order][:-1]) | (s[order][1:] != s[order][:-1])
        position = np.empty(len(order), np.int64)
        position[order] = np.cumsum(step)
        view = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, LENGTH)[place[w]])
        gone.append(w[has_earlier(view.view(f"S{LENGTH}").ravel(), position)])
    i = np.sort(np.concatenate(gone))
    if not len(i):
        return []
    new = np.ones(len(i), bool)
    new[1:] = (owner[i][1:] != owner[i][:-1]) | (i[1:] != i[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.concatenate([heads[1:], [len(i)]]) - 1
    o = owner[i[heads]]
    return [(docs[o], ties[o], starts[o] + place[i[heads]] - at[o], i[tails] - i[heads] + LENGTH)]


def _spans(parts: int):
    """Spans that go, of the runs of one range of names; rows of spans are handed on."""

    def emit(found):
        docs, ties, starts, sizes = (np.concatenate([f[i] for f in found]) for i in range(4))
        shard = _shard(docs, ties, parts)
        by = np.argsort(shard, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], shard[by][1:] != shard[by][:-1], [True]]))
        return [
            (int(shard[by[a]]), *(x[by[a:b]].tobytes() for x in (docs, ties, starts, sizes.astype(np.int32))))
            for a, b in zip(edges[:-1], edges[1:])
        ]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        p = key[0].as_py()
        if p >= parts:
            out = [(p - parts, *row) for row in zip(*(table[c].to_pylist() for c in ("docs", "ties", "starts", "sizes")))]
        else:
            docs, ties, starts = (joined(table[c], np.int64) for c in ("docs", "ties", "starts"))
            names, codes = (joined(table[c], np.uint64) for c in ("names", "codes"))
            sizes, texts = joined(table["sizes"], np.int32).astype(np.int64), joined(table["texts"], np.uint8)
            lengths = np.where(joined(table["given"], np.bool_), sizes, 0)
            at = np.cumsum(lengths) - lengths
            order, keep = _earliest(names, codes, docs, ties, starts)
            copies, own = order[~keep], order[keep]
            found = [(docs[copies], ties[copies], starts[copies], sizes[copies])] if len(copies) else []
            # Names with one run left need no comparison; the others are taken some names at a time.
            edges = np.flatnonzero(np.concatenate([[True], names[own][1:] != names[own][:-1], [True]]))
            several = np.repeat(np.diff(edges) > 1, np.diff(edges))
            own = own[several & (lengths[own] > 0)]  # one document's repeated rows have one run and no text
            if len(own):
                new = np.concatenate([[True], names[own][1:] != names[own][:-1]])
                weight = np.cumsum(sizes[own] - LENGTH + 1)
                heads = np.flatnonzero(new)
                chunk = weight[heads] // WINDOWS
                cuts = heads[np.concatenate([[True], chunk[1:] != chunk[:-1]])]
                for a, b in zip(cuts, [*cuts[1:], len(own)]):
                    o = own[a:b]
                    found += _window_spans(docs[o], ties[o], starts[o], sizes[o], texts, at[o])
            out = emit(found) if found else []
        columns = list(zip(*out)) or [()] * 5
        return pa.table({
            "shard": pa.array(columns[0], pa.int32()),
            **{c: pa.array(x, pa.binary()) for c, x in zip(("docs", "ties", "starts", "sizes"), columns[1:])},
        })

    return run


def _merged(key: tuple, table: pa.Table) -> pa.Table:
    """Overlapping and touching spans of each document as one: ``spans`` holds (start, end) pairs."""
    docs, ties, starts = (joined(table[c], np.int64) for c in ("docs", "ties", "starts"))
    sizes = joined(table["sizes"], np.int32)
    order = np.lexsort((starts, ties, docs))
    docs, ties, starts, ends = docs[order], ties[order], starts[order], (starts + sizes)[order]
    new_doc = np.ones(len(docs), bool)
    new_doc[1:] = (docs[1:] != docs[:-1]) | (ties[1:] != ties[:-1])
    group = np.cumsum(new_doc)
    # Ends of one document are shifted past those of the one before, so one running maximum serves all.
    shift = group * (int(ends.max()) + 1)
    reach = np.maximum.accumulate(ends + shift) - shift
    new = new_doc.copy()
    new[1:] |= starts[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    pairs = np.stack([starts[heads], reach[np.concatenate([heads[1:], [len(docs)]]) - 1]], axis=1)
    edges = np.flatnonzero(np.concatenate([new_doc[heads], [True]]))
    return pa.table({
        "doc": pa.array(docs[heads][edges[:-1]], pa.int64()), "tie": pa.array(ties[heads][edges[:-1]], pa.int64()),
        "spans": pa.array([pairs[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()),
    })


_NO_KEY = (1 << 63) - 1


def _cut(batches):
    for batch in slices(batches):
        kept, spans, sizes = [], [], []
        for text, pairs in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
            text, at, out = text or b"", 0, []
            ends = np.frombuffer(pairs or b"", np.int64).reshape(-1, 2).tolist()
            for a, b in ends:
                out.append(text[at:a])
                at = b
            kept.append(b"".join([*out, text[at:]]))
            spans.append([{"start": a, "end": b} for a, b in ends])
            sizes.append(len(text))
        yield pa.RecordBatch.from_arrays(
            [batch.column("k"), pa.array(sizes, pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
            names=["k", "n_bytes", "spans", "kept"],
        )


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts without their later copies of strings of 100 bytes or more.

    One row per input row: ``key``, ``n_bytes``, ``spans`` (maximal removed ranges of bytes: start,
    end) and ``kept`` (the other bytes, in order).  Strings are judged on the input and never
    cross documents.  A null text is empty; a null key comes after all others; rows with one key
    and different texts are ordered by a hash of the text, and rows that share key and text are
    one document, all cut alike.  Texts of fewer than 100 bytes stay whole.  An empty table gives
    no rows.  Other columns are not read.
    """
    spark = df.sparkSession
    texts = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    texts = texts.withColumn("doc", F.coalesce("k", F.lit(_NO_KEY)))
    # Only rows that share a key need a hash of their text to tell them apart.
    shared_keys = texts.groupBy("doc").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    shared_keys = materialise(shared_keys.select("doc", F.lit(True).alias("shared")), "shared_keys")
    if shared_keys.isEmpty():
        texts = texts.withColumn("tie", F.lit(0).cast("long"))
    else:
        texts = texts.join(small(shared_keys), "doc", "left").withColumn(
            "tie", F.when(F.col("shared"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
        ).drop("shared")
    plain = texts.select("doc", "tie", "text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = max(1, total // ((LENGTH - GRAM) // 2))  # runs of windows
    bits = min(MOST_BITS, max(16, (4 * expected).bit_length()))
    parts = max(4, expected // NAMES)
    marks = plain.mapInArrow(_names(parts), "part int, names binary, codes binary, twice binary")
    marks = materialise(marks.groupBy("part").applyInArrow(_repeated(bits, max(HOT, expected >> 20)), "kind int, at long, bits binary"), "repeated_names")
    flags = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(2)]  # 32 MB each at most, whatever the input
    hot = [np.zeros(0, np.uint64)]  # 2^20 names at most
    for row in marks.toLocalIterator():
        if row["kind"] == 2:
            hot.append(np.frombuffer(row["bits"], np.uint64))
            continue
        flags[row["kind"]][row["at"] : row["at"] + len(row["bits"])] |= np.frombuffer(row["bits"], np.uint8)
    shared = spark.sparkContext.broadcast([*flags, np.concatenate(hot)])
    parts *= 4  # texts are larger than names
    sent = plain.mapInArrow(_runs_to_send(shared, bits, parts), _SENT)
    found = sent.groupBy("part").applyInArrow(_spans(parts), _FOUND)
    spans = materialise(found.groupBy("shard").applyInArrow(_merged, "doc long, tie long, spans binary"), "repeated_spans")
    cut = texts.join(small(spans), ["doc", "tie"], "left").select("k", "text", "spans")
    return cut.mapInArrow(
        _cut, "k long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    ).withColumnRenamed("k", key)

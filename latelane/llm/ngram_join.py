"""N-gram Jaccard join of texts: size-aware, heavy and light sets apart.

Small sets enumerate their subsets of the fixed size that a link needs: two sets that share
such a subset are linked, so no candidate is verified.  Large sets scan inverted lists.  The
boundary between the two is where enumerating more would cost more list entries than scanning.

Large sets in steps, each a map over whole texts or a shuffle of packed arrays:

1. every distinct set is sent once per task, cut up by ranges of the shingles' hashes;
2. each range counts the sets of its shingles.  A shingle of one set cannot support a link, so
   only its number goes on; the others return to their set with their frequency;
3. a set whose share of such lone shingles exceeds what a link may miss is finished.  The others
   list their rarest shingles (as many as a link cannot all miss) as join keys;
4. keys are joined as stars around the smallest set, never as all pairs; the connected candidates
   are verified against a hub and then against the member nearest to it, in large groups against further
   hubs, a round each.  By the triangle inequality of Jaccard distance, a set linked to a hub is settled
   when no open set is so near to that hub that the two may be linked;
5. a group whose open sets are known to be connected is done.  In the others, blocks of bounded size are
   compared with each other, except those whose sets are known to be connected, a task for each two blocks.

Shingles in more than one of 512 texts are found first (a list of bounded length) and are never
gathered in one task: they travel with their sets and come last among the keys.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latelane.llm.common import components, joined, mixed, pieces, text_buffers
from latelane.llm.shingles import shingle_sets
from latelane.session import materialise

#: Sets of up to this size are stored with their shingles: the largest boundary that is considered.
SMALL = 32
#: A shingle in more than 1 / FREQUENT of the texts (a list of at most FREQUENT mean set sizes) is never gathered.
FREQUENT = 512
#: Texts are hashed in pieces of about this many bytes, shingles leave a task in blocks of about BLOCK.
PIECE, BLOCK = 1 << 20, 2 << 20
#: Shingles that one range of hashes holds on average.
RANGE = 3 << 20
#: Hubs that a group is verified against at most; beyond the second only while more than SIDE of its sets lack a connection.
ROUNDS = 6
#: Sets, and bytes of their shingles, that one side of a comparison of blocks holds on average.
SIDE, SIDE_BYTES = 1024, 8 << 20
#: Cells of the matrices in which two blocks are compared.
CELLS = 1 << 22

_LAST = np.uint64(1 << 40)  # the frequency of a frequent shingle: after all others


def needed(a: int, b: int) -> int:
    """Smallest intersection of linked sets of sizes ``a`` and ``b``: 100 * i >= 80 * (a + b - i)."""
    return -(-4 * (a + b) // 9)


def linked(inter, a, b):
    return 100 * inter >= 80 * (a + b - inter)


def _batches(batches, *columns):
    """(other columns, hashes, bounds) of each piece of the batches' texts."""
    for batch in batches:
        data, offsets = text_buffers(batch.column("text"))
        rest = [batch.column(c) for c in columns]
        for a, b in pieces(offsets, PIECE):
            hashes, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield [c.slice(a, b - a) for c in rest], hashes, bounds


def _classes(hashes: np.ndarray, bounds: np.ndarray) -> list[int | None]:
    """A 64-bit name for each set; equal sets have the same, an empty set has none."""
    return [
        int.from_bytes(hashlib.blake2b(hashes[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) if b > a else None
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
    ]


# --- 0: sets, small sets' shingles, frequent shingles -------------------------------

_SETS = "doc_id long, n long, cls long, small binary, frequent binary, counts binary, docs long"


def _sets(batches):
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("small", pa.binary()), ("frequent", pa.binary()),
        ("counts", pa.binary()), ("docs", pa.int64()),
    ])
    held, docs, size = [], 0, 0

    def frequent():
        """Shingles that are frequent in the texts gathered; what is frequent in all is so in some gathering."""
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= max(8, docs // FREQUENT)
        row = [None, None, None, None, values[often].tobytes(), counts[often].astype(np.int64).tobytes(), docs]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    for (ids,), hashes, bounds in _batches(batches, "doc_id"):
        n = np.diff(bounds)
        edges = zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
        small = [hashes[a:b].tobytes() if 0 < b - a <= SMALL else None for a, b in edges]
        nothing = pa.nulls(len(n), pa.binary())
        yield pa.RecordBatch.from_arrays([
            ids, pa.array(n, pa.int64()), pa.array(_classes(hashes, bounds), pa.int64()), pa.array(small, pa.binary()), nothing,
            nothing, pa.nulls(len(n), pa.int64()),
        ], schema=schema)
        held.append(hashes)
        docs, size = docs + len(n), size + len(hashes)
        if size >= BLOCK:
            yield frequent()
            held, docs, size = [], 0, 0
    if size:
        yield frequent()


def _frequent(rows: DataFrame, docs: int) -> np.ndarray:
    """Shingles reported by enough texts; at most FREQUENT mean set sizes of them, so they can be held by every task."""

    def unpack(batches):
        for batch in batches:
            for values, counts in zip(batch.column("frequent").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"h": np.frombuffer(values, np.int64), "c": np.frombuffer(counts, np.int64)})

    counted = rows.mapInArrow(unpack, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    kept = counted.filter(F.col("c") >= max(16, docs // FREQUENT)).toPandas()["h"].to_numpy(np.int64)
    return np.sort(kept.view(np.uint64))


# --- small sets: subsets of fixed size ---------------------------------------------------


def enumerated(n: int) -> int:
    """Subsets that a set of size ``n`` lists, over all sizes that it can link with."""
    larger = sum(comb(n, needed(n, b)) for b in range(n, n * 5 // 4 + 1))
    return larger + sum(comb(n, needed(a, n)) for a in range(-(-4 * n // 5), n))


def boundary(counts: dict[int, int]) -> int:
    """The largest size up to which enumerating costs no more list entries than scanning, given sets per size."""
    best = enum = scan = 0
    for n in range(1, SMALL + 1):
        enum += counts.get(n, 0) * enumerated(n)
        scan += counts.get(n, 0) * n
        if enum <= scan:
            best = n
    return best


def _subsets(batches):
    """(key, cls, smaller) per subset; the key binds the two sizes for which sharing it makes a link."""
    for batch in batches:
        keys, classes, smaller = [], [], []
        for cls, data in zip(batch.column("cls").to_pylist(), batch.column("small").to_pylist(), strict=True):
            ids = np.frombuffer(data, np.uint64).tolist()
            n = len(ids)
            for a, b in [(n, b) for b in range(n, n * 5 // 4 + 1)] + [(a, n) for a in range(-(-4 * n // 5), n)]:
                for chosen in combinations(ids, needed(a, b)):
                    text = b"%d %d " % (a, b) + np.array(chosen, np.uint64).tobytes()
                    keys.append(int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True))
                    classes.append(cls)
                    smaller.append(n == a)
        yield pa.RecordBatch.from_pydict({
            "key": pa.array(keys, pa.int64()), "cls": pa.array(classes, pa.int64()), "smaller": pa.array(smaller, pa.bool_()),
        })


def _small_links(sets: DataFrame, most: int) -> DataFrame:
    """Stars around the smallest set of the smaller size: every other set with the key is linked to it."""
    one = sets.filter((F.col("n") <= most) & F.col("small").isNotNull()).groupBy("cls").agg(F.first("small").alias("small"))
    keyed = materialise(one.mapInArrow(_subsets, "key long, cls long, smaller boolean"), "join_subsets")
    hubs = keyed.filter("smaller").groupBy("key").agg(F.min("cls").alias("a"))
    return keyed.join(hubs, "key").filter("a <> cls").select("a", F.col("cls").alias("b")).distinct()


# --- large sets: inverted lists -----------------------------------------------------------

_RANGES = "part int, docs binary, sizes binary, counts binary, ids binary"


def _low_bytes(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_low_bytes(data: bytes | np.ndarray) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _runs(x: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the end."""
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _shard(classes: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(classes) % np.uint64(parts)).astype(np.int32)


def _by_range(bits: int, least: int, frequent: np.ndarray):
    """Distinct sets of a task as rows (range of hashes; sets, their counts and shingles there).

    Ranges from ``1 << bits`` on are parts of the sets: each set's size, and its frequent shingles.
    """
    parts = 1 << bits
    schema = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("docs", "sizes", "counts", "ids"))])

    def rows(held):
        classes, sizes, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
        owner = np.repeat(classes, sizes)
        often = np.isin(hashes, frequent, kind="sort") if len(frequent) else np.zeros(len(hashes), bool)
        out = []
        ids, own = hashes[~often], owner[~often]
        part = (ids >> np.uint64(64 - bits)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, own, ids = part[order], own[order], ids[order] >> np.uint64(16 - bits)
        edges = _runs(part)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            run = _runs(own[a:b])
            out.append((int(part[a]), own[a:b][run[:-1]].tobytes(), None, np.diff(run).astype(np.int32).tobytes(), _low_bytes(ids[a:b])))
        place = np.repeat(np.arange(len(classes)), sizes)[often]
        counts, ids = np.bincount(place, minlength=len(classes)), hashes[often] >> np.uint64(16 - bits)
        starts, shard = np.concatenate([[0], np.cumsum(counts)]), _shard(classes, parts)
        for p in np.unique(shard).tolist():
            chosen = np.flatnonzero(shard == p)
            mine = _ranges(starts[chosen], counts[chosen])
            out.append((
                parts + p, classes[chosen].tobytes(), sizes[chosen].astype(np.int32).tobytes(), counts[chosen].astype(np.int32).tobytes(),
                ids[mine].tobytes(),
            ))
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema, strict=True)], schema=schema)

    def run(batches):
        seen, held, size = set(), [], 0
        for _, hashes, bounds in _batches(batches):
            for cls, a, b in zip(_classes(hashes, bounds), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if b - a < max(1, least) or cls in seen:
                    continue
                seen.add(cls)
                held.append((np.array([cls], np.int64).view(np.uint64), np.array([b - a]), hashes[a:b]))
                size += b - a
            if size >= BLOCK:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)

    return run


_RETURNED = "shard int, part int, docs binary, sizes binary, counts binary, ids binary, freqs binary"


def _counted(bits: int):
    """Shared shingles of one range with their frequencies, sent back by parts of the sets."""
    parts = 1 << bits
    schema = pa.schema([
        ("shard", pa.int32()), ("part", pa.int32()),
        *((c, pa.binary()) for c in ("docs", "sizes", "counts", "ids", "freqs")),
    ])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        part, out = key[0].as_py(), []
        if part >= parts:
            out = [(part - parts, -1, *row, None) for row in zip(*(table[c].to_pylist() for c in _RETURNED_AS_SENT), strict=True)]
            return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema, strict=True)], schema=schema)
        owner = np.repeat(joined(table["docs"], np.uint64), joined(table["counts"], np.int32))
        ids = _from_low_bytes(joined(table["ids"], np.uint8))
        # The same set may come from several tasks; each of its shingles counts once.
        order = np.lexsort((owner, ids))
        owner, ids = owner[order], ids[order]
        first = np.ones(len(ids), bool)
        first[1:] = (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1])
        owner, ids = owner[first], ids[first]
        edges = _runs(ids)
        freq = np.repeat(np.diff(edges), np.diff(edges))
        shared = freq > 1
        owner, ids, freq = owner[shared], ids[shared], freq[shared].astype(np.uint32)
        shard = _shard(owner, parts)
        order = np.lexsort((owner, shard))
        owner, ids, freq, shard = owner[order], ids[order], freq[order], shard[order]
        groups = _runs(shard)
        for a, b in zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True):
            own = _runs(owner[a:b])
            out.append((
                int(shard[a]), part, owner[a:b][own[:-1]].tobytes(), None, np.diff(own).astype(np.int32).tobytes(),
                _low_bytes(ids[a:b]), freq[a:b].tobytes(),
            ))
        columns = list(zip(*out)) or [()] * len(schema)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return run


_RETURNED_AS_SENT = ("docs", "sizes", "counts", "ids")
_OPEN = "cls long, n int, ids binary, keys array<long>"


def _open_sets(key: tuple, table: pa.Table) -> pa.Table:
    """Sets of one part that may have a link: size, shared shingles (ascending) and their rarest as join keys."""
    owners, named, sized, ids, freqs = [], [], [], [], []
    columns = (table[c].to_pylist() for c in ("part", "docs", "sizes", "counts", "ids", "freqs"))
    for part, docs, sizes, counts, low, freq in zip(*columns, strict=True):
        sets = np.frombuffer(docs, np.uint64)
        owners.append(np.repeat(sets, np.frombuffer(counts, np.int32)))
        if part < 0:
            named.append(sets)
            sized.append(np.frombuffer(sizes, np.int32))
            ids.append(np.frombuffer(low, np.uint64))
            freqs.append(np.full(len(ids[-1]), _LAST))
        else:
            ids.append(_from_low_bytes(low) | np.uint64(part << 48))
            freqs.append(np.frombuffer(freq, np.uint32).astype(np.uint64))
    owners, named, sized, ids, freqs = (np.concatenate(x) for x in (owners, named, sized, ids, freqs))
    sets, place = np.unique(named, return_index=True)
    n = sized[place].astype(np.int64)
    order = np.lexsort((ids, owners))
    owners, ids, freqs = owners[order], ids[order], freqs[order]
    fresh = np.ones(len(ids), bool)  # a frequent shingle of a set may come from several tasks
    fresh[1:] = (ids[1:] != ids[:-1]) | (owners[1:] != owners[:-1])
    owners, ids, freqs = owners[fresh], ids[fresh], freqs[fresh]
    starts, ends = np.searchsorted(owners, sets), np.searchsorted(owners, sets, "right")
    lone = n - (ends - starts)
    room = n - -(-4 * n // 5) + 1 - lone  # keys that a link cannot all miss, lone ones first
    out = [[], [], [], []]
    for i in np.flatnonzero((room > 0) & (ends > starts)).tolist():
        a, b = starts[i], ends[i]
        rare = np.lexsort((ids[a:b], freqs[a:b]))[: room[i]]
        out[0].append(int(sets[i].astype(np.int64)))
        out[1].append(int(n[i]))
        out[2].append(ids[a:b].tobytes())
        out[3].append(ids[a:b][rare].astype(np.int64))
    return pa.table({
        "cls": pa.array(out[0], pa.int64()), "n": pa.array(out[1], pa.int32()), "ids": pa.array(out[2], pa.binary()),
        "keys": pa.array(out[3], pa.list_(pa.int64())),
    })


def _against_hub(batches):
    """Each candidate against the hub of its group: whether they are linked, and their distance."""
    for batch in batches:
        near, distance = [], []
        for n, ids, hub_n, hub in zip(*(batch.column(c).to_pylist() for c in ("n", "ids", "hub_n", "hub_ids")), strict=True):
            inter = len(np.intersect1d(np.frombuffer(ids, np.uint64), np.frombuffer(hub, np.uint64), assume_unique=True))
            near.append(linked(inter, n, hub_n))
            distance.append(1 - inter / (n + hub_n - inter))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("comp", "hub", "cls")), pa.array(near, pa.bool_()), pa.array(distance, pa.float64())],
            names=["comp", "hub", "cls", "near", "distance"],
        )


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at ``left`` with those at ``right``."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = counts > 1  # a shingle of one set is in no intersection
    chosen = several[column]
    owner, column = owner[chosen], (np.cumsum(several) - 1)[column[chosen]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    inter, width = np.zeros((len(left), len(right)), np.int64), max(1, CELLS // len(sets))
    for first in range(0, int(several.sum()), width):
        a, b = np.searchsorted(column, [first, first + width])
        cells = np.zeros((len(sets), min(width, int(column[b - 1]) + 1 - first)), np.float32)
        cells[owner[a:b], column[a:b] - first] = 1
        inter += (cells[left] @ cells[right].T).astype(np.int64)
    return inter


def block_links(classes: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect exactly the sets that links between ``left`` and ``right`` (places) connect: a forest of them."""
    near = np.zeros((len(sets), len(sets)), bool)
    near[np.ix_(left, right)] = linked(_shared(sets, left, right), sizes[left][:, None], sizes[right][None, :])
    near |= near.T
    found, unseen = [], np.ones(len(sets), bool)
    for start in range(len(sets)):
        reached = [start] if unseen[start] else []
        unseen[start] = False
        while reached:
            at = reached.pop()
            further = np.flatnonzero(near[at] & unseen).tolist()
            unseen[further] = False
            found += [(int(classes[at]), int(classes[i])) for i in further]
            reached += further
    return found


def _between_blocks(key: tuple, table: pa.Table) -> pa.Table:
    i, j, block = key[1].as_py(), key[2].as_py(), table["block"].to_numpy()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    found = []
    if len(left) and len(right):
        sets = [np.frombuffer(x, np.uint64) for x in table["ids"].to_pylist()]
        found = block_links(table["cls"].to_numpy(), table["n"].to_numpy().astype(np.int64), sets, left, right)
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def block_pairs(sets: DataFrame) -> DataFrame:
    """The stored ``sets`` (comp, cls, main, n, ids) dealt into blocks, once for each two blocks (i, j) of a group to compare.

    Sets of a group with ``main`` are known to be connected, so they only meet those without.
    """
    rows, held = F.count_if, lambda main: F.sum(F.when(main, F.octet_length("ids")).otherwise(0))

    def blocks(main):
        return F.greatest(F.ceil(rows(main) / SIDE), F.ceil(held(main) / SIDE_BYTES)).cast("int")

    cut = materialise(sets.groupBy("comp").agg(blocks(~F.col("main")).alias("others"), blocks(F.col("main")).alias("mains")), "join_blocks")
    salt = F.xxhash64("cls")
    block = F.when(F.col("main"), F.col("others") + F.pmod(salt, F.col("mains"))).otherwise(F.pmod(salt, F.col("others"))).cast("int")
    dealt = sets.join(cut.filter("others > 0"), "comp").withColumn("block", block)
    last = F.when(F.col("main"), F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    return met.select("comp", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "cls", "n", "ids")


def _verified(grouped: DataFrame) -> DataFrame:
    """Links (a, b) that connect exactly the linked sets of each group of the stored ``grouped`` (cls, n, ids, comp)."""

    def against(hubs: DataFrame, name: str) -> DataFrame:
        """Members of the groups of ``hubs`` (comp, hub) against their hub."""
        hub = grouped.join(hubs.select("comp", F.col("hub").alias("cls")), ["comp", "cls"]).select(
            "comp", F.col("cls").alias("hub"), F.col("n").alias("hub_n"), F.col("ids").alias("hub_ids"))
        others = grouped.join(materialise(hub, f"{name}_hubs"), "comp").filter("cls <> hub")
        return materialise(others.mapInArrow(_against_hub, "comp long, hub long, cls long, near boolean, distance double"), name)

    # Sets with links that may not be implied yet; main: known to be connected with the others so marked.
    opened = grouped.select("comp", "cls", F.lit(False).alias("main"))
    hubs = grouped.select("comp", F.col("comp").alias("hub"), F.lit(False).alias("hub_main")).distinct()
    links, left = [], []
    for number in range(1, ROUNDS + 1):
        met = against(hubs, f"join_round{number}")
        links.append(met.filter("near").select(F.col("hub").alias("a"), F.col("cls").alias("b")))
        # The hub is settled: all of its links are found.
        met = opened.join(met.select("comp", "cls", "near", "distance"), ["comp", "cls"]).join(hubs, "comp")
        groups = met.groupBy("comp").agg(
            F.min(F.when(~F.col("near"), F.col("distance"))).alias("nearest"),
            F.bool_or(F.col("hub_main") | (F.col("main") & F.col("near"))).alias("meets"),
            (F.count_if("near") > F.count_if("main")).alias("more"),
        )
        main = F.when(F.col("meets"), F.col("main") | F.col("near")).when(F.col("more"), F.col("near")).otherwise(F.col("main"))
        # A link of a set linked to the hub leads to one that is at most the limit (0.2) further from the hub.
        kept = ~F.col("near") | (F.col("distance") + 0.2 + 1e-9 >= F.col("nearest"))
        met = met.join(materialise(groups, "join_nearest"), "comp").filter(kept).select("comp", "cls", "distance", main.alias("main"))
        met = materialise(met, "join_opened")
        choice = F.struct("distance", "cls")
        # Copies of a text are more like it than like each other: where the first hub does not reach all, the member
        # nearest to it is the better middle of the group.
        found = met.groupBy("comp").agg(
            F.count_if(~F.col("main")).alias("others"), F.count(F.lit(1)).alias("sets"),
            (F.min(choice) if number == 1 else F.min(F.when(~F.col("main"), choice))).alias("hub"),
        ).filter("others > 0 and sets > 1")
        found = materialise(found.select("comp", "others", F.col("hub.cls").alias("hub")), "join_middles")
        further = F.lit(number < ROUNDS) & (F.lit(number == 1) | (F.col("others") > SIDE))
        left.append(met.join(found.filter(~further).select("comp"), "comp", "left_semi").select("comp", "cls", "main"))
        going = found.filter(further)
        if going.isEmpty():
            break
        opened = met.join(going.select("comp"), "comp", "left_semi").select("comp", "cls", "main")
        hubs = going.select("comp", "hub").join(
            met.select("comp", F.col("cls").alias("hub"), F.col("main").alias("hub_main")), ["comp", "hub"])
    rest = materialise(reduce(DataFrame.unionByName, left), "join_left")
    if not rest.isEmpty():
        pairs = block_pairs(materialise(grouped.join(rest, ["comp", "cls"]), "join_compared"))
        links.append(pairs.groupBy("comp", "i", "j").applyInArrow(_between_blocks, "a long, b long"))
    return reduce(DataFrame.unionByName, links)


def _large_links(texts: DataFrame, least: int, total: int, frequent: np.ndarray) -> DataFrame:
    bits = min(16, max(4, (total // RANGE).bit_length()))
    ranged = texts.select("text").mapInArrow(_by_range(bits, least, frequent), _RANGES)
    returned = ranged.groupBy("part").applyInArrow(_counted(bits), _RETURNED)
    open_sets = materialise(returned.groupBy("shard").applyInArrow(_open_sets, _OPEN), "join_open")
    keyed = open_sets.select("cls", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("cls").alias("a"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    stars = keyed.join(hubs, "key").filter("a <> cls").select("a", F.col("cls").alias("b")).distinct()
    candidates = components(stars, "join_candidates").select(F.col("node").alias("cls"), F.col("component").alias("comp"))
    grouped = materialise(open_sets.select("cls", "n", "ids").join(candidates, "cls"), "join_grouped")
    return _verified(grouped)


def join(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    One row per input row: ``key``, ``n_shingles``, ``component_id`` (smallest key reachable by
    links, itself included).  A-Z are lowered; words end at white space; a text of fewer than
    five words has its whole sequence as one shingle.  Texts without words and null texts have no
    shingle and link with nothing, their component is their own key.  Equal sets are one class,
    linked whatever their number.  A key on several rows stands for all of them; a null key has
    no component of its own but may belong to one.  An empty table gives no rows.  Other columns
    are not read.  Sets are compared by 64-bit hashes of their shingles.
    """
    texts = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    stored = materialise(texts.mapInArrow(_sets, _SETS), "join_sets")
    sets = stored.filter("docs is null")
    docs, total = sets.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    per_size = sets.filter(F.col("n").between(1, SMALL)).groupBy("n").count().collect()  # SMALL rows at most
    most = boundary({r["n"]: r["count"] for r in per_size})
    frequent = _frequent(stored.filter("docs is not null"), docs)
    # A small set meets a larger one beyond the boundary in the lists.
    links = _small_links(sets, most).unionByName(_large_links(texts, -(-4 * (most + 1) // 5), total, frequent))
    groups = components(materialise(links, "join_links"), "join")
    named = sets.select("doc_id", "n", "cls").join(groups, F.col("cls") == F.col("node"), "left").select(
        "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("component", "cls")).alias("g")
    )
    named = materialise(named, "join_named")
    least = materialise(named.filter("g is not null").groupBy("g").agg(F.min("doc_id").alias("component_id")), "join_least")
    # Both sides are shuffled for this join, so AQE splits the partitions of a large group.
    return named.join(least, "g", "left").select(
        F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )

"""Digest index, sharding and packing against plain Python."""

import hashlib
import re

import pytest

from latelane.errors import StoreError
from latelane.llm import digest_index, ext_sharding, packing

DOCS = "doc_id long, text string, source string, k string, digest string, at long, n_bytes string, region int"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those the operators use inside."""
    full = [(d, t, s, "x", "y", 1, "z", 2) for d, t, s in rows]
    return spark.createDataFrame(full, DOCS)


ROWS = [
    (5, "a  b", "s"), (3, "a\tb", "s"), (9, "c", None), (9, "c", "t"), (4, None, "s"), (2, "", "u"), (None, "a b", "s"),
    (None, "only", "s"), (7, " ", "s"), (8, "long " * 30_000, "s"),
]


def _digest(t):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()


def test_exact_dedup_ties_nulls_repeats(spark):
    got = digest_index.DigestIndex(spark, buckets=3).deduplicate(docs(spark, ROWS)).collect()
    assert len(got) == len(ROWS)
    want = {}
    for d, t, _ in ROWS:
        want.setdefault(_digest(t), []).append(d)
    for h, ids in want.items():
        rows = [r for r in got if r.text_sha256 == h]
        keep = min((i for i in ids if i is not None), default=None)
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in rows)
        assert {r.keep_id for r in rows} == {keep} and {r.group_size for r in rows} == {len(ids)}
        assert [r.doc_id for r in rows if r.kept] == [keep]


def test_index_remembers_earlier_batches(spark):
    index = digest_index.DigestIndex(spark, buckets=4)
    first = index.deduplicate(docs(spark, [(10, "one", "s"), (11, "two", "s")])).collect()
    assert all(r.kept for r in first)
    second = {r.doc_id: r for r in index.deduplicate(docs(spark, [(1, "one", "s"), (2, "three", "s")])).collect()}
    assert (second[1].keep_id, second[1].kept) == (10, False) and second[2].kept
    assert index.rows().count() == 3
    assert index.deduplicate(docs(spark, [])).count() == 0


def test_index_is_opened_again(spark, tmp_path):
    """By its path, also from another session, with its own buckets; nothing is lost and nothing is written by opening."""
    path = str(tmp_path / "index")
    index = digest_index.DigestIndex(spark, path, buckets=3)
    index.deduplicate(docs(spark, [(10, "one", "s"), (11, "two", "s")])).collect()
    for session in (spark, spark.newSession()):
        again = digest_index.DigestIndex.open(session, path)
        assert again.buckets == 3 and again.rows().count() == 2
        plan = again.rows().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
    other = digest_index.DigestIndex(spark.newSession(), path)
    rows = other.spark.createDataFrame([(1, "one", 0), (2, "three", 0)], "doc_id long, text string, batch int")
    got = {r.doc_id: (r.keep_id, r.kept) for r in other.deduplicate(rows).collect()}
    assert got == {1: (10, False), 2: (2, True)}
    assert digest_index.DigestIndex.open(spark, path).rows().count() == 3
    with pytest.raises(StoreError, match="no digest index"):
        digest_index.DigestIndex.open(spark, str(tmp_path / "absent"))
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "file").write_text("x")
    with pytest.raises(StoreError, match="holds files"):
        digest_index.DigestIndex(spark, str(tmp_path / "other"))


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    """A result that was lost is asked for again: the same answer, and no row more in the index."""
    index = digest_index.DigestIndex(spark, str(tmp_path / "index"), buckets=2)
    index.deduplicate(docs(spark, [(1, "old", "s")]))
    batch = docs(spark, [(5, "old", "s"), (6, "new", "s"), (7, "new", "t"), (7, "new", "t"), (None, None, "s")])
    index.deduplicate(batch)  # never read
    first = sorted(map(str, index.deduplicate(batch).collect()))
    second = sorted(map(str, digest_index.DigestIndex.open(spark, str(tmp_path / "index")).deduplicate(batch.repartition(3)).collect()))
    assert first == second and index.rows().count() == 3
    assert sum("kept=True" in r for r in first) == 2
    later = index.deduplicate(docs(spark, [(2, "new", "s")])).first()
    assert (later.keep_id, later.kept) == (6, False)


def test_rows_kept_keep_all_columns(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a ", "y"), (3, "a", "z")], "doc_id long, text string, __sha256 string")
    got = digest_index.DigestIndex(spark, buckets=2).keep_first(df)
    assert got.columns == df.columns and [tuple(r) for r in got.orderBy("doc_id").collect()] == [(1, "a", "x"), (2, "a ", "y")]


def test_index_join_is_a_sort_merge_without_shuffling_the_index(spark):
    index = digest_index.DigestIndex(spark)
    seen = index.rows()
    plan = seen.groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("limit", [50, 4000, 10**9])
def test_shards_hold_at_most_the_limit(spark, limit):
    rows = [(i, "w" * (i % 97), "s") for i in range(700)] + [(i, None, "s") for i in range(700, 710)] + [(None, "n", "s")]
    got = ext_sharding.assign(docs(spark, rows), limit).collect()
    assert len(got) == len(rows)
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    for bits, members in shards.items():
        total = sum(r.n_bytes for r in members)
        assert len(bits) == members[0].depth and (total <= limit or len(members) == 1)
        assert {r.shard_bytes for r in members} == {total} and {r.shard_docs for r in members} == {len(members)}
    # A directory: no shard's bits lead another's, and every split was needed.
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)
    for bits in shards:
        if bits:
            parent = [r for r in got if r.shard.startswith(bits[:-1])]
            assert sum(r.n_bytes for r in parent) > limit and len(parent) > 1
    bits = {r.doc_id: r.shard for r in got if r.doc_id is not None}
    for d, shard in bits.items():
        h = int(hashlib.md5(str(d).encode()).hexdigest()[:15], 16)
        assert f"{h:060b}".startswith(shard)


def test_one_key_is_split_by_place(spark):
    got = ext_sharding.assign(docs(spark, [(1, "x" * 10, "s")] * 40 + [(2, "y", "s")]), 55).collect()
    assert len(got) == 41 and max(r.shard_bytes for r in got) <= 55
    assert ext_sharding.assign(docs(spark, []), 55).count() == 0


def test_no_shard_table_reaches_the_driver(spark):
    """Neither the rows nor the directory are broadcast, however small their files: a few bytes there can be many rows."""
    plan = ext_sharding.assign(docs(spark, [(i, "abc", "s") for i in range(30)] + [(31, "x", "s")] * 30), 20)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_write_shards(spark):
    path = ext_sharding.write_shards(docs(spark, [(i, "abc", "s") for i in range(30)]), 20)
    assert sorted(r.doc_id for r in spark.read.parquet(path).collect()) == list(range(30))


def test_write_shards_keeps_columns_of_its_own_names(spark):
    df = spark.createDataFrame([(i, "abc", "mine", "too", "_s") for i in range(9)], "doc_id long, text string, shard string, place string, _shard string")
    got = spark.read.parquet(ext_sharding.write_shards(df, 9))
    assert got.count() == 9 and {(r.shard, r.place, r["_shard"]) for r in got.select("shard", "place", "_shard").collect()} == {("mine", "too", "_s")}
    assert "__shard" in got.columns


def test_write_shards_writes_every_row_once(spark):
    """A third of the rows under one key, a third under none."""
    rows = [(i if i % 3 == 0 else 7 if i % 3 == 1 else None, f"{i:03d}", "s") for i in range(90)]
    written = spark.read.parquet(ext_sharding.write_shards(docs(spark, rows).repartition(3), 20))
    got = written.selectExpr("doc_id", "text", "regexp_extract(input_file_name(), 'shard=([^/]*)', 1) as folder").collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(d), t) for d, t, _ in rows)
    held = {}
    for r in got:
        held[r.folder] = held.get(r.folder, 0) + len(r.text)
    assert max(held.values()) <= 20


def _naive(lengths, bits, capacity):
    bins = []
    for n, b in zip(lengths, bits):
        fits = [(x[0], i) for i, x in enumerate(bins) if x[0] >= n and not x[1] & b]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([capacity, 0])
        bins[i][0] -= n
        bins[i][1] |= b
        yield i


def test_place_is_best_fit():
    import random

    rnd = random.Random(1)
    lengths = sorted((rnd.randrange(0, 60) for _ in range(800)), reverse=True)
    bits = [1 << rnd.choice([0] * 5 + list(range(1, 12))) for _ in lengths]
    assert packing.place(lengths, bits, 100) == list(_naive(lengths, bits, 100))


def test_packing_keeps_everything_and_conflicts_apart(spark):
    rows = [(i, "w " * (i % 45), f"s{i % 7}") for i in range(400)] + [(None, None, None), (1, "w ", "s1"), (1, "w ", "s1")]
    rows += [(1000, "v " * 205, "s0"), (1001, " \t", "s9")]
    got = packing.pack(docs(spark, rows), 50, rows=64).collect()
    words = {}
    for r in got:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.n_words
    assert sum(words.values()) == sum(len((t or "").split()) for _, t, _ in rows)
    assert sorted(r.first_word for r in got if r.doc_id == 1000) == [0, 50, 100, 150, 200]
    source = {d: s for d, _, s in rows}
    text = {d: (t or "") for d, t, _ in rows}
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    for members in bins.values():
        assert sum(r.n_words for r in members) == members[0].bin_words <= 50
        assert sorted(r.slot for r in members) == list(range(len(members)))
        named = [source[r.doc_id] for r in members if source[r.doc_id] is not None]
        assert len(set(named)) == len(named)
        assert len({" ".join(text[r.doc_id].split()) for r in members}) == len(members) or not any(r.n_words for r in members)
    assert packing.pack(docs(spark, []), 50).count() == 0

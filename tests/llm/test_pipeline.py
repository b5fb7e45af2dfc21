"""Every stage of the pipeline against a brute-force version on its own input."""

import re

import corpus_pipeline
import pytest
from latelane.llm import ordinal, surrogates
from latelane.llm.common import read
from latelane.llm.queries import LEAST_TAIL, SEQUENCE_WORDS
from latelane.session import materialise
from tests.conftest import SF
from tests.llm.test_repeats import brute_join


@pytest.fixture(scope="module")
def steps(spark):
    docs = read(spark, SF, "documents")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(materialise(stage(spark, found[-1], SF), f"test_{name}"))
    return found


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns_stay(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "redact", "pack"]
    assert all(s.columns == steps[0].columns and s.dtypes == steps[0].dtypes for s in steps[:5])


def test_quality(spark, steps):
    model = ordinal.train(steps[0], read(spark, SF, "labels"), ordinal.grade_of_labels())
    assert ids(steps[1]) == ids(ordinal.score(steps[0], model).filter(f"tail >= {LEAST_TAIL}"))
    assert 0 < len(ids(steps[1])) < steps[0].count()


def test_exact(steps):
    first = {}
    for r in steps[1].collect():
        key = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        first[key] = min(first.get(key, r.doc_id), r.doc_id)
    assert ids(steps[2]) == sorted(first.values())


def test_near(steps):
    rows = [(r.doc_id, r.text) for r in steps[2].collect()]
    assert ids(steps[3]) == sorted(d for d, _, c in brute_join(rows) if d == c)


def test_private(steps):
    new = {r.doc_id: r for r in steps[4].collect()}
    for r in steps[3].collect():
        found = surrogates.find(r.text or "")
        assert new[r.doc_id].n_chars == len(new[r.doc_id].text) and (new[r.doc_id].text == r.text) == (not found)
        assert not any(value in new[r.doc_id].text for _, _, _, value in found)
    assert len(new) == steps[3].count()


def test_packed(steps):
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in steps[4].collect()}
    source = {r.doc_id: r.source for r in steps[4].collect()}
    got, bins, texts = {}, {}, {}
    for r in sorted(steps[5].collect(), key=lambda r: r.piece):
        texts[r.doc_id] = texts.get(r.doc_id, "") + (r.text or "")
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_words
        bins.setdefault(r.bin_id, []).append(r)
    assert got == words and texts == {r.doc_id: r.text or "" for r in steps[4].collect()}
    assert max(r.n_pieces for members in bins.values() for r in members) > 1
    for members in bins.values():
        assert sum(r.n_words for r in members) <= SEQUENCE_WORDS
        assert len({source[r.doc_id] for r in members}) == len(members)


def test_run_is_the_stages(spark, steps):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "n_words").collect())) == sorted(
        map(str, steps[5].select("doc_id", "piece", "n_words").collect()))


def test_awkward_rows(spark):
    rows = [(1, None, "en", None, 0), (None, "good text here for all", "en", "s", 1), (1, None, "en", None, 0), (2, "", None, "s", None),
            (3, "good text here for all", "en", "s", 1), (3, "good text here for all", "en", "s", 1)]
    df = spark.createDataFrame(rows, steps_schema := "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, SF).count() >= 0
        assert stage(spark, spark.createDataFrame([], steps_schema), SF).count() == 0
    kept = corpus_pipeline.exact_dedup(spark, df, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3"]


def test_near_copies_go_by_row(spark):
    """An id on several rows, and rows without an id: only near copies go, and one row of each group stays."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " end"), (2, "a clean text that nothing else is like"), (5, text.replace("w7", "x")), (5, "short of five"),
            (None, text + " more"), *((None, " ".join(f"n{j}" for j in range(50)) + f" {i}") for i in range(9)),
            (7, " ".join(f"s{j}" for j in range(50))), (7, " ".join(f"s{j}" for j in range(50)) + " t"), (8, None), (None, None)]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, df.repartition(4), SF).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "5", "7", "8", "None", "None"]
    assert {r.text for r in got if r.doc_id in (1, 2, 5)} == {rows[0][1], rows[2][1], rows[4][1]}


def test_extra_columns_with_clashing_names(spark):
    names = ["place", "at", "row_place", "group", "__sha256", "__place", "tail", "grade", "k", "n", "shard", "bin_id", "piece"]
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "en", "s", 1, *names), (2, text + " end", "en", "t", 1, *names), (3, text, "en", "t", 1, *names), (4, None, "en", "t", 1, *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        got = out.collect()
        if name != "pack":
            assert out.columns == df.columns and all([r[n] for n in names] == names for r in got)
            if name != "quality":  # what a fitted model says of these is not the matter here
                assert sorted(r.doc_id for r in got) == {"exact_dedup": [1, 2, 4], "near_dedup": [1, 4], "redact": [1, 2, 3, 4]}[name]
        else:
            assert sorted((r.doc_id, r.text) for r in got if r.text) == [(1, text), (2, text + " end"), (3, text)]

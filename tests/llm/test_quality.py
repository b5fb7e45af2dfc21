"""Ordinal classifier: features, fit, held-out accuracy, selection."""

import numpy as np
from pyspark.sql import functions as F

from latelane.llm import ordinal
from latelane.llm.common import read
from latelane.llm.queries import op7_quality_classifier

SF = "/root/testdata/sf0.01"


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def test_features_are_those_of_each_text_alone():
    texts = ["Hello, WORLD hello!!", "", " ", "hello world", "é x|y", "hello, world hello!!"]
    numbers, bounds = ordinal.features(*packed(texts))
    for i, t in enumerate(texts):
        alone, _ = ordinal.features(*packed([t]))
        assert numbers[bounds[i] : bounds[i + 1]].tolist() == alone.tolist() == sorted(set(alone.tolist()))
    assert len(ordinal.features(*packed([]))[0]) == 0
    hashed = [set(n for n in numbers[bounds[i] : bounds[i + 1]].tolist() if n < 1 << ordinal.HASH_BITS) for i in (0, 5, 3)]
    assert hashed[0] == hashed[1] > hashed[2]


def test_ordered_thresholds_and_tails():
    rng = np.random.default_rng(1)
    true = rng.integers(0, 4, 900)
    texts = [" ".join(rng.choice([f"g{g}", f"g{min(3, g + 1)}", "noise"], 12)) for g in true]
    model = ordinal.fit(*ordinal.features(*packed(texts)), true)
    assert (np.diff(model.thresholds) >= 0).all() and len(model.thresholds) == 3
    scores = model.scores(*ordinal.features(*packed(texts)))
    tails = model.tails(scores)
    assert (np.diff(tails, axis=1) <= 1e-12).all()
    expected = tails.sum(1)
    assert all(expected[true == g].mean() < expected[true == g + 1].mean() - 0.5 for g in range(3))


def test_held_out_accuracy(spark):
    """Fitted on the labels of even documents, judged on those of odd ones.

    The bound for toxic documents leaves room for the table's own noise: of the 35 held out, five are
    rated toxic without holding any of the words that only toxic documents hold.
    """
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    model = ordinal.train(docs, labels.filter("doc_id % 2 = 0"), ordinal.grade_of_labels())
    held = ordinal.score(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").withColumn("grade", ordinal.grade_of_labels())
    kept = {r.grade: (r.kept, r.n) for r in held.groupBy("grade").agg(
        F.sum((F.col("tail") >= 0.5).cast("int")).alias("kept"), F.count(F.lit(1)).alias("n")).collect()}
    assert kept[2][0] >= 0.95 * kept[2][1] and kept[0][0] <= 0.25 * kept[0][1] and kept[1][0] <= 0.35 * kept[1][1]


def test_query_selects_and_awkward_rows(spark):
    rows = op7_quality_classifier(spark, SF)
    assert rows.count() == read(spark, SF, "documents").count()
    assert 0.7 < rows.agg(F.avg(F.col("kept").cast("int"))).first()[0] < 0.95
    model = ordinal.Model(np.zeros(ordinal.WIDTH), np.array([-1.0, 0.0]))
    df = spark.createDataFrame([(1, None, 2, "t"), (None, "", 3, "t"), (1, "a " * 50_000, 4, "t")], "doc_id long, text string, k int, tail string")
    got = ordinal.score(df, model).collect()
    assert len(got) == 3 and {r.tail for r in got} == {0.5}
    assert ordinal.select(df, model, 0.5).columns == df.columns and ordinal.select(df, model, 0.6).count() == 0
    assert sorted(map(str, ordinal.select(df, model, 0.5).collect())) == sorted(map(str, df.collect()))
    assert ordinal.score(df.filter("false"), model).count() == 0
    none = ordinal.train(df, spark.createDataFrame([(9, None, None)], "doc_id long, quality int, toxic int"), ordinal.grade_of_labels())
    assert ordinal.score(df, none).count() == 3

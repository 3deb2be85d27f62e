"""Language and quality models: held-out accuracy on the given tables, odd rows, and that nothing but text is used."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postaudit.llm import features, langid, quality

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


ODD = [(1, None), (2, ""), (3, "123 !? \n"), (None, "le la les"), (4, "w " * 50_000), (5, "x" * 100_000), (3, "abc")]


def odd(spark):
    return spark.createDataFrame([(i, t, "s", 0.5, True) for i, t in ODD],
                                 "doc_id long, text string, label string, score double, held_out boolean")


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_languages(spark, docs):
    model = langid.fit(docs)
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and len(held) == sum(is_held_out(r.doc_id) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    got = langid.identify(odd(spark), model).collect()
    assert [r.lang_pred for r in got if r.doc_id in (1, 2)] == ["und", "und"]
    assert {r.lang_pred == "und" for r in got if r.doc_id == 3} == {True, False}
    assert all(r.held_out == is_held_out(r.doc_id) for r in got)
    assert langid.identify(docs.limit(0), model).collect() == []


def test_nothing_learnt(spark, docs):
    rows = langid.identify(docs.limit(3), langid.fit(docs.limit(0))).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in rows} == {("und", 0.0, True)}


def test_rejection():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(300):
        lang = "ab"[i % 2]
        own = rng.integers(0, 200, 20) + 1000 * (i % 2)
        mixed = own if i % 10 else rng.integers(0, 1200, 20)
        buckets, counts = np.unique(mixed, return_counts=True)
        rows.append((lang, buckets, counts.astype(np.float32)))
    model = langid.train(rows)
    assert model.languages == ["a", "b"] and 0.5 <= model.threshold <= 1


def test_quality(spark, docs, labels):
    model = quality.fit(docs, labels)
    rows = quality.rate(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.93
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    got = quality.rate(odd(spark), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    left = quality.drop_poor(docs, model)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.select("doc_id").collect()} == {
        r.doc_id for r in quality.rate(docs, model).collect() if r.predicted}
    assert quality.rate(docs.limit(0), model).collect() == []


def test_quality_without_labels(spark, docs, labels):
    none = quality.fit(docs, labels.limit(0))
    assert none.score("any") == pytest.approx(0.5)
    ones = quality.fit(docs, labels.filter("quality = 1").limit(20))
    assert ones.score("any") > 0.9


def test_held_out_rows_are_not_learnt(spark, docs, labels):
    own = labels.filter(~features.held_out(labels.doc_id))
    a, b = quality.fit(docs, own), quality.fit(docs, labels)
    assert np.allclose(a.weights, b.weights)
    swapped = docs.withColumnsRenamed({"source": "lang_", "lang": "source"}).withColumnRenamed("lang_", "lang")
    one = {r.doc_id: r.score for r in quality.rate(docs, b).collect()}
    assert one == {r.doc_id: r.score for r in quality.rate(swapped, b).collect()}


def test_ratios_and_descent():
    rows = [np.array([0, 1]), np.array([0, 2]), np.array([3, 1]), np.array([3, 4])]
    good = np.array([True, True, False, False])
    ratios = quality.log_ratios(rows, good)
    assert ratios[0] == pytest.approx(np.log(3)) and ratios[3] == pytest.approx(-np.log(3)) and ratios[1] == 0
    weights, bias = quality.dual_descent(rows, np.where(good, 1.0, -1.0), ratios, np.full(4, 1.0), 200)
    margins = [weights[r] @ ratios[r] / np.sqrt(2) + bias for r in rows]
    assert min(margins[:2]) > 0 > max(margins[2:])


def test_pieces_cut_at_white_space():
    raw = features.raw_bytes("ab cd ef gh" * 30)
    parts = list(features.pieces(raw, 50))
    assert np.concatenate(parts).tolist() == raw.tolist() and max(map(len, parts)) <= 50
    assert all(features.SPACE[p[-1]] for p in parts[:-1])


def test_held_out_labels_do_not_set_the_calibration(spark, docs, labels):
    turned = labels.withColumn("quality", F.when(features.held_out(F.col("doc_id")), 1).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels), quality.fit(docs, turned)
    assert (a.slope, a.offset) == (b.slope, b.offset)


def test_thinned_sample_is_the_plain_one(spark):
    rows = spark.range(30_000).selectExpr("id AS doc_id", "CASE WHEN id % 50 = 0 THEN 'rare' WHEN id % 50 = 1 THEN NULL ELSE 'often' END AS label")
    plain = rows.selectExpr("doc_id", "label", "xxhash64(doc_id, 7) AS h", "crc32(cast(cast(doc_id AS string) AS binary)) % 3 AS part").collect()
    expected = set()
    for label in ("rare", "often"):
        own = sorted((r.h, r.doc_id) for r in plain if r.label == label and r.part != 1)
        expected |= {(i, label) for _, i in own[:300]}
    assert {tuple(r) for r in features.labelled_sample(rows, 300, 5000).collect()} == expected
    assert features.labelled_sample(rows.limit(0), 300, 5000).collect() == []

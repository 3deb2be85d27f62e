"""The pipeline's stages against plain versions of them on whole tables, and on odd ones."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from test_simhash import plain_components, plain_print

import corpus_pipeline
from postaudit.llm import bpe, mixing, quality

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The rows before the first stage and after each, as run() passes them on."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(corpus_pipeline.materialise(stage(spark, found[-1], FOLDER)))
    return found


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_columns_stay(steps):
    assert all(s.columns == steps[0].columns for s in steps[1:-1])


def test_quality(spark, steps):
    model = quality.fit(steps[0], spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = sorted(r["doc_id"] for r in rows(steps[0]) if model.score(r["text"]) >= 0.5)
    assert sorted(r["doc_id"] for r in rows(steps[1])) == want and 0 < len(want) < steps[0].count()


def test_exact(steps):
    largest = {}
    for r in rows(steps[1]):
        largest[r["text"] or ""] = max(r["doc_id"], largest.get(r["text"] or "", -1))
    assert sorted(r["doc_id"] for r in rows(steps[2])) == sorted(largest.values())


def test_near(steps):
    docs = rows(steps[2])
    roots, groups = plain_components([plain_print(r["text"]) for r in docs]), defaultdict(list)
    for r, root in zip(docs, roots):
        groups[root].append(r["doc_id"])
    assert sorted(r["doc_id"] for r in rows(steps[3])) == sorted(min(g) for g in groups.values())


def test_mix(spark, steps):
    often = {r["doc_id"]: r["copies"] for r in rows(mixing.mix(steps[3]))}
    got = Counter(r["doc_id"] for r in rows(steps[4]))
    assert got == Counter({k: v for k, v in often.items() if v})


def test_tokens(steps):
    own = bpe.Codec(open(public_tokenizers.path(corpus_pipeline.VOCABULARY), "rb").read(), public_tokenizers.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in rows(steps[4])}
    final = rows(steps[5])
    assert Counter(r["doc_id"] for r in final) == Counter(r["doc_id"] for r in rows(steps[4]))
    for r in final:
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
        assert b"".join(own.tokens[i] for i in r["ids"]).decode() == (texts[r["doc_id"]] or "")


def test_run_is_its_stages(spark, steps):
    got = corpus_pipeline.run(spark, FOLDER).drop("ids")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, steps[-1].drop("ids").collect()))


def test_odd_rows(spark):
    odd = [(1, None, "en", "a", 0), (1, None, "en", "a", 0), (2, "", None, None, None), (None, "x y z", "en", None, 1),
           (3, "w " * 30_000, "en", "b", 60_000), (3, "w " * 30_000, "en", "b", 60_000), (4, "w " * 30_000, "fr", "c", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int, root string"
    docs = spark.createDataFrame([(*r, 7, "extra") for r in odd], schema)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs, empty = stage(spark, docs, FOLDER), stage(spark, empty, FOLDER)
        if name != "byte_bpe":
            assert docs.schema.names == schema.replace(",", "").split()[::2]
            docs = corpus_pipeline.materialise(docs)
        assert empty.count() == 0
    assert docs.count() >= 0


def test_copies_go_once(spark):
    docs = spark.createDataFrame([(5, "same text here", "s"), (5, "same text here", "s"), (4, "same text here", "t")],
                                 "doc_id long, text string, source string")
    assert [r.doc_id for r in corpus_pipeline.exact_dedup(spark, docs, FOLDER).collect()] == [5]
    assert [r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, FOLDER).collect()] == [4]

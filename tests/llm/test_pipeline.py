"""The pipeline's stages, each against a plain version of what it keeps."""

import hashlib

import pytest

import corpus_pipeline
from tallyforge.llm import bpe, mixing, quality_rules

from . import plain


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = plain.table(120, seed=8)
    spark.createDataFrame(rows, plain.SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    return f"file://{at}"


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        kept[name] = (docs, out.persist())
        docs = kept[name][1]
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in kept["quality"])
    verdict = {r.doc_id: r.kept for r in quality_rules.verdicts(kept["quality"][0]).collect()}
    assert set(after) == {d for d in before if verdict[d]} and not any(plain.quality(t)[5] for t in after.values())
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in kept["exact"])
    assert set(after) == {max(d for d in before if plain.low(before[d]) == t) for t in {plain.low(t) for t in before.values()}}
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in kept["near"])
    assert set(after) == {c for _, c in plain.near(list(before.items())).values()}
    times = {r.doc_id: r.times for r in mixing.plan(kept["mix"][0]).collect()}
    got = {r.doc_id: r["count"] for r in kept["mix"][1].groupBy("doc_id").count().collect()}
    assert got == {d: n for d, n in times.items() if n}


def test_run(spark, folder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    got = corpus_pipeline.run(spark, folder).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert got
    for r in got:
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() and r.n_tokens == len(t.encode(text[r.doc_id], add_special_tokens=False).ids)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "encode"] and corpus_pipeline.ORACLE_SQL is None
    import __spark_entry__ as e

    ops = [n for n in e.queries() if n.startswith("op")]
    assert {int(n[2:].split("_")[0]) for n in ops} == set(range(1, 11)) and "pipeline" in e.queries()

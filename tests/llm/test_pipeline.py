"""Registered queries against their SQL, and the pipeline's stages."""

import pytest

import corpus_pipeline
from skein.llm import exact_dedup, mixing, queries, simhash


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name])


def test_thirteen_queries():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 14)]


def test_stages(spark, sf_dir, tmp_path):
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs, kept = whole, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        assert out.columns == whole.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    good, exact, near, mixed = kept
    assert near <= exact <= good and mixed <= near
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    right = [(i in good) == (q == 1) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.9
    stage0 = spark.read.parquet(str(tmp_path / "0"))
    assert exact == {r["doc_id"] for r in exact_dedup.dedup(stage0).where("kept").collect()}
    stage1 = spark.read.parquet(str(tmp_path / "1"))
    first = {}
    for r in simhash.near_copies(stage1, ["doc_id"]).collect():
        first[r["component"]] = min(r["doc_id"], first.get(r["component"], r["doc_id"]))
    assert near == set(first.values())
    stage2 = spark.read.parquet(str(tmp_path / "2"))
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(stage2.select("doc_id", "text", "source")).collect()}
    words = {}
    for r in docs.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {i: n for i, n in taken.items() if n}
    assert corpus_pipeline.run(spark, sf_dir).count() >= len(mixed)

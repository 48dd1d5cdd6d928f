"""Every core query over tables of odd rows and over tables without rows, and what some of them give."""

import collections

import odd_tables as O
import pytest
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.plans.registry import QUERIES


@pytest.fixture(scope="module")
def odd(spark, sf_dir, tmp_path_factory):
    import __spark_entry__  # noqa: F401  registers the queries

    return O.odd_tables(spark, sf_dir, tmp_path_factory.mktemp("odd"))


@pytest.fixture(scope="module")
def docs(spark, odd):
    return [r.asDict() for r in spark.read.parquet(f"{odd}/documents.parquet").collect()]


@pytest.mark.parametrize("kind", ["odd_tables", "empty_tables"])
def test_every_query_runs(kind, spark, sf_dir, tmp_path):
    import __spark_entry__  # noqa: F401

    d, broken = getattr(O, kind)(spark, sf_dir, tmp_path), {}
    for name in sorted(QUERIES):
        try:
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001
            broken[name] = str(e)[:200]
    assert broken == {}


def counted(rows):
    return collections.Counter(map(tuple, rows))


def test_no_document_is_lost_or_doubled(spark, odd, docs):
    """Rows that repeat, ids that repeat and ids that are null are rows of their own."""
    ids = collections.Counter(r["doc_id"] for r in docs)
    for name in ("pack_pad", "encode_round_trip", "content_hashes", "compact_tokens", "clamped_spans", "budget_sample"):
        assert collections.Counter(r["doc_id"] for r in QUERIES[name](spark, odd).collect()) == ids, name
    rows = QUERIES["padded_rows"](spark, odd).collect()
    assert sum(r["n"] for r in rows) == 1024 * len(rows)
    by_rank = collections.defaultdict(int)
    for r in rows:
        by_rank[r["rank"]] = max(by_rank[r["rank"]], r["consumed"])
    assert sum(by_rank.values()) == sum(bool((r["text"] or "").encode()) for r in docs)
    assert all(r["in_step"] for r in QUERIES["lockstep_rows"](spark, odd).collect())


def test_results_by_row(spark, odd, docs):
    text = lambda r: r["text"] or ""
    assert counted((r["doc_id"], r["n"], r["pieces"]) for r in QUERIES["compact_tokens"](spark, odd).collect()) == counted((r["doc_id"], len(text(r).encode()), len({0, len(text(r)), *(k for k in (3, 7) if k < len(text(r)))}) - bool(text(r))) for r in docs)
    assert counted((r["doc_id"], r["s"], r["e"]) for r in QUERIES["clamped_spans"](spark, odd).collect()) == counted((r["doc_id"], min(100, len(text(r))), min(500, len(text(r)))) for r in docs)
    for r in QUERIES["encode_round_trip"](spark, odd).collect():
        assert r["same"] and (r["ratio"] is None) == (r["n_tokens"] == 1)
    accounting = {r["mode"]: r for r in QUERIES["pack_accounting"](spark, odd).collect()}
    assert accounting["pad"]["n_documents"] == len(docs) and accounting["pad"]["n_unplaced"] == 0 and accounting["pad"]["n_truncated"] == 1
    kept = QUERIES["budget_sample"](spark, odd).collect()
    assert counted((r["doc_id"], r["chars"] or 0) for r in kept) == counted((r["doc_id"], min(10_000, len(text(r)))) for r in docs)


def test_cut_at_of_odd_texts(spark):
    rows = spark.createDataFrame([("",), (None,), ("ab",), ("abcd",)], "t string").select(X.cut_at(F.col("t"), F.array(F.lit(3))).alias("c")).collect()
    assert [r["c"] for r in rows] == [[""], None, ["ab"], ["abc", "d"]]

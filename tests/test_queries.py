"""Every registered query with SQL gives the rows of its SQL."""

import pytest

import __spark_entry__ as entry
from skein.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, same):
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_last_row_of_shards_whose_names_begin_alike(spark, tmp_path):
    """A shard's name runs on into its row: src1 with row 12 comes after src10 with row 3. Rows without source or id have no place."""
    import duckdb
    from conftest import rows_of

    rows = [(k, "src1", k % 5) for k in range(30)] + [(100 + k, "src10", k % 7) for k in range(40)] + [(200, None, 3), (201, None, 9), (None, "src1", 4), (None, "src1", 11)]
    spark.createDataFrame(rows, "doc_id long, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    want = duckdb.sql(SQL["last_row_wins"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).to_arrow_table()
    assert rows_of(QUERIES["last_row_wins"](spark, str(tmp_path)).toArrow()) == rows_of(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["rows", "utilisation", "cropped", "padded", "n_documents", "n_truncated", "n_unplaced", "mode"]
    assert set(entry.oracle_sql()) <= set(entry.queries())

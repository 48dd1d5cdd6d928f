import datetime
import decimal
import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from skein.session import session

    s = session("local[4]", 4, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def plain(v):
    """A value as both engines can state it: floats and decimals rounded, times without zone."""
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return v


def rows_of(arrow):
    """Columns in name order and all rows, sorted."""
    cols = sorted(arrow.column_names)
    return cols, sorted(repr([plain(r[c]) for c in cols]) for r in arrow.to_pylist())


@pytest.fixture(scope="session")
def same(spark, duck, sf_dir):
    def check(query, sql):
        a, b = rows_of(query(spark, sf_dir).toArrow()), rows_of(duck.sql(sql).to_arrow_table())
        assert a[0] == b[0]
        assert a[1] == b[1]

    return check

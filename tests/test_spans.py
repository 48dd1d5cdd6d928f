"""Overlap and as-of searches over spans against nested loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import joins as J
from skein.operators import spans as S

SCHEMA = "doc long, ts array<int>, te array<int>, ss array<int>, se array<int>, v array<double>"


def brute(ts, te, ss, se, v, how):
    out = []
    for a, b in zip(ts, te, strict=True):
        met = [float("nan") if x is None else x for c, d, x in zip(ss, se, v, strict=True) if d > c and b > a and c < b and d > a]
        out.append(0.0 if not met else met[-1] if how == "last" else sum(met) / len(met))
    return out


def alike(a, b):
    return len(a) == len(b) and all((x != x and y != y) or x == y or (math.isfinite(x) and math.isfinite(y) and abs(x - y) <= 1e-9 * max(1, abs(y))) for x, y in zip(a, b, strict=True))


def tokens(rng, n):
    """Cuts of a text in order, with empty spans, gaps and spans repeated."""
    s, e, at = [], [], 0
    for _ in range(rng.randint(0, n)):
        kind = rng.random()
        if kind < 0.2 and s:
            s.append(s[-1])
            e.append(e[-1])
            continue
        at += rng.random() < 0.2
        size = 0 if kind < 0.3 else rng.randint(1, 4)
        s.append(at)
        e.append(at + size)
        at += size
    return s, e


def loose(rng, n):
    s = [rng.randint(0, 30) for _ in range(rng.randint(0, n))]
    return s, [x + rng.randint(0, 12) for x in s]


def value(rng):
    return rng.choice([1.0, -2.5, 1e9, rng.random(), rng.random(), float("nan"), float("inf"), float("-inf"), None])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(400):
        t, s = (tokens if i % 3 else loose)(rng, 12), (tokens if i % 2 else loose)(rng, 12)
        out.append((i, *t, *s, [value(rng) if i % 5 == 0 else rng.random() for _ in s[0]]))
    return out


@pytest.mark.parametrize("how", ["mean", "last"])
def test_overlaps_equal_nested_loops(spark, rows, how):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc"]: r["x"] for r in df.select("doc", S.overlaps(how)("ts", "te", "ss", "se", "v").alias("x")).collect()}
    for doc, *spans in rows:
        assert alike(got[doc], brute(*spans, how)), (doc, spans, got[doc])


def test_rows_form_equals_lists(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    t = df.select("doc", F.posexplode(F.arrays_zip("ts", "te")).alias("pos", "z")).select("doc", "pos", F.col("z.ts").alias("s"), F.col("z.te").alias("e"))
    s = df.select("doc", F.posexplode(F.arrays_zip("ss", "se", "v")).alias("pos", "z")).select("doc", "pos", F.col("z.ss").alias("s"), F.col("z.se").alias("e"), F.col("z.v").alias("value"))
    for how in ("mean", "last"):
        got = {}
        for r in J.overlap(t, s, "doc", how).orderBy("doc", "pos").collect():
            got.setdefault(r["doc"], []).append(r["value"])
        assert all(alike(got.get(doc, []), brute(*spans, how)) for doc, *spans in rows)


def test_cases_by_name(spark):
    """A NaN stays where it is; of equal spans the later one is last; a nested source that has ended is not."""
    def run(how, *lists):
        df = spark.createDataFrame([(1, *lists)], SCHEMA)
        return df.select(S.overlaps(how)("ts", "te", "ss", "se", "v").alias("x")).first()["x"]

    five = ([0, 1, 2, 3, 4], [1, 2, 3, 4, 5])
    assert alike(run("mean", *five, *five, [1.0, float("nan"), 1.0, float("inf"), 1.0]), [1.0, float("nan"), 1.0, float("inf"), 1.0])
    assert run("last", [0], [3], [0, 0], [3, 3], [7.0, 9.0]) == [9.0] and run("mean", [0], [3], [0, 0], [3, 3], [7.0, 9.0]) == [8.0]
    assert run("last", [6], [8], [0, 2], [10, 4], [7.0, 9.0]) == [7.0]
    assert run("last", [0, 3], [9, 3], [2, 2], [2, 2], [7.0, 9.0]) == [0.0, 0.0]
    none = spark.createDataFrame([(1, None, None, [0], [1], [1.0]), (2, [0], [1], None, None, None), (3, [], [], [], [], [])], SCHEMA)
    assert [r["x"] for r in none.orderBy("doc").select(S.overlaps()("ts", "te", "ss", "se", "v").alias("x")).collect()] == [None, [0.0], []]
    assert none.where("false").select(S.overlaps()("ts", "te", "ss", "se", "v").alias("x")).collect() == []


def test_as_of_equals_loops(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc"]: r["x"] for r in df.select("doc", S.as_of_places()("te", "se").alias("x")).collect()}
    for doc, _, te, _, se, _ in rows:
        assert got[doc] == [max(((e, k) for k, e in enumerate(se) if e <= t), default=(0, -1))[1] for t in te]


def test_split_spans(spark):
    df = spark.createDataFrame([("a bc  d",), ("",), (None,), ("é🌍 x",)], "t string")
    got = [r["x"] for r in df.select(S.split_spans(" ")("t").alias("x")).collect()]
    assert got[0].asDict() == {"s": [0, 2, 5, 6], "e": [1, 4, 5, 7]}
    assert got[1].asDict() == {"s": [0], "e": [0]} and got[2] is None and got[3]["e"] == [2, 4]


def test_many_nested_spans_in_time(spark):
    """20,000 sources one in another: no pair of target and source is looked at by itself."""
    n = 20_000
    df = spark.createDataFrame([(1, list(range(n)), list(range(1, n + 1)), list(range(n)), [2 * n - i for i in range(n)], [float(i) for i in range(n)])], SCHEMA)
    last = df.select(S.overlaps("last")("ts", "te", "ss", "se", "v").alias("x")).first()["x"]
    mean = df.select(S.overlaps("mean")("ts", "te", "ss", "se", "v").alias("x")).first()["x"]
    assert last == [float(i) for i in range(n)] and alike(mean, [i / 2 for i in range(n)])


def test_searches_between_cuts_of_a_text(spark):
    texts = ["one e here  eel", "", "eee", None, "nothing", "é e 🌍e"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    for name, got in (("mean", S.overlapped_places(S.split_spans(" "), S.split_spans("e"), "mean")), ("last", S.overlapped_places(S.split_spans(" "), S.split_spans("e"), "last")), ("as_of", S.last_places(S.split_spans(" "), S.split_spans("e")))):
        for r in df.select("k", "t", got(F.col("t")).alias("x")).collect():
            if r["t"] is None:
                assert not r["x"]
                continue
            cut = lambda sep, t=r["t"]: [(sum(len(p) + 1 for p in t.split(sep)[:i]), sum(len(p) + 1 for p in t.split(sep)[:i]) + len(x)) for i, x in enumerate(t.split(sep))]
            a, b = cut(" "), cut("e")
            if name == "as_of":
                assert r["x"] == [max((i for i, (_, e) in enumerate(b) if e <= end), default=-1) for _, end in a]
            else:
                assert alike(r["x"], brute(*zip(*a, strict=True), *zip(*b, strict=True), [float(i) for i in range(len(b))], name))


def test_places_are_made_part_by_part():
    """What a search holds is that of some texts, not of a batch: tens of arrays as long as all spans of ten thousand documents took gigabytes."""
    import tracemalloc

    import pyarrow as pa

    from skein.operators import spans as Z

    texts = pa.array([None, "", *["ab e " * 10_000] * 100, "e e"])
    for search in (Z.overlapped_places(Z.split_spans(" "), Z.split_spans("e")), Z.last_places(Z.split_spans(" "), Z.split_spans("e"))):
        one = search.func(texts[2:3]).to_pylist()[0]
        tracemalloc.start()
        found = search.func(texts)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 150e6
        assert found[2].as_py() == found[101].as_py() == one and len(found) == len(texts)
        assert all(found[k].as_py() == search.func(texts[k : k + 1]).to_pylist()[0] for k in (0, 1, 102))
        assert len(search.func(texts[:0])) == 0

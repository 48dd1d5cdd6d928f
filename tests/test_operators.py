"""Packers, joins, state and logs against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import joins as J
from skein.operators import metrics as M
from skein.operators import packing as P
from skein.sources import tables as S
from skein.streaming import state as T


def plain_pack(lengths, capacity, size, mode):
    """The packer's rules on lists: largest that fits, first of ties; else crop the shortest or pad."""
    src, buf, rows = list(enumerate(lengths)), [], []
    while True:
        row, room = [], capacity
        while room:
            while src and len(buf) < size:
                buf.append(src.pop(0))
            if not buf:
                break
            fit = [x for x in buf if x[1] <= room]
            if fit:
                best = max(fit, key=lambda x: x[1])
                used = best[1]
            elif mode == "pad":
                break
            else:
                best = min(buf, key=lambda x: x[1])
                used = room
            buf.remove(best)
            row.append((best[0], used))
            room -= used
        if not row or (room and mode == "crop"):
            return rows
        rows.append(row)


@pytest.mark.parametrize("mode", ["crop", "pad"])
@pytest.mark.parametrize("seed", range(4))
def test_pack_stream(mode, seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 16 if mode == "pad" else 40) for _ in range(120)]
    got = list(P.pack_stream(((n, i) for i, n in enumerate(lengths)), 17, 8, mode))
    assert got == plain_pack(lengths, 17, 8, mode)


def test_packed_accounts_for_all(spark):
    docs = spark.range(200).select((F.col("id") % 3).cast("int").alias("rank"), F.col("id").alias("ord"), F.col("id").alias("doc_id"), (F.col("id") * 7 % 31 + 1).cast("int").alias("n"))
    p = P.packed(docs, 32, 10, "pad").toPandas()
    assert sorted(p["doc_id"]) == list(range(200))
    assert (p.groupby(["rank", "row"])["used"].sum() <= 32).all()
    crop = P.packed(docs, 32, 10, "crop").toPandas()
    assert (crop.groupby(["rank", "row"])["used"].sum() == 32).all()


def test_length_batches(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), (F.col("id") % 13 + 1).alias("n"), F.lit("a").alias("g"))
    b = P.length_batches(docs, 40, "g").toPandas().groupby("batch")["n"].agg(["count", "max"])
    assert ((b["count"] * b["max"] <= 40) | (b["count"] == 1)).all()


def test_overlap_golden(spark):
    """Tokens 'ab', ' ', 'cd' over character scores 1, 2, 3, 4; the blank meets none."""
    t = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 2, 3), (1, 2, 3, 5)], "d long, pos long, s long, e long")
    s = spark.createDataFrame([(1, 0, 0, 1, 1.0), (1, 1, 1, 2, 2.0), (1, 2, 3, 4, 3.0), (1, 3, 4, 5, 4.0)], "d long, pos long, s long, e long, value double")
    for how, want in (("mean", [1.5, 0.0, 3.5]), ("last", [2.0, 0.0, 4.0])):
        assert [r["value"] for r in J.overlap(t, s, "d", how).orderBy("pos").collect()] == want
    wide = spark.createDataFrame([(1, 0, 0, 200, 7.0)], "d long, pos long, s long, e long, value double")
    assert [r["value"] for r in J.overlap(t, wide, "d", "mean").collect()] == [7.0] * 3


def test_pass_at_k_and_bpb(spark):
    s = spark.createDataFrame([(1, 0, False), (1, 1, True), (2, 0, False), (2, 1, False)], "example long, sample int, correct boolean")
    assert {r["k"]: r["pass_rate"] for r in M.pass_at_k(s, 2).collect()} == {1: 0.0, 2: 0.5}
    z = spark.createDataFrame([(1.0, 0)], "nats double, n int")
    assert z.agg(M.bits_per_byte(F.col("nats"), F.col("n"))).first()[0] == float("inf")


def test_buffer_phases(spark):
    depths = spark.createDataFrame([(1, i, float(d)) for i, d in enumerate([40, 100, 60, 19, 30, 50])], "key long, ord long, depth double")
    got = [r["phase"] for r in T.phases(depths, 100, 50, 20).orderBy("ord").collect()]
    assert got == ["prefill", "running", "running", "rebuffer", "rebuffer", "running"]
    with pytest.raises(ValueError):
        T.phases(depths, 10, 50, 20)


def test_complete_utf8():
    held, out = b"", ""
    for b in "aé你🌍z".encode():
        text, held = T.complete_utf8(held + bytes([b]))
        assert "�" not in text
        out += text
    assert out == "aé你🌍z" and held == b""
    assert T.complete_utf8(b"\xffa")[0] == "�a"


def test_streams(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    q = T.char_totals(T.read_documents(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("totals").collect()} == {tuple(r) for r in T.char_totals(docs).collect()}
    depths = spark.createDataFrame([(1, i, float(d)) for i, d in enumerate([40, 100, 19, 50])], "key long, ord long, depth double")
    depths.coalesce(1).write.parquet(str(tmp_path / "depths"))
    live = spark.readStream.schema(depths.schema).parquet(str(tmp_path / "depths"))
    q = T.stream_phases(live, 100, 50, 20).writeStream.format("memory").queryName("phases").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r["phase"] for r in spark.table("phases").orderBy("ord").collect()] == ["prefill", "running", "rebuffer", "running"]


def test_sources(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Task      , Accuracy, Centered\narc  , 0.5 , 0.25\n")
    assert S.read_results_csv(spark, str(tmp_path / "r.csv")).first()["Centered"] == 0.25
    (tmp_path / "run.log").write_text("loss: 1,000\nother\nloss: 2.5\n")
    assert S.scrape_metrics(spark, str(tmp_path / "run.log"), r"^(\w+): ([\d.,]+)$").first()["number"] == 2.5
    S.write_corpus(spark.range(600).select(F.col("id").cast("string").alias("text")).coalesce(1), str(tmp_path / "corpus"), 256)
    back = S.corpus_shards(spark, str(tmp_path / "corpus"))
    assert back.count() == 600 and back.agg(F.max("row_index")).first()[0] == 599


def test_running_total(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("k"))
    rows = S.running_total(df, ["k"], F.col("k"), "before").collect()
    assert len(rows) == 1000 and all(r["before"] == r["k"] * (r["k"] - 1) // 2 for r in rows)


def test_first_at_least_looks_back_alone(spark):
    """Frames grow by a row at a time: one that begins at each row and runs to the end is made anew for each, quadratic in a range's rows."""
    values = [(3 * k, k // 2) for k in range(400)]
    targets = [(k, (k * 37) % 260) for k in range(300)]
    found = S.first_at_least(spark.createDataFrame(values, "place long, at long"), spark.createDataFrame(targets, "key long, at long"))
    want = {(key, at): min((p for p, v in values if v >= at), default=None) for key, at in targets}
    assert {(r["key"], r["at"]): r["found"] for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan.replace("$", "").lower()


def test_quadratic_and_ridge(spark):
    import numpy as np

    pts = [("a", 10.0**x, (x - 2.0) ** 2 + 1.0) for x in (1, 1.5, 2.5, 3)]
    r = M.quadratic_optimum(spark.createDataFrame(pts, "g string, x double, y double"), "g", "x", "y").first()
    assert abs(r["best_x"] - 100) < 1e-6 and abs(r["best_y"] - 1) < 1e-9 and r["fitted"]
    g, m = M.gram(spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.0)], "x double, y double"), ["x"], "y")
    assert np.allclose(M.ridge(g, m, 0.0), [1.0, 2.0])

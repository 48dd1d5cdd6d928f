"""Store and score files read where they lie, against numpy; nothing is opened that is not asked for."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import joins as J
from skein.operators import store as A
from skein.sources import stores as R

R_CHANNELS = 64


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r["embedding"] for r in rows], np.float32)


def lengths(n, total):
    """Documents of 0 to 6 tokens that use ``total`` vectors up."""
    rng, out = np.random.default_rng(1), []
    while sum(out) < total:
        out.append(min(int(rng.integers(0, 7)), total - sum(out)))
    return out


@pytest.fixture(scope="module")
def store(tmp_path_factory, vectors):
    """A store in its layout on disk: texts, and what a lookup gives for each."""
    path = tmp_path_factory.mktemp("store")
    q = np.clip(np.round(vectors / 0.01), -128, 127).astype(np.int8)
    sizes = lengths(0, len(q))
    offs = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    texts = [f"text {i} é" for i in range(len(sizes))]
    index = np.zeros(len(sizes), R.INDEX)
    import hashlib

    index["hash"] = [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little") for t in texts]
    index["off"], index["n"] = offs, sizes
    np.save(path / "index.npy", index)
    q.tofile(path / "activations.int8")
    (path / "meta.json").write_text(json.dumps({"format": R.STORE_FORMAT, "source_kind": "probe-scores", "r": R_CHANNELS, "scale": 0.01}))
    want = {t: q[o : o + n].astype(np.float32) * np.float32(0.01) for t, o, n in zip(texts, offs, sizes, strict=True)}
    return str(path), want


def test_store_rows(spark, store):
    path, want = store
    for docs_per_task in (7, 1 << 16):
        df = R.read_store(spark, path, docs_per_task=docs_per_task)
        texts = spark.createDataFrame([(t,) for t in want], "text string").withColumn("doc_hash", A.content_hash("text"))
        got = {r["text"]: (r["n"], np.array(r["values"], np.float32)) for r in texts.join(df, "doc_hash").collect()}
        assert got.keys() == want.keys()
        assert all(n == len(want[t]) and (v == want[t].ravel()).all() for t, (n, v) in got.items())


def test_store_by_hash(spark, store):
    path, want = store
    some = list(want)[3:5]
    keys = [r[0] for r in spark.createDataFrame([(t,) for t in some], "text string").select(A.content_hash("text")).collect()]
    assert {r["doc_hash"] for r in R.read_store(spark, path, keys).collect()} == set(keys) and R.read_store(spark, path, []).collect() == []
    whole = R.read_store(spark, path)
    assert whole.where(F.col("doc_hash") == keys[0]).union(whole.where(F.col("doc_hash") == keys[1])).count() == 2
    assert whole.count() == len(want)  # filters of other uses do not stay with the frame


def test_store_join(spark, store):
    """A text that the store lacks and one whose number of tokens differs have zeros, as ``join_store`` gives them."""
    path, want = store
    s = R.read_store(spark, path).withColumnRenamed("doc_hash", "key")
    texts = [*list(want)[:10], "unknown"]
    docs = spark.createDataFrame([(t, len(want[t]) + (k == 4) if t in want else 2) for k, t in enumerate(texts)], "text string, n int").withColumn("key", A.content_hash("text"))
    rows = {r["text"]: r for r in J.join_store(docs, s, "key", "n", {"values": F.array_repeat(F.lit(0.0).cast("float"), F.col("n") * R_CHANNELS)}).collect()}
    for k, t in enumerate(texts):
        assert rows[t]["hit"] == (t in want and k != 4) and len(rows[t]["values"]) == rows[t]["n"] * R_CHANNELS
        assert not rows[t]["hit"] or (np.array(rows[t]["values"], np.float32) == want[t].ravel()).all()


def test_refused_stores(spark, tmp_path):
    np.save(tmp_path / "index.npy", np.zeros(0, R.INDEX))
    (tmp_path / "activations.int8").write_bytes(b"")
    meta = {"format": R.STORE_FORMAT, "source_kind": "probe-scores", "r": 4, "scale": 1.0}
    (tmp_path / "meta.json").write_text(json.dumps(meta))
    assert R.read_store(spark, str(tmp_path)).collect() == []
    for broken, said in (({"format": "activation-store-v1"}, "format"), ({"source_kind": "other"}, "source_kind")):
        (tmp_path / "meta.json").write_text(json.dumps(meta | broken))
        with pytest.raises(Exception, match=said):
            R.read_store(spark, str(tmp_path)).collect()


LAYERS, CONCEPTS = [4, 8], [f"c{i}" for i in range(32)]


@pytest.fixture(scope="module")
def scores(spark, tmp_path_factory, vectors):
    path = str(tmp_path_factory.mktemp("scores"))
    rng = np.random.default_rng(2)
    quant = {k: rng.uniform(0.1, 1, (2, 32)).tolist() for k in ("zero", "scale")}
    stats = {k: rng.uniform(0.5, 2, (2, 32)).tolist() for k in ("mean", "std")}
    q = np.clip(np.round(vectors * 200), -128, 127).astype(np.int8).reshape(-1, 2, 32)
    sizes, rows, want, at = lengths(0, len(q)), [], {}, 0
    for i, n in enumerate(sizes):
        shard, part = (0, 7, 12)[i % 3], q[at : at + n]
        rows.append((shard, i // 3, n, part.ravel().tolist()))
        z = (part[:, 1].astype(np.float32) * np.float32(quant["scale"][1]) + np.float32(quant["zero"][1]) - np.float32(stats["mean"][1])) / np.float32(stats["std"][1])
        want[shard, i // 3] = z
        at += n
    R.write_scores(spark.createDataFrame(rows, "shard int, row long, n int, q array<int>").repartition(5), path, LAYERS, CONCEPTS, quant, stats)
    return path, want


def test_scores(spark, scores):
    path, want = scores
    got = {(r["shard"], r["row"]): (r["n"], np.array(r["values"], np.float32).reshape(-1, 32)) for r in R.read_scores(spark, path, [0, 7, 12], 8).collect()}
    assert got.keys() == want.keys() and all(n == len(want[k]) and np.allclose(v, want[k], atol=1e-6) for k, (n, v) in got.items())
    two = R.read_scores(spark, path, [7], 8, ["c5", "c1"]).where("row = 2").first()
    assert np.allclose(np.array(two["values"]).reshape(-1, 2), want[7, 2][:, [5, 1]], atol=1e-6)
    assert np.load(f"{path}/scores_00007.npy").shape[1:] == (2, 32)  # any reader of arrays opens what was written


def test_only_the_shards_asked_for_are_opened(spark, scores, tmp_path):
    import shutil

    path, want = scores
    shutil.copytree(path, tmp_path / "s")
    (tmp_path / "s" / "scores_00000.npy").unlink()
    assert R.read_scores(spark, str(tmp_path / "s"), [7, 12], 8).count() == sum(s > 0 for s, _ in want)
    with pytest.raises(Exception, match="scores_00000"):
        R.read_scores(spark, str(tmp_path / "s"), [0, 7], 8).count()
    with pytest.raises(Exception, match="layer"):
        R.read_scores(spark, path, [0], 5).collect()
    with pytest.raises(Exception, match="concepts"):
        R.read_scores(spark, path, [0], 8, ["none"]).collect()


def test_a_shard_is_one_task_s_whatever_the_plan(spark, tmp_path):
    """A join that turns out small enough to broadcast, whose other side is then read by pieces, leaves shards whole."""
    q = F.array(*(F.pmod(F.col("id") + k, F.lit(100)).cast("tinyint") for k in range(2)))
    rows = spark.range(0, 3000, 1, 6).select(F.pmod("id", F.lit(3)).cast("int").alias("shard"), F.floor(F.col("id") / 3).alias("row"), F.lit(1).alias("n"), q.alias("q"))
    held = {"spark.sql.autoBroadcastJoinThreshold": "16k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        R.write_scores(rows, str(tmp_path / "s"), [0], ["a", "b"], {}, {})
    finally:
        for k in held:
            spark.conf.unset(k)
    for shard in range(3):
        found = np.load(tmp_path / "s" / f"scores_{shard:05d}.npy")
        assert found[:, 0].tolist() == [[(3 * k + shard) % 100, (3 * k + shard + 1) % 100] for k in range(1000)]


def test_broken_rows_are_not_written(spark, tmp_path):
    bad = spark.createDataFrame([(0, 1, 1, [1, 2])], "shard int, row long, n int, q array<int>")
    with pytest.raises(Exception, match="expected row 0"):
        R.write_scores(bad, str(tmp_path / "b"), [0], ["a", "b"], {}, {})
    assert not (tmp_path / "b" / "scores_00000.npy").exists()


def test_documents_of_any_name_are_written_and_read(spark, tmp_path):
    """Names with gaps, repeats and without a value; several files; a line without a name, and documents that lie elsewhere in the file."""
    named = [(0, 5_000_000_000, 1, [1, 2]), (0, 7, 2, [3, 4, 5, 6]), (0, 7, 1, [9, 9]), (0, None, 0, []), (4, -3, 1, [7, 8])]
    rows = spark.createDataFrame(named, "shard int, doc long, n int, q array<int>").repartition(3)
    path = str(tmp_path / "s")
    assert R.write_scores(rows, path, [0], ["a", "b"], {"zero": [[0, 0]], "scale": [[1, 1]]}, {"mean": [[0, 0]], "std": [[1, 1]]}) == [0, 4]
    got = [(r["shard"], r["row"], r["doc"], r["n"], r["values"]) for r in R.read_scores(spark, path, [0, 4], 0).orderBy("shard", "row").collect()]
    assert got == [(0, 0, None, 0, []), (0, 1, "7", 1, [9, 9]), (0, 2, "7", 2, [3, 4, 5, 6]), (0, 3, "5000000000", 1, [1, 2]), (4, 0, "-3", 1, [7, 8])]
    (tmp_path / "s" / "docs_00000.jsonl").write_text('{"start": 3, "n": 1}\n{"doc": "x", "start": 0, "n": 1}\n{"doc": 2, "start": 1, "n": 2}')
    got = [(r["row"], r["doc"], r["values"]) for r in R.read_scores(spark, path, [0], 0).orderBy("row").collect()]
    assert got == [(0, None, [1, 2]), (1, "x", [9, 9]), (2, "2", [3, 4, 5, 6])]


@pytest.mark.parametrize("held", [1 << 16, 4])
def test_score_shards_of_odd_vectors_are_as_the_sql_states(spark, sf_dir, tmp_path, monkeypatch, held):
    """Ids with gaps, repeated, negative or null; vectors too short, too long, null, or with parts that are null or no numbers."""
    import duckdb
    from conftest import rows_of

    from skein.plans import store
    from skein.plans.registry import SQL

    monkeypatch.setattr(store, "SHARD_ROWS", held, raising=False)
    t = [(r["vec_id"] if r["vec_id"] < 20 else r["vec_id"] + 1_000_000, r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 40").collect()]
    e = t[0][1]
    ids = [(3, e), (3, e), (3, t[1][1]), (-1, e), (-7, e), (None, e), (None, e), (2**63 - 1, e), (-(2**63), e), (2**53 + 1, e)]
    vectors = [(100, None), (101, []), (102, e[:40]), (103, e + e), (104, [None, *e[1:]]), (105, e[:63] + [None]), (106, e[:61] + [float("nan"), float("inf"), float("-inf")]), (None, None), (None, e[:33])]
    spark.createDataFrame(t + ids + vectors, "vec_id long, embedding array<float>").coalesce(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert rows_of(store.score_shards(spark, str(tmp_path)).toArrow()) == rows_of(con.sql(SQL["score_shards"]).to_arrow_table())


def test_sweeps_are_observed_and_refuse_drift(spark, tmp_path):
    rows = spark.createDataFrame([(k % 3, k, 2, [k % 2, -127, None]) for k in range(30)], "shard int, doc long, n int, q array<int>")
    measures = A.write_measures(F.col("n"), F.lit(2), F.col("q"))
    some = rows.where("shard < 2")
    assert A.sweep(some, str(tmp_path / "s"), measures) == {"documents": 20, "tokens": 40, "drift": 0, "values": 40, "zero": 10, "clipped": 20}
    assert A.sweep(some, str(tmp_path / "s"), measures) == {}
    assert A.sweep(rows, str(tmp_path / "s"), measures)["documents"] == 10  # only the shard that is not finished
    drifted = rows.withColumn("n", F.when(F.col("doc") == 4, 3).otherwise(F.col("n")))
    with pytest.raises(ValueError, match="1 documents"):
        A.sweep(drifted, str(tmp_path / "d"), measures)
    assert A.sweep(rows, str(tmp_path / "d"), measures)["documents"] == 30  # nothing was marked as finished
    assert A.sweep(rows.where("false"), str(tmp_path / "n"), measures) == {}


def test_structured_families(spark, vectors):
    """A cyclic family with members missing, a family with fitted axes and plain concepts, against numpy."""
    from skein.operators import metrics as M

    channels = ["tuesday", "x", "asia", "monday", "europe", "sunday", "africa", "y"]
    family = {"tuesday": "weekdays", "monday": "weekdays", "sunday": "weekdays", "asia": "continents", "europe": "continents", "africa": "continents", "x": "other", "y": "another"}
    v = vectors[:, :8].astype(float)
    sub = v[:, [2, 4, 6]]
    axes = np.array(M.principal_axes(spark.createDataFrame([(r.tolist(),) for r in sub], "v array<double>"), "v", 2)).T
    rows = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(v)], "k long, s array<double>")
    table = A.family_axes(channels, family, {"continents": axes.tolist()})
    assert sorted({(p, n) for p, n, _, _ in table}) == [(0, "y"), (1, "continents.pc1"), (2, "continents.pc2"), (3, "x"), (4, "weekdays.cos"), (5, "weekdays.sin")]
    got = np.zeros((len(v), 6))
    for r in A.structured(rows, ["k"], "s", table).collect():
        got[r["k"], r["place"]] = r["value"]
    angle = 2 * np.pi * np.array([1, 0, 6]) / 7
    days = v[:, [0, 3, 5]]
    want = np.column_stack([v[:, 7], sub @ axes, v[:, 1], days @ np.cos(angle), days @ np.sin(angle)])
    assert np.allclose(got, want, atol=1e-9)
    centred = sub - sub.mean(axis=0)
    _, _, right = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(axes.T @ right[:2].T), np.eye(2), atol=1e-6)
    with pytest.raises(ValueError, match="no place"):
        A.family_axes(["monday", "someday"], {"monday": "weekdays", "someday": "weekdays"})
    with pytest.raises(ValueError, match="rows"):
        A.family_axes(["asia"], {"asia": "continents"}, {"continents": axes.tolist()})
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, 2.0])], "k long, s array<double>")
    assert [(r["k"], r["name"], r["value"]) for r in A.structured(odd, ["k"], "s", [(0, "a", 0, 1.0), (1, "b", 1, 1.0)]).orderBy("place").collect()] == [(3, "a", 0.0), (3, "b", 2.0)]

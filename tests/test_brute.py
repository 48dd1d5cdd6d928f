"""Queries that SQL does not state, whole tables of the smallest size against plain Python; stores on disk."""

import collections
import hashlib
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from skein.functions import tasks as K
from skein.functions import text as X
from skein.functions import tokens as N
from skein.operators import metrics as M
from skein.operators import packing as P
from skein.operators import sources
from skein.operators import store as A
from skein.plans import metrics, store, tokens
from skein.plans.registry import QUERIES
from skein.sources import tables as S
from skein.streaming import tools

from test_operators import plain_pack


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def vocabulary():
    return N.encoding(*tokens._vocabulary())


def test_pretoken_counts(spark, sf_dir, texts):
    # the same pattern with Unicode classes, as the regex module has them
    pattern = regex.compile(X.SPLIT_PATTERN.removeprefix("(?U)"))
    want = collections.Counter(m.group() for t in texts.values() for m in pattern.finditer(t))
    assert {r["piece"]: r["n"] for r in tokens.pretoken_counts(spark, sf_dir).collect()} == want


def test_encode_round_trip(spark, sf_dir, texts, vocabulary):
    for r in tokens.encode_round_trip(spark, sf_dir).collect():
        n = len(vocabulary.encode_ordinary(texts[r["doc_id"]])) + 1
        assert r["same"] and r["n_tokens"] == n and abs(r["ratio"] - len(texts[r["doc_id"]].encode()) / (n - 1)) < 1e-9


def test_byte_ids(spark):
    odd = ["ab", None, "", "é🌍", None, "x" * 1000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(odd)], "k int, t string").coalesce(1)
    want = [None if t is None else list(t.encode()) for t in odd]
    assert [r["b"] for r in df.select("k", N.byte_ids("t").alias("b")).orderBy("k").collect()] == want
    assert df.where("t IS NULL").select(N.byte_ids("t").alias("b")).collect()[0]["b"] is None
    assert df.where("k > 9").select(N.byte_ids("t")).collect() == []


def test_token_byte_lengths(spark, vocabulary):
    got = {r["token_id"]: r["n_bytes"] for r in N.byte_lengths(spark, *tokens._vocabulary()).collect()}
    assert got == {i: len(vocabulary.decode_single_token_bytes(i)) if i < vocabulary.n_vocab - len(N.SPECIALS) else 0 for i in range(vocabulary.n_vocab)}


def test_compression_by_lang(spark, sf_dir, vocabulary):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    for r in tokens.compression_by_lang(spark, sf_dir).collect():
        mine = [x["text"] for x in rows if x["lang"] == r["lang"]]
        assert abs(r["ratio_a"] - sum(len(t.encode()) for t in mine) / sum(len(vocabulary.encode_ordinary(t)) for t in mine)) < 1e-9
        assert r["better"] == ("a" if r["ratio_a"] > r["ratio_b"] else "b")


@pytest.mark.parametrize(("query", "capacity", "size", "mode"), [(tokens.pack_crop, 2048, 1000, "crop"), (tokens.pack_pad, 2048, 100, "pad")])
def test_packers_over_the_corpus(spark, sf_dir, texts, query, capacity, size, mode):
    world = 8
    want = set()
    for rank in range(world):
        docs = [i for i in sorted(texts) if i // 16 % world == rank]
        lengths = [len(texts[i].encode()) + 1 for i in docs]
        fits = [n if mode == "crop" else min(n, capacity) for n in lengths]
        for row, members in enumerate(plain_pack(fits, capacity, size, mode)):
            at = 0
            for slot, (k, used) in enumerate(members):
                want.add((rank, row, slot, docs[k], at, used, lengths[k]))
                at += used
    got = {tuple(r) for r in query(spark, sf_dir).collect()}
    assert got == want
    if mode == "pad":
        assert {r[3] for r in got} == set(texts)


def test_long_documents_are_cut():
    docs = [(5, "a"), (40, "b"), (3, "c"), (0, "none")]
    assert list(P.pack_stream(iter(docs), 16, 8, "pad")) == [[("b", 16)], [("a", 5), ("c", 3)]]


def test_packers_in_sql(spark, sf_dir):
    rows = lambda name: sorted(map(tuple, QUERIES[name](spark, sf_dir).collect()))
    assert rows("pack_from_sql") == rows("pack_crop")
    P.register_packers(spark)
    docs = spark.createDataFrame([(0, 0, 5, 3), (0, 1, None, 20), (1, 2, 7, None), (1, 3, 8, 2)], "rank int, ord long, doc_id long, n int")
    got = spark.sql("SELECT * FROM pack_rows(TABLE({docs}) PARTITION BY rank ORDER BY ord, capacity => 8, buffer_size => 4, mode => 'pad')", docs=docs)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, P.packed(docs, 8, 4, "pad").collect()))
    assert spark.sql("SELECT * FROM pack_rows(TABLE({docs}) PARTITION BY rank ORDER BY ord, capacity => 8, buffer_size => 4, mode => 'pad')", docs=docs.where("false")).collect() == []


def test_packing_of_odd_rows(spark):
    """Rows of one id, null ids, documents without tokens, and none at all."""
    rows = [(0, 0, 5, 3), (0, 1, 5, 3), (0, 2, None, 20), (0, 3, 7, 0), (0, 4, 8, None)]
    docs = spark.createDataFrame(rows, "rank int, ord long, doc_id long, n int")
    places = P.packed(docs, 8, 10, "pad")
    assert sorted((r["doc_id"] or -1, r["used"], r["n"]) for r in places.collect()) == [(-1, 8, 20), (5, 3, 3), (5, 3, 3)]
    a = P.accounting(places, docs, 8).first()
    assert (a["rows"], a["n_documents"], a["n_truncated"], a["n_unplaced"]) == (2, 5, 1, 2) and a["cropped"] == 12 / 26
    crop = P.accounting(P.packed(docs, 8, 10, "crop"), docs, 8).first()
    assert crop["rows"] == 1 and crop["n_unplaced"] == 2 and crop["cropped"] == 18 / 26
    none = docs.where("false")
    assert tuple(P.accounting(P.packed(none, 8), none, 8).first()) == (0, None, None, None, 0, 0, 0)


def test_pack_accounting(spark, sf_dir, texts):
    total = sum(len(t.encode()) + 1 for t in texts.values())
    for r in tokens.pack_accounting(spark, sf_dir).collect():
        places = (tokens.pack_crop if r["mode"] == "crop" else tokens.pack_pad)(spark, sf_dir).toPandas()
        rows = places.groupby(["rank", "row"])["used"].sum()
        assert r["rows"] == len(rows) and abs(r["utilisation"] - rows.sum() / 2048 / len(rows)) < 1e-9
        lost = total - places["used"].sum()
        assert abs(r["cropped"] * total - lost) < 1e-3 and r["n_documents"] == len(texts) and r["n_unplaced"] == len(texts) - len(places)
        assert r["n_truncated"] == (places["used"] < places["n"]).sum() and (r["mode"] == "crop" or r["n_unplaced"] == 0)


def test_fits(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", "l_discount", "l_tax", "l_extendedprice").toPandas().astype(float)
    d = np.column_stack([np.ones(len(x)), x.iloc[:, :3]])
    for r in metrics.ridge_fit(spark, sf_dir).collect():
        pen = np.diag([0.0, *[r["alpha"]] * 3])
        want = np.linalg.solve(d.T @ d + pen, d.T @ x["l_extendedprice"].to_numpy())
        assert np.allclose([r["intercept"], r["quantity"], r["discount"], r["tax"]], want, rtol=1e-6)
    e = np.array([r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()], float)
    _, _, v = np.linalg.svd(e - e.mean(0), full_matrices=False)
    want = [a * np.sign(a[np.abs(a).argmax()]) for a in v[:2]]
    assert np.allclose([r["loadings"] for r in metrics.principal_axes(spark, sf_dir).orderBy("axis").collect()], want, atol=1e-6)
    got = [(r["x"], r["y"]) for r in metrics.projected(spark, sf_dir).orderBy("vec_id").collect()]
    assert np.allclose(got, e @ np.array(want).T, atol=1e-5)
    assert M.principal_axes(spark.createDataFrame([], "v array<double>"), "v", 2) == []


def test_exact_means_of_long_runs(spark):
    rng = random.Random(2)
    rows = [("a", i, rng.random() * 10) for i in range(700)] + [("b", i, rng.random()) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    for beta in (0.9, 0.99, 0.5):
        got = {(r["g"], r["i"]): r["m"] for r in M.debiased_ema(df, "v", "g", "i", "m", beta).collect()}
        ema, n, last = 0.0, 0, None
        for g, i, v in rows:
            if g != last:
                ema, n, last = 0.0, 0, g
            ema, n = beta * ema + (1 - beta) * v, n + 1
            assert abs(got[g, i] - ema / (1 - beta**n)) < 1e-9


def cut_in_order(keyed, shard_chars, group):
    """Shards by the rule, one document after another."""
    shards, held, chars = [], [], 0
    for key, n in sorted(keyed):
        held.append(key)
        chars += n
        if chars >= shard_chars and len(held) % group == 0:
            shards.append(held)
            held, chars = [], 0
    return shards


@pytest.mark.parametrize(("shard_chars", "group"), [(100_000, 16), (1, 1), (3_000, 7), (10**9, 4), (50, 500)])
def test_repackaged_corpus(spark, sf_dir, texts, shard_chars, group):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    h = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.lit(42), "doc_id").alias("h")).collect()}
    want = cut_in_order([((h[i], i), len(t)) for i, t in texts.items()], shard_chars, group)
    got = collections.defaultdict(list)
    for r in S.repackaged(docs, shard_chars, group).collect():
        assert texts[r["doc_id"]] == r["text"]
        got[r["shard"]].append((h[r["doc_id"]], r["doc_id"]))
    assert {k: sorted(v) for k, v in got.items()} == dict(enumerate(want))


def test_repackaged_odd_rows(spark, tmp_path):
    """One id on very many rows, null ids and texts: rows of their own, none lost but the tail."""
    rows = [(7, "x" * 5)] * 300 + [(None, None)] * 50 + [(i, "y" * i) for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = S.repackaged(docs, 40, 4).toPandas()
    sizes = out.assign(n=out["text"].fillna("").str.len()).groupby("shard").agg(n=("n", "sum"), rows=("n", "size"))
    assert list(sizes.index) == list(range(len(sizes))) and (sizes["n"] >= 40).all() and (sizes["rows"] % 4 == 0).all() and len(rows) - len(out) < 60
    assert S.repackaged(docs.where("false"), 40, 4).collect() == [] and S.repackaged(docs.where("doc_id < 3"), 40, 4).collect() == []


def test_written_shards(spark, sf_dir, tmp_path):
    """Shards on disk hold whole row groups of the asked size."""
    import glob

    import pyarrow.parquet as pq

    whole = S.repackaged(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 50_000, 16)
    S.write_corpus(whole.where("shard = 1").select("text").coalesce(1), str(tmp_path / "c"), 16)
    files = [pq.ParquetFile(f) for f in glob.glob(f"{tmp_path}/c/*.parquet")]
    sizes = [f.metadata.row_group(k).num_rows for f in files for k in range(f.num_row_groups)]
    assert set(sizes) == {16}


# ------------------------------------------------------------ stores, alignment, tools


def test_content_hashes(spark, sf_dir, texts):
    for r in store.content_hashes(spark, sf_dir).collect():
        assert r["doc_hash"] == int.from_bytes(hashlib.blake2b(texts[r["doc_id"]].encode(), digest_size=8).digest(), "little", signed=True)


def test_char_spans(spark, vocabulary):
    odd = ["hello world", "café naïve", "你好世界 ok", "🌍🌎 a", "", "é"]
    rows = [(t, [len(vocabulary.decode_single_token_bytes(i)) for i in vocabulary.encode_ordinary(t)]) for t in odd] + [(t, [1] * len(t.encode())) for t in odd]
    for r in spark.createDataFrame(rows, "t string, n array<int>").withColumn("x", A.char_spans("t", "n")).collect():
        at, want = 0, []
        leads = [len(r["t"][:k].encode()) for k in range(len(r["t"]))]
        for n in r["n"]:
            want.append((sum(b < at for b in leads), sum(b < at + n for b in leads)))
            at += n
        assert [tuple(x) for x in r["x"]] == want
    with pytest.raises(Exception, match="bytes"):
        spark.createDataFrame([("ab", [1])], "t string, n array<int>").select(A.char_spans("t", "n")).collect()


def test_char_spans_are_flat():
    """A batch's spans are numbers in arrays: a Python object each took an executor's memory."""
    import tracemalloc

    import pyarrow as pa

    texts, lens = pa.array(["abc" * 2_000] * 100), pa.array([[3] * 2_000] * 100, pa.list_(pa.int32()))
    A.char_spans.func(texts, lens)
    tracemalloc.start()
    found = A.char_spans.func(texts, lens)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50 * 200_000 and found[99].as_py()[-1] == {"s": 5_997, "e": 6_000}


def test_noise(spark):
    rows = [(1, [[1.0, 2.0], [0.0, 0.0]]), (2, [[1.0, 2.0], [3.0, 4.0]])]
    df = spark.createDataFrame(rows, "k long, v array<array<float>>")
    once, again = (dict(df.repartition(n).select("k", A.seeded_noise(7, 0.5)("v", "k")).collect()) for n in (1, 2))
    assert once == again and once[1][1] == [0.0, 0.0] and once[1][0] != [1.0, 2.0] and once[1][0] != once[2][0]
    assert dict(df.select("k", A.seeded_noise(7, 0.0)("v", "k")).collect())[1] == rows[0][1]


def test_store_on_disk(spark, tmp_path):
    path = str(tmp_path / "store")
    part = spark.createDataFrame([("a", 1, [0.5]), ("b", 2, [1.5])], "shard string, key long, x array<double>")
    A.sweep(part.where("shard = 'a'"), path)
    with pytest.raises(ValueError, match="not finished"):
        A.assemble(spark, path, ["a", "b"], "activations")
    A.sweep(part.withColumn("x", F.array(F.lit(9.0))), path)  # only the shard that is not finished is written
    meta = A.assemble(spark, path, ["a", "b"], "activations", channels=1)
    data, found = A.open_store(spark, path)
    assert found == meta and {r["shard"]: r["x"] for r in data.collect()} == {"a": [0.5], "b": [9.0]}
    assert data.where("shard = 'b'").count() == 1
    A.write_json(spark, f"{path}/meta", meta | {"format": "other"})
    with pytest.raises(ValueError, match="not a store"):
        A.open_store(spark, path)
    with pytest.raises(ValueError, match="another order"):
        A.same_order(["a", "b"], ["b", "a"])


def test_index_needs_its_documents(spark):
    spans = spark.createDataFrame([("s", 0, 0, 3), ("s", 1, 3, 2)], "shard string, row long, start long, n long")
    corpus = spark.createDataFrame([("s", 0, "abc")], "shard string, row long, text string")
    with pytest.raises(Exception, match="no document"):
        A.hash_index(spans, corpus).collect()


def test_gates_refuse(spark):
    dead = spark.createDataFrame([(0, 0.0, 0.0)], "channel int, rms double, nonzero double")
    with pytest.raises(Exception, match="no active"):
        A.gates(dead, 0.1).collect()
    with pytest.raises(ValueError, match="too few"):
        A.gates(dead, 0.1, docs=3)


def test_lockstep(spark, sf_dir):
    rows = store.lockstep_rows(spark, sf_dir).collect()
    assert rows and all(r["in_step"] and r["n"] == 512 for r in rows)


def test_grades_refuse(spark):
    letters = F.array(F.lit("A"), F.lit("B"))
    with pytest.raises(Exception, match="no letter"):
        spark.range(1).select(K.same_letter(F.lit("C"), F.lit("A"), letters)).collect()
    with pytest.raises(Exception, match="no head"):
        spark.range(1).select(K.span_of_continuation(F.array(F.lit(1)), F.array(F.lit(2), F.lit(3)))).collect()


def test_tool_use(spark, sf_dir):
    s = N.BYTE_SPECIALS
    state = tools.ToolUse()
    fed = [s["<|python_start|>"], *b"2*21", s["<|python_end|>"], ord("!"), s["<|assistant_end|>"], ord("x")]
    out = [x for t in fed for x in state.feed(t)]
    forced = bytes(t for t, m in out if m == 0 and t < 256)
    assert forced == b"42" and state.done and out[-1] == (s["<|assistant_end|>"], 1)
    bad = tools.ToolUse()
    assert all(m for t in (s["<|python_start|>"], *b"import", s["<|python_end|>"]) for _, m in bad.feed(t))
    for r in store.tool_use(spark, sf_dir).collect():
        answer = len(str(r["sample"] * 2))
        assert r["done"] and r["forced"] == answer + 2 and r["n"] == 3 + 1 + len(str(r["sample"])) + 2 + 1 + answer + 2 + 6 + 1


def test_padded_rows(spark, sf_dir, texts):
    for r in tokens.padded_rows(spark, sf_dir).collect():
        assert r["n"] == 1024 and 1 <= r["ignored"] <= 1024
    docs = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5])], "doc_id long, ids array<int>")
    places = P.packed(docs.select(F.lit(0).alias("rank"), F.col("doc_id").alias("ord"), "doc_id", F.size("ids").alias("n")), 4, 10, "pad")
    rows = {r["row"]: r for r in P.padded(places, docs, 4, 9).collect()}
    assert (rows[0]["ids"], rows[0]["targets"], rows[0]["consumed"]) == ([1, 2, 3, 9], [2, 3, -1, -1], 1)
    assert (rows[1]["ids"], rows[1]["targets"], rows[1]["consumed"]) == ([4, 5, 9, 9], [5, -1, -1, -1], 2)


def test_more_sources(spark, tmp_path):
    (tmp_path / "words.txt").write_text(" apple \n\npear\n")
    assert [r["word"] for r in S.read_words(spark, str(tmp_path / "words.txt")).collect()] == ["apple", "pear"]
    (tmp_path / "t.json").write_text('{"label": "a", "icl_task_type": "lm", "num_fewshot": [0]}\n')
    (tmp_path / "b.csv").write_text("Eval Task,Random baseline\na,25\n")
    assert S.read_bundle(spark, str(tmp_path / "t.json"), str(tmp_path / "b.csv")).first()["baseline"] == 25.0
    r = spark.createDataFrame([("arc", 0.5, 0.25)], "task string, accuracy double, centered double")
    S.write_results_csv(r, spark.createDataFrame([(0.25,)], "core double"), str(tmp_path / "r"))
    back = {x["Task"]: (x["Accuracy"], x["Centered"]) for x in S.read_results_csv(spark, str(tmp_path / "r")).collect()}
    assert back == {"arc": (0.5, 0.25), "CORE": (None, 0.25)}
    for k in range(2):
        S.append_runs(spark.createDataFrame([(k, 1.5)], "depth int, loss double"), str(tmp_path / "runs"))
    assert spark.read.csv(str(tmp_path / "runs"), header=True).count() == 2
    files = spark.createDataFrame([("x", "model_1.pt", 5), ("y", "model_20.pt", 4), ("x", "model_3.pt.gz", 2)], "folder string, name string, modified long")
    assert tuple(S.newest(files).first()) == ("x", 3)
    S.write_corpus(spark.range(50).select(F.col("id").cast("string").alias("text")).coalesce(1), str(tmp_path / "c"), 16)
    shards = S.corpus_shards(spark, str(tmp_path / "c")).withColumnRenamed("row_index", "row")
    name = shards.first()["shard"]
    assert [x["text"] for x in S.scan_in_order(shards, name, "text").collect()] == [str(k) for k in range(50)]


def test_byte_lengths_with_specials(spark):
    path, pattern = tokens._vocabulary()
    rows = {r["token_id"]: r["n_bytes"] for r in N.byte_lengths(spark, path, pattern, zero_specials=False).collect()}
    assert rows[max(rows)] == len(N.SPECIALS[-1]) and N.start_token({"<|endoftext|>": 3}) == 3


def test_sources_of_activations(spark):
    docs = spark.createDataFrame([(1, "ab", 2), (2, "cde", 3), (3, "x", 1)], "doc_id long, text string, n int")
    ramp = sources.FnSource(lambda t, n: np.arange(2 * n).reshape(n, 2), 2)
    assert ramp.lookup(docs.where("doc_id = 1")).first()["values"] == [[0.0, 1.0], [2.0, 3.0]]
    stored = docs.where("doc_id < 3").select(A.content_hash("text").alias("doc_hash"), (F.col("n") + (F.col("doc_id") == 2).cast("int")).alias("n"), F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.0), F.lit(0.0))).cast("array<array<float>>").alias("values"))
    got = {r["doc_id"]: (r["hit"], r["values"]) for r in sources.StoreSource(stored, 2).lookup(docs).collect()}
    assert got[1] == (True, [[1.0, 2.0], [0.0, 0.0]]) and got[2] == (False, [[0.0, 0.0]] * 3) and got[3] == (False, [[0.0, 0.0]])
    noisy = {r["doc_id"]: r["values"] for r in sources.StoreSource(stored, 2, 0.5, 3).lookup(docs).collect()}
    assert noisy[1][0] != [1.0, 2.0] and noisy[1][1] == [0.0, 0.0] and noisy[2] == [[0.0, 0.0]] * 3
    stats = {r["channel"]: (r["rms"], r["nonzero"]) for r in sources.statistics(sources.StoreSource(stored, 2), docs).collect()}
    assert abs(stats[1][0] - 2**0.5) < 1e-9 and stats[1][1] == 0.5
    with pytest.raises(Exception, match="shape"):
        sources.FnSource(lambda t, n: np.zeros((1, 2)), 2).lookup(docs).collect()


def test_option_losses_of_a_stub(spark):
    rows = spark.createDataFrame([(1, 0, [5, 5, 9], 1, 3), (1, 1, [5, 1, 1], 1, 3), (1, 2, [1, 1, 1], 1, 3)], "item long, option int, ids array<int>, s int, e int")
    r = sources.option_losses(rows, lambda ids: [np.array(x, float) for x in ids]).first()
    assert (r["picked"], r["loss"]) == (1, 1.0)

"""Packing, sharding, mixing and chat formatting."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import chat, mixing, packing, sharding

SCHEMA = "doc_id long, text string, source string, n_chars long, mark string, row long, taken int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "m", 3, 4) for i, t, s in rows], SCHEMA)


ODD = [(1, None, "a"), (2, "", "a"), (3, "word " * 3000, "b"), (4, "hi", None), (4, "hi", None), (None, "x y z", "b"), (6, "é🌍", "c")]


# ------------------------------------------------------------ packing


@pytest.mark.parametrize("n", [0, 1, 1024, 1025, 5000])
def test_cut_points(n):
    cuts = packing.cut_points(n, 1024)
    assert sum(k for _, k in cuts) == n and [s for s, _ in cuts] == list(np.cumsum([0] + [k for _, k in cuts])[:-1])
    assert all(k == 1024 for _, k in cuts[1:])


@pytest.mark.parametrize(("seed", "n", "top"), [(0, 0, 9), (1, 40, 1023), (2, 3000, 1023), (3, 3000, 60), (4, 500, 3)])
def test_plan_places_each_piece_once(seed, n, top):
    rng = np.random.default_rng(seed)
    hist = np.bincount(rng.integers(1, top + 1, n), minlength=1025)
    p = packing.plan(hist)
    seqs: dict[int, list] = {}
    for length, first, alike, seq, offset in zip(*(p[k] for k in ("length", "first", "alike", "sequence", "offset")), strict=True):
        after = [f for v, f in zip(p["length"], p["first"], strict=True) if v == length and f > first]
        for nth in range((min(after) if after else hist[length]) - first):
            seqs.setdefault(int(seq + nth % alike), []).append((int(offset + nth // alike * length), int(length)))
    assert sum(map(len, seqs.values())) == n
    for members in seqs.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 1024
    total = int((hist * np.arange(1025)).sum())
    assert len(seqs) == p["sequences"] <= 1.02 * total / 1024 + 8


def test_fit_is_non_negative_and_near():
    hist = np.zeros(1025, dtype=int)
    hist[[300, 724, 512]] = (100, 100, 50)
    pats = packing.patterns(np.flatnonzero(hist), 1024)
    x = packing.fit_counts(hist, pats)
    used = np.zeros(1025)
    np.add.at(used, pats.ravel(), np.repeat(x, 3))
    assert (x >= 0).all() and abs(used[1:] - hist[1:]).max() < 1


def test_ids_equal_the_json_vocabulary():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    enc = packing.encoder(packing.tokenizer_path())
    for t in ("", "Hello  wörld\n\n 123", "a<|endoftext|>b", "你好 　  x", "  lead", "don't 'S we'LL"):
        assert list(enc(t)) == tok.encode(t, add_special_tokens=False).ids


def test_pack(spark):
    docs = docs_of(spark, ODD)
    rows = packing.pack(docs).collect()
    assert sum(r["piece"] == 0 for r in rows) == len(ODD)
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for members in by_seq.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    empty = [r for r in rows if r["doc_id"] == 1]
    assert empty[0]["ids_crc32"] == zlib.crc32(np.array([2], dtype="<u4").tobytes())
    assert packing.pack(docs.where("false")).collect() == []


def test_sequences_hold_the_ids(spark):
    docs = docs_of(spark, [r for r in ODD[:4]])
    placed = packing.pack(docs)
    seqs = {r["sequence_id"]: r["ids"] for r in packing.sequences(docs, placed).collect()}
    for r in placed.collect():
        piece = np.array(seqs[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]], dtype="<u4")
        assert zlib.crc32(piece.tobytes()) == r["ids_crc32"]


# ------------------------------------------------------------ sharding


def test_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = sharding.shuffled(docs, 8, bucket_bytes=20_000).toPandas()
    assert sorted(a["doc_id"]) == sorted(r[0] for r in docs.select("doc_id").collect())
    for _, g in a.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
        assert list(g.sort_values("slot")["doc_id"]) != sorted(g["doc_id"])
    assert ((a["grown_shard"] == a["shard"]) | (a["grown_shard"] == 8)).all() and (a["grown_shard"] == 8).any()
    more = sharding.shuffled(docs, 9, bucket_bytes=20_000).select("doc_id", "shard").toPandas().set_index("doc_id")["shard"]
    assert (more.loc[a["doc_id"]].to_numpy() == a["grown_shard"].to_numpy()).all()
    b = sharding.shuffled(docs.orderBy("text"), 8, bucket_bytes=20_000).toPandas()
    assert dict(zip(a["doc_id"], a["shard"], strict=True)) == dict(zip(b["doc_id"], b["shard"], strict=True))


def test_shards_of_odd_rows(spark, tmp_path):
    docs = docs_of(spark, ODD)
    rows = sharding.shuffled(docs, 3).collect()
    assert len(rows) == len(ODD) and {r["size"] for r in rows if r["text"] is None} == {1}
    assert sharding.shuffled(docs.where("false"), 3).collect() == []
    sharding.write_shards(docs, str(tmp_path / "s"), 3)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ODD)


# ------------------------------------------------------------ mixing


def water_level(sizes, weights, epochs=3):
    """Targets by sharing the excess again until none is above."""
    total, left, out = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    free = total
    while left:
        level = free / sum(weights[i] for i in left)
        over = [i for i in left if level * weights[i] > epochs * sizes[i]]
        if not over:
            for i in left:
                out[i] = level * weights[i]
            return out
        for i in over:
            out[i] = epochs * sizes[i]
            free -= out[i]
            left.remove(i)
    return out


@pytest.mark.parametrize("sizes", [[100], [10, 1000, 5], [1, 1, 1, 5000, 0, 30], [0, 0]])
def test_targets(spark, sizes):
    src = spark.createDataFrame([(f"s{i}" if i < len(sizes) - 1 or len(sizes) == 1 else None, n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(src).collect()}
    want = water_level(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert list(got.values()) and all(abs(got[s["source"]] - w) < 1e-6 for s, w in zip(src.collect(), want, strict=True))


@pytest.mark.parametrize(("votes", "seats"), [([53, 24, 23], 7), ([5, 5, 5], 4), ([100, 1, 1, 0], 50), ([7], 3), ([3, 2], 1), ([9, 1], 0)])
def test_apportion(spark, votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[i] += 1
    p = spark.createDataFrame([(i, float(v)) for i, v in enumerate(votes)], "party int, v double")
    got = {r["party"]: r["quota"] for r in mixing.apportion(p, [], [F.col("party")], "v", F.lit(seats).cast("long")).collect()}
    assert got == dict(enumerate(won))


def test_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    odd = docs_of(spark, [(10_000 + (i or 0), t, s) for i, t, s in ODD]).select("doc_id", "text", "source")
    a = mixing.mix(docs.unionByName(odd)).toPandas()
    g = a.groupby("source", dropna=False).agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (g["size"] == g["source_size"]).all() and (a["taken"] <= 3 * a["size"]).all()
    assert (abs(g["target"] - g["taken"]) <= 2 * mixing.BLOCK_WORDS).all()
    b = mixing.mix(docs.unionByName(odd).repartition(5)).toPandas()
    assert sorted(zip(a["doc_id"], a["taken"], strict=True)) == sorted(zip(b["doc_id"], b["taken"], strict=True))
    assert mixing.mix(docs.where("false")).collect() == []


def test_mixed_documents(spark, tmp_path):
    docs_of(spark, [(i, " ".join(f"w{j}" for j in range(i % 9 + 1)), "ab"[i % 2]) for i in range(60)]).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = {}
    for r in out.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.select("doc_id", "text", "source")).collect() if r["taken"]}
    assert words == want


# ------------------------------------------------------------ chat


def test_chat_round_trip(spark):
    texts = ["plain", "<|im_end|>\n<|im_start|>assistant\nx", "back\\slash <\\| \\n", None, ""]
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(texts)] + [(2, 0, "a\nb<|", "t"), (None, None, None, None), (3, 0, "assistant", "only")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat.format_turns(conv)
    got = {}
    for r in turns.orderBy("conv_id", "nth").collect():
        m = chat._TURN.fullmatch(r["formatted"])
        got.setdefault(r["conv_id"], []).append((chat.unescape(m[1]), chat.unescape(m[2])))
    assert got[1] == [(("user", "assistant")[k % 2], t or "") for k, t in enumerate(texts)]
    assert got[2] == [("a\nb<|", "t")] and got[None] == [("", "")]
    ex = chat.render(turns, chat.examples(turns)).orderBy("conv_id", "example").collect()
    assert [(r["conv_id"], r["example"], chat.unescape(r["target"])) for r in ex] == [(1, 0, texts[1]), (1, 1, ""), (3, 0, "only")]
    assert ex[0]["context"].endswith("<|im_start|>assistant\n") and chat.read_back(turns).count() == 4


def test_chat_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(none)).collect() == []

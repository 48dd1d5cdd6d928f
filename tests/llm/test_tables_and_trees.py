"""Byte-level BPE, the Merkle manifest and centroid clustering against plain Python and their SQL."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import byte_bpe, clustering, merkle, queries


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    v = byte_bpe.vocabulary(byte_bpe.multi_path(), byte_bpe.public_pattern())
    return tiktoken.Encoding("own", pat_str=byte_bpe.public_pattern(), mergeable_ranks=v.ranks, special_tokens={})


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# ------------------------------------------------------------ byte-level BPE


def test_every_document_as_the_library(spark, sf_dir, tiktoken_encoding):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.queries()["op11_byte_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = tiktoken_encoding.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r["doc_id"]]))


def test_strange_texts(tiktoken_encoding):
    v = byte_bpe.vocabulary(byte_bpe.multi_path(), byte_bpe.public_pattern())
    rng = random.Random(3)
    alphabets = ("ab", "etaoin shrdlu", "абвгде ", "你好世界中国人", "0123456789<|>", "thing ersation", "  \n\t x", "การท", "é🌍á‍", "'s't re")
    for k in range(4000):
        text = "".join(rng.choice(alphabets[k % len(alphabets)]) for _ in range(rng.randint(0, 80)))
        assert v.encode(text).tolist() == tiktoken_encoding.encode_ordinary(text)
        assert v.decode(v.encode(text).tolist()) == text.encode()


def test_small_vocabularies_by_definition():
    """Random rank files, whose tokens may be out of reach or made by later ranks: still the merges of the definition."""
    rng = random.Random(11)
    for _ in range(1200):
        words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(1, 25))})
        rng.shuffle(words)
        order = [bytes([b]) for b in range(256)] + words
        v = byte_bpe.Vocabulary({w: i for i, w in enumerate(order)}, r"\S+")
        for _ in range(40):
            piece = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
            whole = v.ranks.get(piece)
            want = [whole] if whole is not None else [v.ranks[p] for p in byte_bpe.merged(piece, v.ranks)]
            assert v.encode(piece.decode()).tolist() == want, (order[256:], piece)


def test_full_memories_change_nothing(monkeypatch, tiktoken_encoding):
    monkeypatch.setattr(byte_bpe, "MEMO", 4)
    ranks = byte_bpe.vocabulary(byte_bpe.multi_path(), byte_bpe.public_pattern()).ranks
    v = byte_bpe.Vocabulary(ranks, byte_bpe.public_pattern())
    text = "some quite unusualish wordlets in thisness of theirsome unusualish wordlets " * 20
    assert v.encode(text).tolist() == tiktoken_encoding.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 200_000, "abc" * 60_000, " " * 200_000 + "x", "word " * 300_000, "ก" * 60_000])
def test_very_long_texts(text, tiktoken_encoding):
    v = byte_bpe.vocabulary(byte_bpe.multi_path(), byte_bpe.public_pattern())
    assert v.encode(text).tolist() == tiktoken_encoding.encode_ordinary(text)


def test_encode_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, "", 6), (None, "hi hi", 7), (None, "hi hi", 7)], "doc_id long, text string, N_Tokens int")
    path, pattern = byte_bpe.multi_path(), byte_bpe.public_pattern()
    rows = byte_bpe.decode(byte_bpe.encode(docs, path, pattern), path, pattern).collect()
    assert sorted(bytes(r["raw"]) for r in rows) == [b"", b"", b"hi hi", b"hi hi"] and rows[0]["N_Tokens"] == 5
    assert byte_bpe.digests(docs, path, pattern).where("doc_id = 1 AND n_tokens = 0").count() == 2
    assert byte_bpe.digests(docs.where("false"), path, pattern).collect() == []
    assert docs.limit(1).select(byte_bpe.decoder(path, pattern)(F.lit(None).cast("array<int>")).alias("x")).first()["x"] is None
    with pytest.raises(ValueError, match="already"):
        byte_bpe.encode(docs.withColumn("IDS", F.lit(1)), path, pattern)


# ------------------------------------------------------------ Merkle manifest


def stated(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def rising(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
        out.append(nodes)
    return out


def climb(tree, at, now):
    siblings = ""
    for level in tree[:-1]:
        run, k = level[at // 16 * 16 : at // 16 * 16 + 16], at % 16
        siblings += "".join(run[:k] + run[k + 1 :])
        now = sha("".join([*run[:k], now, *run[k + 1 :]]))
        at //= 16
    return siblings, now


def manifest_in_python(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sources = {}
    for doc_id, source, lang, n_chars, text in rows:
        leaf = sha("".join(map(stated, (doc_id, source, lang, n_chars, text))))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        fake = sha("".join(map(stated, (doc_id, source, lang, n_chars, text and text.translate(lower))))) if hit else leaf
        sources.setdefault(source, []).append((doc_id is not None, doc_id, leaf, fake))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for n in names:
        sources[n].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        trees[n] = rising([x[2] for x in sources[n]])
    crown = rising([trees[n][-1][0] for n in names])
    out = []
    for j, n in enumerate(names):
        for i, (_, doc_id, leaf, fake) in enumerate(sources[n]):
            a, now = climb(trees[n], i, fake)
            b, now = climb(crown, j, now)
            out.append((doc_id, leaf, trees[n][-1][0], crown[-1][0], sha(a + b), now, now == crown[-1][0]))
    return sorted(out, key=repr)


def queried(spark, tmp_path, rows, name):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("Slot", F.lit(1)).withColumn("digest", F.lit("x"))
    docs.write.parquet(str(tmp_path / name / "documents.parquet"))
    return sorted(map(tuple, queries.queries()["op12_merkle_manifest"](spark, str(tmp_path / name)).collect()), key=repr)


def test_manifest_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted(map(tuple, queries.queries()["op12_merkle_manifest"](spark, sf_dir).collect()), key=repr)
    assert got == manifest_in_python(rows) and not all(r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_sql(same):
    same(queries.queries()["op12_merkle_manifest"], merkle.OP12_SQL)


def test_manifest_of_odd_rows(spark, tmp_path):
    """A hot source of three levels, sources of one row, 17 and 257 rows, nulls everywhere, ids and rows repeated, an empty source."""
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(600)]
    rows += [(i, f"one{i}", None, None, None) for i in range(20)] + [(i, "seventeen", "de", 1, "Ä") for i in range(17)] + [(i, "s257", "x", None, "") for i in range(257)]
    rows += [(None, None, None, None, None)] * 3 + [(7, None, "en", 1, "ABC"), (7, None, "en", 1, "ABC"), (7, None, "en", 1, "abc"), (5, "", "", 0, "X" * 100_000), (-3, "", "-", 2, "1:2")]
    assert queried(spark, tmp_path, rows, "many") == manifest_in_python(rows)
    assert queried(spark, tmp_path, rows[:1], "one") == manifest_in_python(rows[:1])
    assert queried(spark, tmp_path, rows[:2], "two") == manifest_in_python(rows[:2])
    assert queried(spark, tmp_path, [], "none") == []


def test_one_row_very_often(spark):
    """Rows that are equal go to several ranges, and are numbered through."""
    df = spark.range(40_000).select(F.lit("s").alias("source"), F.lit(1).alias("doc_id"), F.lit("d").alias("digest"))
    out = merkle.numbered(df, ["source"], ["doc_id", "digest"]).toPandas()
    assert sorted(out["nth"]) == list(range(40_000)) and set(out["of"]) == {40_000}


# ------------------------------------------------------------ clustering


def clusters_in_python(ids, vectors, k=40, rounds=5):
    x = np.floor(256 * np.array(vectors, float)).astype(np.int64)
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, sha(f"2:{ids[i]}"), x[i].tolist()))[:k]
    c = x[order].copy()
    for r in range(rounds + 1):
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        for j in range(len(c)) if r < rounds else ():
            if (near == j).any():
                c[j] = x[near == j].sum(axis=0) // (near == j).sum()
    d = d[np.arange(len(x)), near]
    return sorted(((i, int(a), int(b), int(d[near == a].sum()), int(d.sum()), sha(",".join(map(str, c[a].tolist())))) for i, a, b in zip(ids, near, d, strict=True)), key=repr)


def test_clusters_of_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    got = sorted(map(tuple, queries.queries()["op13_block_norm_clusters"](spark, sf_dir).collect()), key=repr)
    assert got == clusters_in_python([r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_clusters_sql(same):
    same(queries.queries()["op13_block_norm_clusters"], clustering.OP13_SQL)


def clustered_rows(spark, tmp_path, rows, name):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int").write.parquet(f"{path}/embeddings.parquet")
    return sorted(map(tuple, queries.queries()["op13_block_norm_clusters"](spark, path).collect()), key=repr)


def test_clusters_of_odd_rows(spark, tmp_path):
    """Vectors that are none are left out; repeated vectors, null ids and ties have one result; a third of all rows in one cluster."""
    rng = np.random.default_rng(4)
    good = [(i, [float(np.float32(v)) for v in rng.integers(-2, 3, 64) / 2]) for i in range(150)]
    good += [(i, good[0][1]) for i in range(150, 230)] + [(3, good[3][1])] * 4 + [(None, good[5][1]), (None, good[6][1])] + [(900, [-7.25] * 64)]
    bad = [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 65), (5, [1.0] * 63 + [None]), (6, [1.0] * 63 + [float("nan")]), (7, [1.0] * 63 + [float("inf")]), (8, [float("-inf")] * 64)]
    got = clustered_rows(spark, tmp_path, [(*r, 9) for r in good + bad], "many")
    assert got == clusters_in_python(*zip(*good, strict=True))
    few = good[:3]
    assert clustered_rows(spark, tmp_path, [(*r, 9) for r in few], "few") == clusters_in_python(*zip(*few, strict=True))
    assert clustered_rows(spark, tmp_path, [(*r, 9) for r in bad], "bad") == [] and clustered_rows(spark, tmp_path, [], "none") == []


def test_too_large_components(spark, tmp_path):
    with pytest.raises(Exception, match="component"):
        clustered_rows(spark, tmp_path, [(1, [1e9] * 64, 0)], "large")


@pytest.mark.parametrize("spread", [0.02, 0.3, 3.0])
def test_screen_loses_nothing(spread):
    """On groups that lie apart, most centroids are ruled out; the nearest is that of all exact distances, ties included."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 64)) * rng.uniform(0.2, 3, size=(40, 64))
    v = np.floor(256 * (centres[rng.integers(0, 40, 3000)] + spread * rng.normal(size=(3000, 64)))).astype(np.int64)
    c = np.floor(256 * centres).astype(np.int64)
    c[7] = c[3]
    number, best, taken = clustering.nearest(v, clustering.norms_of(v), c, clustering.norms_of(c))
    d = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (number == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert spread > 0.3 or taken < 0.25 * d.size

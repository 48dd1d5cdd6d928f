"""Exact and near deduplication against brute force."""

import hashlib
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import exact_dedup as E
from skein.llm import simhash as H

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, kept string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, "x") for i, t in rows], SCHEMA)


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


ODD = [(1, "Same Text"), (2, "same text"), (3, None), (4, ""), (5, " "), (5, " "), (None, "same text"), (6, "É"), (7, "é"), (8, "x" * 200_000), (9, "X" * 200_000), (10, "same text ")]


@pytest.mark.parametrize("memory", [1, 300, 1 << 20])
def test_exact_dedup(spark, memory):
    got = E.dedup(docs_of(spark, ODD), memory).collect()
    assert len(got) == len(ODD)
    groups = {}
    for i, t in ODD:
        groups.setdefault(lowered(t), []).append(i)
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        ids = [i for i in groups[text] if i is not None]
        assert r["group_size"] == len(groups[text]) and r["keep_id"] == max(ids)
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_empty_tables(spark):
    none = docs_of(spark, ODD).where("false")
    assert E.dedup(none).collect() == [] and H.near_dedup(none).collect() == []
    assert E.distinct_documents(none).columns == none.columns


def test_distinct_documents_keep_columns(spark, tmp_path):
    docs_of(spark, ODD).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = E.distinct_documents(docs)
    assert out.columns == docs.columns and out.count() == len({lowered(t) for _, t in ODD})


def record(text, n=1):
    return hashlib.sha256(text).digest(), text, n


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from([b"", b"a", b"b", b"cc" * 50, b"d" * 300, b"e" * 299]), max_size=60), st.sampled_from([1, 400, 10_000]))
def test_grace_spills_to_the_same_classes(texts, memory):
    got = {(t, n) for _, t, n in E.grace((record(t) for t in texts), memory)}
    assert got == {(t, texts.count(t)) for t in texts}
    folded = {}
    for _, t, n in E.fold((record(t) for t in texts), memory):
        folded[t] = folded.get(t, 0) + n
    assert folded == {t: texts.count(t) for t in texts}


def test_one_digest_for_two_texts_is_an_error():
    with pytest.raises(ValueError, match="one digest"):
        list(E.grace([(b"k" * 32, b"a", 1), (b"k" * 32, b"b", 1)]))


def plain_fingerprint(text, words=3):
    w = re.findall("[^\x20\x09-\x0d]+", lowered(text))
    sh = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB é\t\n  x", max_size=60))
def test_fingerprint(text):
    assert H.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_of_spark_hash(spark):
    """The hash is Spark's own xxhash64 of a string."""
    v = spark.sql("SELECT xxhash64('one two three')").first()[0]
    assert v % (1 << 64) == xxhash.xxh64_intdigest("one two three", 42)


def brute_components(fps, max_bits):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= max_bits:
                root[find(a)] = find(b)
    out = {}
    for f in fps:
        out.setdefault(find(f), set()).add(f)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize(("bucket", "max_bits"), [(2, 2), (24, 2), (8, 3)])
def test_links_lose_no_pair(spark, bucket, max_bits):
    """A dense cloud around two centres, so that buckets overflow at every level."""
    import random

    rng = random.Random(bucket)
    fps = set()
    for centre in (0, 2**64 - 1, 0x0F0F0F0F0F0F0F0F):
        for _ in range(60):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 4)):
                f ^= 1 << b
            fps.add(f - (1 << 64) if f >= 1 << 63 else f)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    stars = {r["node"]: r["root"] for r in H.components(H.links(nodes, max_bits, bucket).select("a", "b")).collect()}
    got = {}
    for f in fps:
        got.setdefault(stars.get(f, f), set()).add(f)
    assert sorted(map(sorted, got.values())) == brute_components(sorted(fps), max_bits)


def test_near_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", "text").collect() + [(900, None), (901, ""), (902, "\t"), (903, rows_text := "a b"), (904, "A b")]
    got = H.near_dedup(docs_of(spark, [(r[0], r[1]) for r in rows])).collect()
    fps = {r[0]: plain_fingerprint(r[1]) for r in rows}
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == fps and rows_text
    comps = brute_components(sorted(set(fps.values())), 2)
    least = {f: min(i for i, g in fps.items() if g in set(c)) for c in comps for f in c}
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: least[f] for i, f in fps.items()}


def jaccard(a, b, words=5):
    sh = [{tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} for w in (lowered(a).split(), lowered(b).split())]
    return len(sh[0] & sh[1]) / len(sh[0] | sh[1])


def test_near_copies_against_jaccard(spark, tmp_path):
    """Families of edited texts: copies of similarity 0.8 meet, other texts do not."""
    import random

    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 12))) for _ in range(3000)]
    rows, base = [], {}
    for family in range(30):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 600))]
        base[family] = " ".join(words)
        rows.append((family * 100, base[family]))
        for k in range(1, 6):
            edited = list(words)
            for _ in range(max(1, len(words) // rng.choice([60, 90, 200]))):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            rows.append((family * 100 + k, " ".join(edited)))
    rows += [(9000, None), (9001, ""), (9002, "a b")]
    docs_of(spark, rows).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    comp = {r["doc_id"]: r["component"] for r in H.near_copies(docs.select("doc_id", "text"), ["doc_id"]).collect()}
    text = dict(rows)
    close = [(i, i - i % 100) for i in comp if i < 9000 and i % 100 and jaccard(text[i], base[i // 100]) >= 0.8]
    assert len(close) > 80 and sum(comp[a] == comp[b] for a, b in close) == len(close)
    families = {}
    for i, c in comp.items():
        families.setdefault(c, set()).add(i // 100 if i < 9000 else 9000 + (i == 9002))
    assert all(len(f) == 1 for f in families.values())
    kept = [r["doc_id"] for r in H.one_of_each(docs).collect()]
    first = {}
    for i, c in comp.items():
        first[c] = min(i, first.get(c, i))
    assert sorted(kept) == sorted(first.values()) and H.one_of_each(docs.where("false")).collect() == []


def brute_near(texts):
    """The sets of ids that pairs of similarity 0.8 connect."""
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [lowered(t).split()]}
    for a in texts:
        for b in texts:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = {}
    for i in texts:
        out.setdefault(find(i), set()).add(i)
    return sorted(map(sorted, out.values()))


def near_sets(spark, folder, texts):
    docs_of(spark, list(texts.items())).write.parquet(folder)
    out = {}
    for r in H.near_copies(spark.read.parquet(folder).select("doc_id", "text"), ["doc_id"]).collect():
        out.setdefault(r["component"], []).append(r["doc_id"])
    return sorted(map(sorted, out.values()))


def invented(rng, n, least=2, most=8):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(least, most))) for _ in range(n)]


def test_near_copies_about_a_number_of_long_words(spark, tmp_path):
    """Copies that lose one of 32 long words are near copies like any other."""
    import random

    rng, texts = random.Random(5), {}
    for k in range(12):
        words = invented(rng, 32, 9, 12) + invented(rng, 60)
        rng.shuffle(words)
        edited = list(words)
        edited[next(i for i in range(20, 92) if len(words[i]) >= 9)] = "the"
        texts |= {2 * k: " ".join(words), 2 * k + 1: " ".join(edited)}
    assert brute_near(texts) == [[2 * k, 2 * k + 1] for k in range(12)]
    assert near_sets(spark, str(tmp_path / "d"), texts) == brute_near(texts)


def test_near_copies_of_large_groups(spark, tmp_path):
    """Over 24 variants of one template, alike with each other in twos and threes and some with the template."""
    import random

    rng, texts = random.Random(6), {}
    for template in range(2):
        base = invented(rng, 120)
        for k in range(40):
            words = list(base)
            for i in rng.sample(range(120), rng.choice([1, 1, 6, 6])):
                words[i] = invented(rng, 1)[0]
            for _ in range(rng.choice([1, 2, 3])):
                texts[len(texts)] = " ".join(words)
                words = list(words)
                words[rng.randrange(120)] = invented(rng, 1)[0]
    sets = brute_near(texts)
    assert len(sets) > 20 and any(len(s) > 24 for s in sets) and sum(1 < len(s) < 4 for s in sets) > 10
    assert near_sets(spark, str(tmp_path / "d"), texts) == sets


def test_near_copies_of_long_texts(spark, tmp_path):
    """One word in 50 of texts of thousands of words replaced by a new one."""
    import random

    rng, texts = random.Random(7), {}
    vocabulary = invented(rng, 4000, 2, 12)
    for k in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(2000, 6000))]
        edited = list(words)
        for i in range(rng.randrange(50), len(words), 50):
            edited[i] = invented(rng, 1, 5, 12)[0]
        texts |= {2 * k: " ".join(words), 2 * k + 1: " ".join(edited)}
    assert brute_near(texts) == [[2 * k, 2 * k + 1] for k in range(12)]
    assert near_sets(spark, str(tmp_path / "d"), texts) == brute_near(texts)

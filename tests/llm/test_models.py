"""Classifiers, rules, extraction: exact counts, edge cases and held-out accuracy."""

import collections
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import html_extract as H
from skein.llm import quality, rules, textstats, toxicity

TEST_SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, score string, label int, _stats int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "idiot " * 30_000), (5, "idiot " * 30_000), (None, "a b c")]
LABELS = "doc_id long, quality int, toxic int"


# ------------------------------------------------------------ counts


def plain_stats(t):
    w = re.findall("[^\x20\x09-\x0d]+", t)
    tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n\t#|🌍 ", max_size=50))
def test_stats(text):
    assert textstats.stats(text)[:5] == plain_stats(text)


# ------------------------------------------------------------ quality


def test_ranker_orders_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + 0.1 * rng.normal(size=600) > -0.8).astype(int)
    r = quality.Ranker(["a", "b", "c"]).fit(x, y)
    u = r.design(x) @ r.weights
    assert ((u >= r.tau) == (y == 1)).mean() > 0.93


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{TEST_SF}/documents.parquet"), spark.read.parquet(f"{TEST_SF}/labels.parquet")
    out = quality.op5_bradley_terry(spark, TEST_SF).join(labels, "doc_id").where("held_out").toPandas()
    assert (out["predicted"] == out["quality"]).mean() > 0.97 and out["score"].between(0, 1).all()
    assert quality.op5_bradley_terry(spark, TEST_SF).count() == docs.count()


def test_quality_of_odd_rows(spark):
    docs = docs_of(spark, ODD)
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (4, None, 0), (None, 1, 0)], LABELS)
    rows = quality.score(docs, labels, "q").collect()
    assert len(rows) == len(ODD) and all(0 <= r["q"] <= 1 for r in rows)
    assert quality.keep_good(docs, labels).columns == docs.columns
    none = quality.score(docs, labels.where("false"), "q").collect()
    assert {r["q"] for r in none} == {0.5}
    assert quality.score(docs.where("false"), labels, "q").collect() == []


# ------------------------------------------------------------ rules


def test_rules_find_a_conjunction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = 1 - ((x[:, 0] > 0.7) & (x[:, 1] <= 0.5)).astype(int)
    found = rules.learn(x, y, ["a", "b", "c"])
    bad = np.zeros(len(x), dtype=bool)
    for r in found:
        bad |= rules.covers(r, x, ["a", "b", "c"])
    assert found and (bad == (y == 0)).mean() > 0.97


def test_rules_equal_their_expression(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{TEST_SF}/documents.parquet"), spark.read.parquet(f"{TEST_SF}/labels.parquet")
    learned = rules.fit_rules(docs, labels)
    small = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = rules.apply_rules(small, learned).toPandas().set_index("doc_id")
    feats = textstats.features()
    x = textstats.text_stats(small, ["doc_id"]).select("doc_id", *(c.alias(n) for n, c in feats.items())).toPandas().set_index("doc_id")
    reject = np.zeros(len(x), dtype=bool)
    for r in learned:
        reject |= rules.covers(r, x.to_numpy(float), list(x.columns))
    assert (got.loc[x.index, "kept"].to_numpy() == (~got.loc[x.index, "base_failed"].to_numpy() & ~reject)).all()
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    for i, r in got.iterrows():
        n = plain_stats(texts[i])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0])
    held = rules.apply_rules(docs, learned).join(labels, "doc_id").where("NOT base_failed").toPandas()
    assert (held["kept"] == (held["quality"] == 1)).mean() > 0.97


def test_rules_of_odd_rows(spark):
    docs = docs_of(spark, ODD)
    assert rules.fit_rules(docs, spark.createDataFrame([], LABELS)) == []
    rows = rules.apply_rules(docs, []).collect()
    assert len(rows) == len(ODD) and not any(r["kept"] for r in rows)


# ------------------------------------------------------------ toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        new = [i]
        for j, cb in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (ca != cb)))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="idotmrn", min_size=1, max_size=8))
def test_automaton_equals_edit_distance(word):
    lex = toxicity.Lexicon(["idiot", "moron", "tom", "nitrodiom"], [])
    within = [edits(word, t) for t in lex.words if edits(word, t) <= lex.allowed(t)]
    assert lex.distance(word) == (min(within) if within else None)
    assert lex.kind(word) == (0 if not within else 1 if min(within) == 0 else 2)


def test_two_edits_and_misspelled_stems():
    lex = toxicity.Lexicon(["disgusting", "idiot"], ["contempt", "reprehensi"])
    assert [lex.kind(w) for w in ("tisgustimg", "contenptible", "contemptible", "reprahensible", "raprahensibly", "tisgustims", "content")] == [2, 2, 1, 2, 2, 0, 0]
    rng = random.Random(4)
    for _ in range(2000):
        word = list(rng.choice(["disgusting", "idiot", "contemptuous", "reprehensible"]))
        for _ in range(rng.randint(0, 3)):
            i, ch = rng.randrange(len(word)), rng.choice("abcdeginst")
            word[i : i + rng.randint(0, 1)] = rng.choice([[], [ch]])
        word = "".join(word) or "a"
        near = [edits(word, t) for t in lex.words if edits(word, t) <= lex.allowed(t)]
        near += [d for t in lex.stems if (d := min(edits(word[:n], t) for n in range(len(word) + 1))) <= lex.allowed(t)]
        assert lex.kind(word) == (0 if not near else 1 if min(near) == 0 else 2)


def test_hits_and_quotations():
    lex = toxicity.Lexicon(["idiot", "pathetic"], ["vequ"])
    assert toxicity.hits("You IDIOT, so pathetc vequar.", lex) == (2, 0, 1, 0)
    assert toxicity.hits('The word "idiot" is rude.', lex) == (0, 1, 0, 0)
    assert toxicity.hits(None, lex) == (0, 0, 0, 0)


def test_toxicity_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.op10_levenshtein_toxicity(spark, TEST_SF).join(labels, "doc_id").where("held_out").toPandas()
    assert (out["predicted"] == out["toxic"]).mean() > 0.96 and out["score"].between(0, 1).all()
    assert (out[out["toxic"] == 0]["predicted"] == 0).mean() > 0.997 and (out[out["toxic"] == 1]["predicted"] == 1).mean() > 0.88


def test_toxicity_of_odd_rows(spark):
    docs = docs_of(spark, ODD)
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (4, 1, None)], LABELS)
    assert toxicity.score(docs, labels).count() == len(ODD)
    assert toxicity.score(docs.where("false"), labels.where("false")).collect() == []


# ------------------------------------------------------------ extraction


@pytest.fixture(scope="module")
def trees():
    return H.fitted()


def test_nodes_of_unseen_layouts(trees):
    x, y = H.training_rows(80, seed=123)
    assert ((trees.raw(x) > 0) == (y == 1)).mean() > 0.99


def test_decoding_is_consistent_and_best():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 9)
        parents = [-1] + [rng.randint(0, k - 1) for k in range(1, n)]
        logit = np.array([rng.uniform(-3, 3) for _ in range(n)])
        got = H.decode(parents, logit)
        assert all(p < 0 or got[p] or not got[k] for k, p in enumerate(parents))
        score = lambda keep: sum(l if k else 0 for k, l in zip(keep, logit, strict=True))
        best = max(score(keep) for m in range(1 << n) if all(p < 0 or (m >> p & 1) or not (m >> k & 1) for k, p in enumerate(parents)) for keep in [[m >> k & 1 for k in range(n)]])
        assert abs(score(got) - best) < 1e-9


def test_extract(trees):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav>
    <div class="ad">Buy now and save.</div><article><h1>Title &amp; more</h1><p><b>First   para
    graph &lt;x&gt; with several words, and a stop.<br><p>Second one &#233; goes on for a while, it does. <a href="x">Link</a> ends it.</p></article>
    <section id="comments"><h2>Comments</h2><div class="comment"><p>Nice, I read all of it.</p></div></section><footer>&copy; site &middot; All rights.</footer></body>"""
    assert H.extract([page], trees) == ["Title & more\nFirst para graph <x> with several words, and a stop.\nSecond one é goes on for a while, it does. Link ends it."]
    assert H.extract([None, "", "<", "<p"], trees)[:2] == ["", ""]


@pytest.mark.parametrize("tag", ["<svg class='i' d='M0 0'/>", "<svg width='1'>", "<title-bar>x</title-bar>", "<style-guide></style-guide>", "<template-x>", "<svg><path d='a'/></svg>", "<iframe src='a'>", "<noscript>"])
def test_text_behind_a_tag_stays_in_the_tree(tag):
    page = H.parse(f"<article><p>{tag}one</p><p>Behind it.</p></article>")
    k = next(i for i, t in enumerate(page.text) if t == "Behind it.")
    assert not page.above[k] & H._UP["#silent"]
    whole = H.parse("<article><script>var a='<p>no</p>'</script><style>p{}</style><p>Yes.</p><title/>gone</article>")
    assert [t for t in whole.text if t.strip()] == ["Yes."]


def test_extract_pages(spark, sf_dir, trees):
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    rows = H.extract_pages(pages).collect()
    assert len(rows) == len(source)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", source[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])
    assert H.extract_pages(pages.where("false")).collect() == []
    assert H.extract_pages(spark.createDataFrame([(1, None, None, "x")], "page_id long, url string, html string, text string")).first()["text"] == ""

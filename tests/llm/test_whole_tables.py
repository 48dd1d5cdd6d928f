"""Whole tables against plain Python, hot keys, odd tables through the pipeline, pages of layouts that no generator made."""

import collections
import time
import zlib

import numpy as np
import pytest

import corpus_pipeline
from skein.llm import chat, packing, quality, queries, sharding, simhash, textstats, toxicity
from skein.llm import html_extract as H


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        new = [i]
        for j, cb in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (ca != cb)))
        row = new
    return row[-1]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


# ------------------------------------------------------------ packing, sharding


def test_packed_pieces_of_the_table(spark, sf_dir, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rows = queries.queries()["op1_best_fit_packing"](spark, sf_dir).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    tokens = 0
    for i, mine in pieces.items():
        ids = [*tok.encode(texts[i], add_special_tokens=False).ids, 2]
        tokens += len(ids)
        mine.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine))) and (len(mine) == 1 or len(ids) > 1024)
        at = 0
        for r in mine:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            assert r["length"] == 1024 or r["piece"] == 0 or len(ids) <= 1024
            at += r["length"]
        assert at == len(ids)
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.02 * -(-tokens // 1024) + 1


def test_shards_of_the_table(spark, sf_dir, texts):
    rows = queries.queries()["op2_external_shuffle"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    slots = collections.defaultdict(list)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 8) and 0 <= r["shard"] < 8
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and any(r["grown_shard"] == 8 for r in rows)
    again = queries.queries()["op2_external_shuffle"](spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_one_id_on_very_many_rows(spark, tmp_path):
    """An id with 50,000 equal rows, and null ids: one shard each, but buckets of a bounded size."""
    one = spark.range(50_000).selectExpr("7L AS doc_id", "'the same text in all of these rows' AS text")
    none = spark.range(3_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "CAST(id AS STRING) AS text")
    one.union(none).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    rows, buckets = sharding.scattered(docs, 4, bucket_bytes=50_000)
    sizes = [r["b"] for r in rows.groupBy("bucket").agg({"size": "sum"}).toDF("bucket", "b").collect()]
    assert len(sizes) > 30 and max(sizes) < 100_000 and buckets >= len(sizes)
    out = sharding.shuffled(docs, 4, bucket_bytes=50_000).toPandas()
    assert len(out) == 53_000 and out[out["doc_id"] == 7]["shard"].nunique() == 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))


# ------------------------------------------------------------ models


def test_quality_scores_of_the_table(spark, sf_dir):
    """The score that Spark computes is the fitted ranker's in numpy."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    ranker = quality.fit_ranker(docs, labels)
    feats = textstats.features()
    x = textstats.text_stats(docs, ["doc_id"]).select("doc_id", *(c.alias(n) for n, c in feats.items())).toPandas().set_index("doc_id")
    u = ranker.design((x.to_numpy(float))) @ ranker.weights
    want = dict(zip(x.index, 1 / (1 + np.exp(-(u + np.log(quality.CUT / (1 - quality.CUT)) - ranker.tau))), strict=True))
    got = {r["doc_id"]: r["q"] for r in quality.score(docs, labels, "q").select("doc_id", "q").collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-9


def test_labelled_rows_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(300)] + [(2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.labelled(docs, labels, "quality", 10).count() == 2


def test_hits_of_the_table_by_edit_distance(spark, sf_dir, texts):
    words, stems = ["idiot", "worthless", "clown", "scum"], ["disgust", "pathet", "achlich"]
    lexicon = toxicity.Lexicon(words, stems, {"clown": 0})
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    typos = spark.createDataFrame([(-1, "wrthless idoit, WORTHLES idiots scun disgsting pathetically clowm"), (-2, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["plain"] + r["quoted"], r["near_plain"] + r["near_quoted"]) for r in toxicity.hit_counts(docs.select("doc_id", "text").union(typos), lexicon, ["doc_id"]).collect()}
    known = {}

    def kind(w):
        if w not in known:
            d = [e for t in words if (e := edits(w, t)) <= lexicon.allowed(t)] + [e for t in stems if (e := min(edits(w[:n], t) for n in range(min(len(w), len(t) + 2) + 1))) <= lexicon.allowed(t)]
            known[w] = 0 if not d else 1 if min(d) == 0 else 2
        return known[w]

    short = {i: t for i, t in texts.items() if len(t) < 20_000} | {-1: "wrthless idoit, WORTHLES idiots scun disgsting pathetically clowm", -2: ""}
    for i, t in short.items():
        kinds = collections.Counter(kind(w) for w in toxicity._TOKEN.findall(t.lower()))
        assert got[i] == (kinds[1], kinds[2])
    assert got[-1] == (1, 4)


# ------------------------------------------------------------ near copies


def shingles(text):
    w = text.encode().translate(simhash.LOWER_BYTES).split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_components(texts):
    """Components of similarity 0.8 by counting shared shingles of all pairs that share one."""
    sets = {i: shingles(t) for i, t in texts.items()}
    by_set = collections.defaultdict(list)
    for i, s in sets.items():
        by_set[frozenset(s)].append(i)
    distinct = list(by_set)
    at = collections.defaultdict(list)
    for k, s in enumerate(distinct):
        for x in s:
            at[x].append(k)
    shared = collections.Counter((a, b) for ks in at.values() for n, a in enumerate(ks) for b in ks[n + 1 :])
    root = list(range(len(distinct)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for (a, b), n in shared.items():
        if 5 * n >= 4 * (len(distinct[a]) + len(distinct[b]) - n):
            root[find(a)] = find(b)
    out = collections.defaultdict(list)
    for k, s in enumerate(distinct):
        out[find(k)] += by_set[s]
    return sorted(map(sorted, out.values()))


def near_sets(spark, folder, texts):
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(folder)
    out = collections.defaultdict(list)
    for r in simhash.near_copies(spark.read.parquet(folder), ["doc_id"]).collect():
        out[r["component"]].append(r["doc_id"])
    return sorted(map(sorted, out.values()))


def test_near_copies_of_the_corpus(spark, tmp_path):
    """All links of sf0.1, found by brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").toPandas()
    texts = {int(i): t or "" for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    want = plain_components(texts)
    assert sum(len(s) > 1 for s in want) > 100
    assert near_sets(spark, str(tmp_path / "d"), texts) == want


def test_near_copies_by_order_and_in_families(spark, tmp_path):
    """Pairs that are other orders of the same words keep their links; a family of 60 is one component."""
    import random

    rng = random.Random(9)
    words = [f"w{k}" for k in range(200)]
    texts = {}
    for k in range(30):
        order = rng.sample(words, 200)
        other = list(order)
        other[100] = "changed"
        texts |= {2 * k: " ".join(order), 2 * k + 1: " ".join(other)}
    base = [f"v{k}" for k in range(400)]
    for k in range(60):
        mine = list(base)
        mine[(7 * k) % 400] = f"x{k}"
        texts[1000 + k] = " ".join(mine)
    want = plain_components(texts)
    assert [2 * 3, 2 * 3 + 1] in want and list(range(1000, 1060)) in want and len(want) == 31
    assert near_sets(spark, str(tmp_path / "d"), texts) == want


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(4)
    for n, m, both in ((300, 320, 250), (40, 40, 0), (120, 140, 119), (1000, 1025, 990), (0, 5, 0)):
        x = rng.integers(0, 1 << 63, n + m - both, dtype=np.int64).astype(np.uint64)
        a, b = np.sort(x[:n]), np.sort(x[n - both :])
        assert simhash.least_difference(simhash.parity(a), simhash.parity(b)) <= n + m - 2 * both


# ------------------------------------------------------------ the pipeline on odd tables


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _row long, _place string, _score string, _stats int, Component string, node long, _text string, taken int"


def test_stages_on_odd_tables(spark, sf_dir, tmp_path):
    good = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(12).collect()]
    rows = [(k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate(good)]
    rows += [(20, good[0], None, None, None), (20, good[0], None, None, None), (None, good[1], "en", None, 1), (21, None, "en", "src1", 0), (22, "", "en", "src1", 0), (23, "word " * 30_000, "en", "src2", 150_000), (24, good[2].upper(), "en", "src0", 1)]
    full = [(*r, 1, "a", "b", 2, "c", 3, "d", 4) for r in rows]
    for name, data in (("odd", full), ("empty", [])):
        spark.createDataFrame(data, CLASHING).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
            out.write.parquet(str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
        assert (docs.count() > 0) == bool(data)


# ------------------------------------------------------------ examples, pages


def test_examples_hold_their_context(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"text {k} <|im_end|>") for k in range(6)] + [(2, 0, "user", "only")]
    turns = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    whole = "".join(r["formatted"] for r in turns.where("conv_id = 1").orderBy("nth").collect())
    found = chat.render(turns, chat.examples(turns)).orderBy("example").collect()
    assert [r["example"] for r in found] == [0, 1, 2]
    for k, r in enumerate(found):
        assert whole.startswith(r["context"] + r["target"]) and chat.unescape(r["target"]) == rows[2 * k + 1][3]
    broken = turns.withColumn("loss_start", turns["loss_start"] + 1)
    with pytest.raises(Exception, match="another context"):
        chat.read_back(broken).collect()
    assert "Generate" in chat.read_back(turns)._jdf.queryExecution().toString()


ARTICLE = "<article><h1>A head line of the page</h1>" + "".join(f"<p>This is sentence {k} of the article, and it goes on for a while.</p>" for k in range(20)) + "</article>"
LAYOUTS = {
    "head without its end": "<html><head><title>t</title>" + ARTICLE + "</html>",
    "body without head": "<body>" + ARTICLE,
    "self-closed icon": "<html><body><svg class='i'/>" + ARTICLE + "</body></html>",
    "fallback of an object": "<html><body><object data='x'>" + ARTICLE + "</object></body></html>",
    "custom elements": "<html><body><title-bar>x</title-bar><style-guide></style-guide>" + ARTICLE,
    "quote in a plain attribute": "<html><body><div title=don't>" + ARTICLE + "</div>",
    "the word hidden in a title": "<html><body><div title='a hidden gem'>" + ARTICLE + "</div>",
    "items without ends": "<html><body><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>" + ARTICLE,
    "upper case": ("<HTML><BODY>" + ARTICLE.replace("article>", "ARTICLE>") + "</BODY></HTML>"),
    "main and footer": "<html><body><header><nav><a href='/'>Home</a></nav></header><main>" + ARTICLE + "</main><footer><p>Copyright 2020</p></footer></body></html>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts_that_no_generator_made(name):
    text = H.extract([LAYOUTS[name]], H.fitted())[0]
    lines = text.split("\n")
    assert lines[:2] == ["A head line of the page", "This is sentence 0 of the article, and it goes on for a while."] and len(lines) == 21


HEAD = "A headline of some words"
NAV = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
FOOT = "<footer>&copy; 2020 Some Site</footer>"
SAID = ["The first paragraph says a few words, with a comma and a stop.", "Another one follows it and goes on for a while, so that there is text to be found."]
TALK = "<div><h3>3 Comments</h3><p>Great read, thanks a lot for it.</p><p>I do not agree with the second point.</p><p>Me too.</p></div>"
SIDE = "<div class='sidebar'><h3>Latest</h3><p>Read our other text now.</p><ul><li><a href=/x>One</a></li></ul></div>"


def whole_page(body, name=""):
    return f"<html><head><title>{HEAD}</title></head><body{name and f' class={chr(34)}{name}{chr(34)}'}>{body}</body></html>"


def hand_written(k):
    """Pages of ``2 * k`` paragraphs and the lines that belong to the article."""
    ps = SAID * k
    text = "".join(f"<p>{p}</p>" for p in ps)
    lines, h1 = [HEAD, *ps], f"<h1>{HEAD}</h1>"
    art = f'<div id="content">{h1}{text}</div>'
    for name in ("comments-open", "has-sidebar", "no-sidebar", "search-enabled", "with-footer banner-on", "single header-fixed", "page sidebar-right", "notice"):
        yield f"body {name}", whole_page(NAV + art + FOOT, name), lines
        yield f"body {name}, nothing else", whole_page(art, name), lines
    for tag in ('form method="post" action="./d.aspx"', "aside", 'div class="ad-free"', 'div class="notice"', 'div class="main has-comments"', 'div class="sidebar-layout"'):
        end = f"</{tag.split()[0]}>"
        yield f"inside {tag}", whole_page(f"{NAV}<{tag}>{art}{end}{FOOT}"), lines
        yield f"all inside {tag}", whole_page(f"<{tag}>{NAV}{art}{FOOT}{end}"), lines
        yield f"only {tag}", whole_page(f"<{tag}>{art}{end}"), lines
    for tag in ('div class="article-header"', 'div class="post-header"', "header", 'header class="entry-header"'):
        yield f"headline in {tag}", whole_page(f"{NAV}<article><{tag}>{h1}</{tag.split()[0]}>{text}</article>{FOOT}"), lines
    rest = text.replace(f"<p>{SAID[0]}</p>", "", 1)
    for tag in ("blockquote class=reply", "blockquote", "pre", "div class=caption"):
        inner = f"<{tag}>A quoted answer stands here.</{tag.split()[0]}>"
        yield f"{tag} inside", whole_page(f"{NAV}<article>{h1}<p>{SAID[0]}</p>{inner}{rest}</article>{FOOT}"), [*lines[:2], "A quoted answer stands here.", *lines[2:]]
    yield "table inside", whole_page(f"{NAV}<article>{h1}{text}<table><tr><td>Year</td><td>1990</td></tr></table></article>{FOOT}"), [*lines, "Year", "1990"]
    yield "definitions inside", whole_page(f"{NAV}<article>{h1}{text}<dl><dt>Word</dt><dd>What it says.</dd></dl></article>{FOOT}"), [*lines, "Word", "What it says."]
    for noise in ("<div class=ad>Buy this now, it is cheap.</div>", "<div class='share'><a href=/f>Like</a> <a href=/t>Post</a></div>", "<aside class=promo><p>Our shop has it all.</p></aside>", "<form><input name=q><button>Go</button></form>"):
        yield f"noise inside: {noise[:12]}", whole_page(f"{NAV}<article>{h1}<p>{SAID[0]}</p>{noise}{rest}</article>{FOOT}"), lines
    yield "comments without a name", whole_page(f"{NAV}<article>{h1}{text}</article>{TALK}{FOOT}"), lines
    yield "comments without a name beside", whole_page(f"{NAV}<div><div>{h1}{text}</div>{TALK}</div>{FOOT}"), lines
    yield "comments in the article", whole_page(f"{NAV}<article>{h1}{text}{TALK}</article>{FOOT}"), lines
    yield "comments by name", whole_page(f"{NAV}<main>{h1}{text}</main><section id=comments><h2>Talk</h2><div class=comment><p>Great read, thanks.</p></div><div class=comment><p>Me too, I say.</p></div></section>{FOOT}"), lines
    yield "sidebar", whole_page(f"{NAV}<div class=wrap><div class=content>{h1}{text}</div>{SIDE}</div>{FOOT}"), lines
    divs = "".join(f"<div>{x}</div>" for x in lines)
    yield "bare divisions", whole_page(divs), lines
    yield "bare divisions and comments", whole_page(divs + "<div>3 Comments</div><div>Great read, thanks a lot for it.</div><div>I do not agree.</div>"), lines


@pytest.mark.parametrize("k", [1, 5])
def test_hand_written_pages(k):
    cases = list(hand_written(k))
    assert len(cases) > 45
    got = H.extract([page for _, page, _ in cases], H.fitted())
    assert {name: text.split("\n") for (name, _, _), text in zip(cases, got, strict=True)} == {name: lines for name, _, lines in cases}


@pytest.mark.parametrize("page", ["<div>" * 100_000 + "x", "<p>a</b>" * 50_000, "<p><button>" + "<ul>" * 50_000, "<svg>" * 20_000, "<ul>" + "<span>" * 30_000 + "<li></li>" * 30_000, "<p title=don't>a " * 20_000])
def test_deep_and_broken_pages_take_linear_time(page):
    H.fitted()
    began = time.process_time()
    H.extract([page], H.fitted())
    long = time.process_time() - began
    began = time.process_time()
    H.extract([page[: len(page) // 4]], H.fitted())
    assert long < 10 * (time.process_time() - began) + 1.0


def test_frames_that_are_no_tables(spark, sf_dir):
    """Operators that name rows by their place store what is not a plain scan first."""
    from skein.llm import exact_dedup, mixing
    from skein.llm.common import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert stored(docs) is docs and stored(docs.select("doc_id").where("doc_id > 3")) is not None
    mixed = docs.orderBy("text").union(docs.limit(3))
    assert stored(mixed) is not mixed and stored(mixed).count() == mixed.count()
    assert {r[0] for r in exact_dedup.distinct_documents(mixed).select("doc_id").collect()} == {r[0] for r in exact_dedup.distinct_documents(docs).select("doc_id").collect()}
    assert mixing.mixed_documents(mixed).columns == docs.columns


def test_fingerprint_of_a_very_long_text():
    import xxhash

    words = [f"Word{k % 7919}" for k in range(200_000)]
    low = [w.lower().encode() for w in words]
    counts, bits = np.zeros(64, np.int64), np.arange(64, dtype=np.uint64)
    for k in range(len(low) - 2):
        h = xxhash.xxh64_intdigest(b" ".join(low[k : k + 3]), 42)
        counts += (np.uint64(h) >> bits).astype(np.int64) & 1
    want = sum(1 << b for b in range(64) if 2 * counts[b] > len(low) - 2)
    assert simhash.fingerprint(" ".join(words)) == want

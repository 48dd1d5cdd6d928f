"""Toxicity by Levenshtein automata over a learned lexicon.

The lexicon is learned from labelled texts: words and word stems whose
presence in a text goes with the toxic label beyond chance. Its terms form a
trie; a word is looked up by running a Levenshtein automaton of the word along
the trie, so all terms within the edit distance are found together and
branches that cannot lead to one are left early. Stems match any word that
begins with them or with a misspelling of them. Every hit is scored in its window of words: hits between
quotation marks, or after words that speak about a word, count apart from
plain ones. A logistic model with priors, fitted on the same labelled texts,
weighs plain and quoted, exact and misspelled hits.

At most ``MAX_LABELLED`` labelled rows, chosen by a hash of their id, are
learned from; every whole text is scored. The lexicon has at most ``MAX_TERMS``
terms, chosen among the ``MAX_MARKS`` words and stems that most toxic texts of
that sample hold, each in ``LEAST_TEXTS`` at least: bounds of what is learned,
not of what is searched.

Edge cases: null and empty texts have no hits and get the score of none; null
labels are not used; without toxic labels the lexicon is empty and all texts
score alike; repeated rows each give a row; an empty table gives an empty
result; other columns are ignored. Texts of any length are searched whole; of hits of one kind the fifth and later
add nothing to a score, and stems have 3 to 14 letters. Terms that tie in the sample go by length, then spelling.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, table
from .quality import labelled, remainder

MAX_LABELLED = 8_000
CUT = 0.7
WINDOW = 8
STEM_LENGTHS = range(3, 15)
MAX_TERMS = 400
MAX_MARKS = 50_000
LEAST_TEXTS = 4
#: How far a term's likelihood ratio has to stand above what the best of all candidates has by chance.
MARGIN = 4.0
_TOKEN = re.compile(r"\w+")
_WORD_END = "\x00"
#: Share of clean texts of the sample that misspellings of one term may hit; a term that hits more bears fewer edits.
CLEAN_HITS = 0.001
KINDS = ("plain", "quoted", "near_plain", "near_quoted")
_QUOTE_MARKS = frozenset("\"“”„«»‹›‘’`")
#: Words that announce that a word is mentioned and not used (fixed values).
MENTIONS = frozenset("word words term terms quote quoted quotes said says saying called wrote phrase slur insult mot dit wort sagte palabra dijo".split())


# ------------------------------------------------------------ the automaton


def base_allowance(term: str) -> int:
    """Edits that a term of this length may bear: none below 5 letters, one below 9, else two."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """A trie of terms and the Levenshtein automata that run along it.

    ``stems`` are terms that any continuation may follow; ``allowed`` has the
    edits of single terms where they are less than ``base_allowance``. A state of
    the automaton is the set of trie nodes that the letters so far may have led
    to, each with its least edits, and the stems met by then. States are made
    when a word first needs them and are shared by all words, so a word costs a
    look-up a letter. At ``MAX_STATES`` states or known words they are forgotten
    and made anew.
    """

    MAX_STATES = 200_000

    def __init__(self, words: list[str], stems: list[str], allowed: dict[str, int] | None = None):
        self.words, self.stems = sorted(words), sorted(stems)
        self.terms = [*self.words, *self.stems]
        self.allow = [(allowed or {}).get(t, base_allowance(t)) for t in self.terms]
        self.children: list[dict[str, int]] = [{}]
        self.most = [0]  # edits that any term below a node may bear
        self.ends: list[list[int]] = [[]]
        for k, term in enumerate(self.terms):
            node = 0
            self.most[0] = max(self.most[0], self.allow[k])
            for ch in term:
                node = self.children[node].setdefault(ch, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.most.append(0)
                    self.ends.append([])
                self.most[node] = max(self.most[node], self.allow[k])
            self.ends[node].append(k)
        self.forget()

    def allowed(self, term: str) -> int:
        """The edits that ``term`` may bear here."""
        return self.allow[self.terms.index(term)]

    def forget(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple[tuple, tuple]] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple | None] = []
        self.seen: dict[str, int] = {}
        self.start = self._state({0: 0}, {})

    def _state(self, at: dict[int, int], stems: dict[int, int]) -> int:
        """The number of a state: nodes with their least edits (letters of terms may be left out) and the stems met."""
        left = list(at)
        while left:
            node = left.pop()
            e = at[node] + 1
            for child in self.children[node].values():
                if e <= self.most[child] and e < at.get(child, 99):
                    at[child] = e
                    left.append(child)
        stems = dict(stems)
        for node, e in at.items():
            for k in self.ends[node]:
                if k >= len(self.words) and e <= self.allow[k]:
                    stems[k] = min(e, stems.get(k, 99))
        key = tuple(sorted(at.items())), tuple(sorted(stems.items()))
        n = self.ids.setdefault(key, len(self.states))
        if n == len(self.states):
            self.states.append(key)
            self.moves.append({})
            self.found.append(None)
        return n

    def _move(self, state: int, ch: str) -> int:
        at: dict[int, int] = {}
        nodes, stems = self.states[state]
        for node, e in nodes:
            if e < self.most[node]:  # a letter too many
                at[node] = min(e + 1, at.get(node, 99))
            for c, child in self.children[node].items():
                d = e + (c != ch)
                if d <= self.most[child] and d < at.get(child, 99):
                    at[child] = d
        return self._state(at, dict(stems))

    def matches(self, word: str) -> tuple[tuple[int, int], ...]:
        """The terms within their allowance of ``word`` (stems: of a beginning of it), as numbers, with their edits."""
        if len(self.states) > self.MAX_STATES:
            self.forget()
        state = self.start
        for ch in word:
            moves = self.moves[state]
            after = moves.get(ch)
            if after is None:
                after = moves[ch] = self._move(state, ch)
            state = after
            if not self.states[state][0]:
                break  # nothing else can be met
        if self.found[state] is None:
            nodes, stems = self.states[state]
            met = dict(stems)
            for node, e in nodes:
                for k in self.ends[node]:
                    if k < len(self.words) and e <= self.allow[k]:
                        met[k] = e
            self.found[state] = tuple(sorted(met.items()))
        return self.found[state]

    def distance(self, word: str) -> int | None:
        """Edits to the nearest term within its allowance, or None."""
        return min((d for _, d in self.matches(word)), default=None)

    def kind(self, word: str) -> int:
        """0: no hit, 1: a term or a stem's continuation, 2: a misspelled term."""
        known = self.seen.get(word)
        if known is None:
            if len(self.seen) > self.MAX_STATES:
                self.seen.clear()
            d = self.distance(word)
            known = self.seen[word] = 0 if d is None else 1 if d == 0 else 2
        return known


def hits(text: str | None, lexicon: Lexicon) -> tuple[int, int, int, int]:
    """Exact plain, exact quoted, misspelled plain and misspelled quoted hits."""
    return hits_and_words(text, lexicon)[:4]


def hits_and_words(text: str | None, lexicon: Lexicon) -> tuple[int, int, int, int, int]:
    """The four counts of hits and how many words there are."""
    low = (text or "").lower()
    words = _TOKEN.findall(low)
    seen, kind = lexicon.seen, lexicon.kind
    kinds = {w: k for w in set(words) if (k := seen[w] if w in seen else kind(w))}
    out = [0, 0, 0, 0]
    if kinds:
        spans = [m.span() for m in _TOKEN.finditer(low)]
        for i, w in enumerate(words):
            if k := kinds.get(w):
                out[2 * (k - 1) + mentioned(low, words, spans, i)] += 1
    return (*out, len(words))


def mentioned(text: str, words: list[str], spans: list[tuple[int, int]], i: int) -> bool:
    """Whether the window around word ``i`` shows a quotation: the score of its signs is 1 or more."""
    lo, hi = max(0, i - WINDOW), min(len(words) - 1, i + WINDOW)
    before, after = text[spans[lo][0] : spans[i][0]], text[spans[i][1] : spans[hi][1] + 1]
    score = 0.0
    if sum(before.count(q) for q in _QUOTE_MARKS) % 2 and any(q in after for q in _QUOTE_MARKS):
        score += 1.0
    if any(w in MENTIONS for w in words[lo:i]):
        score += 0.5
        score += 0.5 * (text[spans[i][0] - 1 : spans[i][0]] in _QUOTE_MARKS)
    return score >= 1.0


# ------------------------------------------------------------ learning


def _marks(words: set[str]) -> set[str]:
    return {w[:n] for w in words for n in STEM_LENGTHS if len(w) >= n} | {w + _WORD_END for w in words if len(w) > 2}


def toxic_marks(sample: DataFrame) -> DataFrame:
    """Toxic texts of ``sample(label, text)`` -> mark, toxic.

    A mark is a word (ends in a null byte) or a stem. It counts once for each
    different pair of neighbours, so that copies of one text, near copies
    included, count as one text and a word used in many texts counts as often.
    """
    schema = T.StructType([T.StructField("mark", T.StringType()), T.StructField("near", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text in batch.column(0):
                words = ["", *_TOKEN.findall((text.as_py() or "").lower()), ""]
                where = {w: i for i, w in enumerate(words) if w}  # a text counts once
                by_mark = {}
                for w, i in where.items():
                    near = zlib.crc32(f"{words[i - 1]} {words[i + 1]}".encode())
                    for m in _marks({w}):
                        by_mark[m] = max(near, by_mark.get(m, 0))
                found.update(by_mark.items())
            marks = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in marks], pa.string()), pa.array([n for _, n in marks], pa.int64())], names=schema.names)

    pairs = sample.where("label = 1").select(F.col("text").cast("string")).mapInArrow(run, schema).distinct()
    return pairs.groupBy("mark").agg(F.count("*").alias("toxic")).where(f"toxic >= {LEAST_TEXTS}")


def clean_counts(sample: DataFrame, marks: list[str]) -> dict[str, int]:
    """How many clean texts of the sample hold each of ``marks``."""
    schema = T.StructType([T.StructField("mark", T.StringType()), T.StructField("clean", T.LongType())])
    wanted = frozenset(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(_marks(set(_TOKEN.findall((text.as_py() or "").lower()))) & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=schema.names)

    found = sample.where("label = 0").select(F.col("text").cast("string")).mapInArrow(run, schema)
    return {r["mark"]: r["n"] for r in found.groupBy("mark").agg(F.sum("clean").alias("n")).collect()}  # at most len(marks)


def choose_terms(rows: list[tuple[str, int, int]], toxic: int, clean: int, tried: int) -> Lexicon:
    """Terms whose likelihood ratio stands out of ``tried`` candidates; the longest of alike stems."""
    base = toxic / max(1, toxic + clean)

    def ratio(p: int, n: int) -> float:
        q = p / (p + n)
        if q <= base:
            return 0.0
        return 2 * (p * math.log(q / base) + (n * math.log((1 - q) / (1 - base)) if n else 0.0))

    whole = {m[:-1]: p for m, p, n in rows if m.endswith(_WORD_END)}
    least = 2 * math.log(max(tried, 2)) + MARGIN
    scored = sorted(((ratio(p, n), m, p) for m, p, n in rows if not m.endswith(_WORD_END) and p >= 4 and p / (p + n) > max(0.6, base)), key=lambda x: (-x[0], -len(x[1]), x[1]))
    chosen: list[str] = []
    words, stems = [], []
    for r, mark, p in scored:
        if r < least or len(chosen) >= MAX_TERMS:
            break
        if any(mark.startswith(c) or c.startswith(mark) for c in chosen):
            continue
        chosen.append(mark)
        (words if whole.get(mark, 0) >= 0.8 * p else stems).append(mark)
    return Lexicon(words, stems)


def allowances(sample: DataFrame, lexicon: Lexicon, clean: int) -> dict[str, int]:
    """The edits that each term may bear: fewer where its misspellings are ordinary words, by the clean texts they are in."""
    words, stems = lexicon.words, lexicon.stems

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counts = Lexicon(words, stems), Counter()
        for batch in batches:
            for text in batch.column(0):
                near = {}
                for w in set(_TOKEN.findall((text.as_py() or "").lower())):
                    for k, d in own.matches(w):
                        if d:
                            near[k] = min(d, near.get(k, 99))
                counts.update(near.items())
        cols = [pa.array([key[i] for key in counts], pa.int64()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(list(counts.values()), pa.int64())], names=["term", "edits", "texts"])

    found = sample.where("label = 0").select(F.col("text").cast("string")).mapInArrow(run, "term long, edits long, texts long")
    texts = {(r["term"], r["edits"]): r["n"] for r in found.groupBy("term", "edits").agg(F.sum("texts").alias("n")).collect()}  # two a term at most
    out = {}
    for k, term in enumerate(lexicon.terms):
        edits = base_allowance(term)
        while edits and sum(texts.get((k, d), 0) for d in range(1, edits + 1)) > CLEAN_HITS * clean:
            edits -= 1
        out[term] = edits
    return out


#: Prior means of the weights of the four kinds of hits, of the logarithm of a text's words (a long text has hits by chance) and of the bias.
PRIOR = np.array([2.0, 0.4, 1.5, 0.3, 0.0, -2.5])
PRIOR_STRENGTH = np.array([0.5, 5.0, 5.0, 5.0, 0.5, 0.05])


def design(counts: np.ndarray) -> np.ndarray:
    """Rows of the four hit counts and the words as the model sees them."""
    return np.concatenate([np.minimum(counts[:, :4], 4.0), np.log1p(counts[:, 4:5]), np.ones((len(counts), 1))], axis=1)


def fit_weights(counts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with Gaussian priors around ``PRIOR``, by Newton steps."""
    x, w = design(counts.astype(float)), PRIOR.copy()
    if not len(x):
        return w
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + PRIOR_STRENGTH * (w - PRIOR)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(PRIOR_STRENGTH)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    w[:4] = np.maximum(w[:4], 0.0)  # a hit is never a sign of a clean text
    return w


def hit_counts(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, the four hit counts and the words of every whole text."""
    names = (*KINDS, "words")
    schema = T.StructType([*docs.select(*keep).schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    words, stems, allowed = lexicon.words, lexicon.stems, dict(zip(lexicon.terms, lexicon.allow, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(words, stems, allowed)
        for batch in batches:
            rows = np.array([hits_and_words(t.as_py(), own) for t in batch.column(len(keep))], dtype=np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(rows[:, j]) for j in range(5))], names=schema.names)

    return docs.select(*keep, F.col("text").cast("string").alias("_text_")).mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[Lexicon, np.ndarray]:
    sample = cut(labelled(docs, labels, "toxic", limit))
    by_label = dict.fromkeys((0, 1), 0) | {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic = {r["mark"]: r["toxic"] for r in toxic_marks(sample).orderBy(F.col("toxic").desc(), "mark").limit(MAX_MARKS).collect()}
    clean = clean_counts(sample, list(toxic))
    lexicon = choose_terms([(m, n, clean.get(m, 0)) for m, n in toxic.items()], by_label[1], by_label[0], len(toxic))
    lexicon = Lexicon(lexicon.words, lexicon.stems, allowances(sample, lexicon, by_label[0]))
    known = hit_counts(sample, lexicon, ["label"]).toPandas()
    return lexicon, fit_weights(known.iloc[:, 1:].to_numpy(), known["label"].to_numpy())


def score_column(weights: np.ndarray) -> Column:
    total = F.lit(float(weights[5])) + F.log1p("words") * float(weights[4])
    for name, w in zip(KINDS, weights, strict=False):
        total = total + F.least(F.col(name), F.lit(4)) * float(w)
    return 1.0 / (1.0 + F.exp(-total))


def score(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> DataFrame:
    """doc_id, the four hit counts, the words and ``score`` of every row."""
    bounded_batches(docs.sparkSession)
    lexicon, weights = learn(docs, labels if train is None else labels.where(train))
    return hit_counts(docs, lexicon, ["doc_id"]).withColumn("score", score_column(weights))


def op10_levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score(docs, labels, remainder(F.col("doc_id"), 3) != 1)
    return out.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

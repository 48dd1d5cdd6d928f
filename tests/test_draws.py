"""Seeded draws against Python's own generator."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skein.functions import draws as D
from skein.functions import tasks as K

QUERIES = entry.queries()


@pytest.fixture(scope="module")
def items(spark, sf_dir):
    return [r["item_id"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").collect()]


@pytest.fixture(scope="module")
def words(spark, sf_dir):
    import re

    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").collect()]
    return [m[0].lower() for t in texts if (m := re.search("[A-Za-z]+", t))]


def test_few_shot(spark, sf_dir, items):
    got = {(r["item_id"], r["shot"]): r["example"] for r in QUERIES["few_shot_pairs"](spark, sf_dir).collect()}
    assert len(got) == 3 * len(items)
    for idx, item in enumerate(items):
        rng = random.Random(1234 + idx)
        drawn = rng.sample([i for i in range(len(items)) if i != idx], 3)
        assert [got[item, k] for k in range(3)] == [items[i] for i in drawn]


def test_others_of_few_rows(spark):
    rows = spark.createDataFrame([(0, 1), (0, 2), (2, 4), (None, 4)], "i long, n long")
    got = [r["x"] for r in rows.select("i", "n", D.others(7, 3)("i", "n").alias("x")).collect()]
    assert got[0] == [] and got[1] == [1] and sorted(got[2]) == [0, 1, 3] and got[3] is None


def test_head_of_a_shuffle(spark, sf_dir, items):
    order = list(items)
    random.Random(1337).shuffle(order)
    got = {r["place"]: r["item_id"] for r in QUERIES["seeded_head"](spark, sf_dir).collect()}
    assert got == dict(enumerate(order[:10]))


def test_mixture(spark, sf_dir, items):
    es = [r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'es'").orderBy("doc_id").collect()]
    index_map = [(0, i) for i in es] + [(1, i) for i in es] + [(2, i) for i in items]
    random.Random(42).shuffle(index_map)
    got = {r["place"]: (r["task"], r["item"]) for r in QUERIES["task_mixture"](spark, sf_dir).collect()}
    assert got == dict(enumerate(index_map))


@pytest.mark.parametrize("n", [0, 1, 5, 70_000])
def test_permutation(spark, n):
    want = list(range(n))
    random.Random(9).shuffle(want)
    got = D.permutation(spark, n, 9, rows=1000).toPandas()
    assert got["place"].tolist() == list(range(n)) and got["index"].tolist() == want


def asked_in_python(index, words, seed):
    rng = random.Random(seed + index)
    word = rng.choice(words)
    letter = rng.choice(word) if rng.random() < 0.9 else rng.choice("abcdefghijklmnopqrstuvwxyz")
    template = rng.choice(K.QUESTIONS)
    if rng.random() < 0.3:
        template = template.lower()
    a, b = rng.choice(["", "'", '"']), rng.choice(["", "'", '"'])
    asked = template.format(letter=f"{a}{letter}{a}", word=f"{b}{word}{b}") + ("?" if rng.random() < 0.5 else "")
    lines, count = "", 0
    for i, c in enumerate(word, 1):
        count += c == letter
        lines += f"{i}:{c}" + (f" hit! count={count}" if c == letter else "") + "\n"
    return word, letter, count, asked, lines


@pytest.mark.parametrize("split", ["train", "test"])
def test_spelling(spark, words, split):
    table = spark.createDataFrame(list(enumerate(words)), "idx long, word string")
    at = spark.range(300).select(F.col("id").alias("index"))
    rows = K.spelling_conversations(at, table, split).collect()
    assert len(rows) == 300
    for r in rows:
        word, letter, count, asked, lines = asked_in_python(r["index"], words, 10_000_000 if split == "test" else 0)
        assert (r["word"], r["letter"], r["answer"], r["asked"]) == (word, letter, count, asked)
        kinds, texts = zip(*((p["type"], p["text"]) for p in r["parts"]), strict=True)
        assert kinds == ("text", "text", "python", "python_output", "text")
        assert f"\n{word}:{','.join(word)}\n" in texts[0] and texts[0].endswith(f"'{letter}':\n{lines}\nThis gives us {count}.")
        assert texts[2] == f"'{word}'.count('{letter}')" and texts[3] == str(count) and texts[4].endswith(f"#### {count}")


def test_words_to_spell(spark, sf_dir, words):
    order = list(words)
    random.Random(42).shuffle(order)
    for r in QUERIES["spelling_words"](spark, sf_dir).collect():
        word = random.Random(10_000_000 + r["index"]).choice(order)
        assert (r["word"], r["asked"], r["answered"]) == (word, f"Spell the word: {word}", f"{word}:{','.join(word)}")


def test_diversity(spark):
    topics, openers = {"a": ["x", "y"], "b": ["z"]}, {"p": ["1", "2"], "q": ["3"]}
    draw = D.diversity(topics, ["m", "n"], ["s", "t", "u"], openers)
    for r in spark.range(200).select("id", draw(F.col("id")).alias("d")).collect():
        rng = random.Random(r["id"])
        topic = rng.choice(topics[rng.choice(list(topics))])
        persona, dynamic = rng.choice(["m", "n"]), rng.choice(["s", "t", "u"])
        lines = [f"- {rng.choice(openers[k])}" for k in rng.sample(list(openers), 2)]
        assert tuple(r["d"]) == (topic, persona, dynamic, "\n".join(lines))


def test_draws_do_not_hang_on_partitions(spark):
    at = spark.range(1000).select(F.col("id").alias("i"), F.lit(1000).cast("long").alias("n"))
    a, b = (x.select("i", D.choice(3)("i", "n").alias("c")) for x in (at, at.repartition(7)))
    assert sorted(a.collect()) == sorted(b.collect())
    assert at.where("false").select(D.choice(3)("i", "n").alias("c")).collect() == []

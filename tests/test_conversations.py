"""Conversation files against plain Python: every line is read or set aside, and strict reading stops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from skein.sources import conversations as C


def rule_in_python(line, rule):
    """The first broken rule of a line, or None."""
    try:
        items = json.loads(line)
    except ValueError:
        return "not JSON"
    if not isinstance(items, list):
        return "not a list"
    lead = int(rule == "dialogue" and bool(items) and isinstance(items[0], dict) and items[0].get("role") == "system")
    if len(items) - lead < 2:
        return "fewer than two messages"
    if lead and not isinstance(items[0].get("content"), str):
        return "the system message has no text"
    for i, m in enumerate(items[lead:]):
        due = "user" if i % 2 == 0 else "assistant"
        if not isinstance(m, dict):
            return f"message {i} is no object"
        if "role" not in m:
            return f"message {i} has no role"
        if "content" not in m:
            return f"message {i} has no content"
        if m["role"] != due:
            return f"message {i} is not of the {due}"
        if not isinstance(m["content"], str):
            return f"message {i} has a content that is no text"
        if rule == "generated" and not m["content"].strip():
            return f"message {i} has a blank content"
    return None


def some_lines(n, seed):
    rng = random.Random(seed)
    u, a = {"role": "user", "content": "hi\né🌍"}, {"role": "assistant", "content": "yes"}
    bad = [{"role": "user"}, {"content": "x"}, {"role": "user", "content": 5}, {"role": "user", "content": None}, {"role": None, "content": "x"}, {"role": 3, "content": "x"}, {"role": "user", "content": ["x"]}, "text", 7, None, [], {"role": "user", "content": " \t"}, {"role": "system", "content": "be kind"}, {"role": "system", "content": 4}]
    out = []
    for _ in range(n):
        items = [dict(u), dict(a)] * rng.randint(0, 3) + ([dict(u)] if rng.random() < 0.2 else [])
        if rng.random() < 0.2:
            items.insert(0, {"role": "system", "content": "be kind"})
        if rng.random() < 0.4:
            items.insert(rng.randint(0, len(items)), rng.choice(bad))
        line = json.dumps(items, ensure_ascii=rng.random() < 0.5)
        out.append(rng.choice([line] * 9 + [line[:-1], "", "   ", "{}", '"text"', "5", "null", '{"role": "user"}']))
    return out


@pytest.mark.parametrize("rule", ["plain", "dialogue", "generated"])
def test_every_line_is_on_one_side(spark, tmp_path, rule):
    files = {f"{k}.jsonl": some_lines(n, k) for k, n in enumerate((400, 1, 57))}
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        good, bad = C.split_conversations(spark, str(tmp_path), rule)
        good, bad = good.collect(), bad.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {(r["file"].rsplit("/", 1)[1], r["line"]): [m.asDict() for m in r["messages"]] for r in good}
    aside = {(r["file"].rsplit("/", 1)[1], r["line"]): (r["value"], r["error"]) for r in bad}
    assert len(got) == len(good) and len(aside) == len(bad) and not got.keys() & aside.keys()
    want = {(name, k): (line, rule_in_python(line, rule)) for name, lines in files.items() for k, line in enumerate(lines, 1) if line.strip()}
    assert aside == {k: v for k, v in want.items() if v[1]}
    assert got == {k: json.loads(v[0]) for k, v in want.items() if not v[1]}


def test_strict_reading(spark, tmp_path):
    good = '[{"role":"user","content":"a"},{"role":"assistant","content":"b","more":1}]'
    (tmp_path / "c.jsonl").write_text(f"{good}\n\n{good}\n")
    rows = C.read_conversations(spark, str(tmp_path / "c.jsonl")).orderBy("line").collect()
    assert [r["line"] for r in rows] == [1, 3] and rows[0]["messages"][1].asDict() == {"role": "assistant", "content": "b"}
    (tmp_path / "c.jsonl").write_text(f'{good}\n[{{"role":"user","content":1}},{{"role":"assistant","content":"b"}}]\n')
    with pytest.raises(Exception, match="c.jsonl:2: message 0 has a content that is no text"):
        C.read_conversations(spark, str(tmp_path / "c.jsonl")).collect()


def test_files_that_are_not_there_or_empty(spark, tmp_path):
    with pytest.warns(UserWarning, match="does not exist"):
        assert C.read_conversations(spark, str(tmp_path / "none.jsonl")).collect() == []
    (tmp_path / "e.jsonl").write_text("")
    assert C.read_conversations(spark, str(tmp_path / "e.jsonl")).collect() == []


def test_long_lines(spark, tmp_path):
    line = json.dumps([{"role": "user", "content": "x" * 3_000_000}, {"role": "assistant", "content": "y"}])
    (tmp_path / "l.jsonl").write_text(line)
    assert C.read_conversations(spark, str(tmp_path / "l.jsonl")).select(F.length(F.col("messages")[0]["content"])).first()[0] == 3_000_000

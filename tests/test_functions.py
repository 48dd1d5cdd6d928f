"""Column functions against plain Python."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import text as X
from skein.functions import tokens as K


def one(spark, column, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(column.alias("x")).first()["x"]


def test_pretokens_lose_nothing(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert d.where(F.array_join(X.pretokens(F.col("text")), "") != F.col("text")).count() == 0


@pytest.mark.parametrize(("said", "answer"), [("so #### 1,234", "1234"), ("#### -5.5 ok", "-5.5"), ("none", None)])
def test_final_number(spark, said, answer):
    assert one(spark, X.final_number(F.col("a")), a=said) == answer


def parts(answer):
    out = []
    for p in re.split(r"(<<[^>]+>>)", answer):
        if p.startswith("<<") and p.endswith(">>"):
            inner = p[2:-2]
            left, right = inner.rsplit("=", 1) if "=" in inner else (inner, "")
            out += [("python", left), ("python_output", right)]
        else:
            out.append(("text", p))
    return out


@pytest.mark.parametrize("answer", ["a<<1+1=2>>b", "<<1=1>>b", "x <<a=b=c>> y <<7*2=14>> z", "plain"])
def test_tool_parts(spark, answer):
    assert [(r["type"], r["text"]) for r in one(spark, X.tool_parts(F.col("a")), a=answer)] == parts(answer)


def test_import_lines_and_code(spark):
    prompt = "# head\nimport os\n\nfrom a import b\ndef f():\n    import c\n"
    assert one(spark, X.import_lines(F.col("a")), a=prompt) == "import os\nfrom a import b"
    assert one(spark, X.code_block(F.col("a")), a="x\n```python\ny = 1\n```\nz") == "y = 1"
    assert one(spark, X.code_block(F.col("a")), a="  plain ") == "plain"


@pytest.mark.parametrize(("expr", "value"), [("1+2*3", "7"), ("(1,000-1)/3", "333.0"), ("'banana'.count('a')", "3"), ("2**9", None), ("__import__('os')", None), ("1/0", None), ("", None), (None, None), ("7//2", "3"), ("(-3)//2", "-2"), ("1,000//3", "333"), ("+5", "5"), (" 2 + 2", "4"), ("+".join(["1"] * 400), "400"), ("*".join(["99999"] * 5000), None), ("1e5", None), ("'a,b'.count('b')", "1")])
def test_calculator(expr, value):
    assert X.calculate(expr) == value


def test_prompts(spark):
    p = one(spark, X.multiple_choice(F.col("q"), F.array(F.lit("A"), F.lit("B")), F.array(F.lit("x"), F.lit("y"), F.lit("z"))), q="why")
    assert p == "Multiple Choice question: why\n- x=A\n- y=B\n\nRespond only with the letter of the correct answer."
    assert one(spark, X.lm_prompts(F.col("c"), F.lit("go"), " "), c=" a b\n") == ["a b", "a b go"]
    assert one(spark, X.schema_prompts(F.array(F.lit("u"), F.lit("v")), F.col("c"), ": "), c="w") == ["u: w", "v: w"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=6), st.lists(st.integers(0, 2), max_size=6))
def test_common_prefix(spark, a, b):
    arr = lambda v: F.array(*map(F.lit, v)).cast("array<int>")
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    assert spark.range(1).select(X.common_prefix(arr(a), arr(b))).first()[0] == n


def test_spans_and_targets(spark):
    s = spark.sql("SELECT 'hello' AS t, array(named_struct('s', 4, 'e', 9), named_struct('s', 3, 'e', 1)) AS p, array(5, 6, 7) AS i, array(0, 1, 0) AS m")
    r = s.select(X.clamp_spans(F.col("p"), F.col("t")).alias("c"), X.shift_targets(F.col("i"), F.col("m")).alias("s"), X.left_truncate(F.col("i"), 2).alias("l"), X.pad(F.col("i"), F.lit(5), F.lit(0)).alias("w")).first()
    assert [tuple(x) for x in r["c"]] == [(4, 5), (1, 3)]
    assert (r["s"], r["l"], r["w"]) == ([6, -1], [6, 7], [5, 6, 7, 0, 0])


def test_render(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "é")], "conv_id long, turn long, role string, text string")
    r = K.render(turns, K.byte_ids, K.BYTE_SPECIALS).first()
    sp = K.BYTE_SPECIALS
    text = list(b"s\n\nu")
    assert r["ids"] == [sp["<|bos|>"], sp["<|user_start|>"], *text, sp["<|user_end|>"], sp["<|assistant_start|>"], *"é".encode(), sp["<|assistant_end|>"]]
    assert r["mask"] == [0] * (len(text) + 4) + [1, 1, 1]


def test_conversations_of_over_100_000_turns(spark, tmp_path):
    from skein.plans.tokens import conversation_errors

    n = 100_004
    role = "CASE WHEN id = 0 THEN 'system' WHEN (id % 2 = 1) <> (conv_id = 1 AND id = 100003) THEN 'user' ELSE 'assistant' END"
    turns = spark.range(n).crossJoin(spark.range(1, 3).toDF("conv_id")).selectExpr("conv_id", "int(id) AS turn", f"{role} AS role", "'t' AS text")
    turns.write.parquet(str(tmp_path / "conversations.parquet"))
    assert {r["conv_id"]: r["error"] for r in conversation_errors(spark, str(tmp_path)).collect()} == {1: "roles do not alternate", 2: None}
    m = spark.range(1).selectExpr(f"transform(sequence(0, {n}), i -> struct(if(i = 0, 'system', 'user') AS role, 'x' AS content)) AS m")
    assert m.select(F.size(X.merge_system(F.col("m")))).first()[0] == n


def test_gate_kinds(spark):
    from skein.functions.tasks import gate_kind

    want = {"auto": ("auto", "0.05"), "auto0.1": ("auto", "0.1"), "auto::2": ("auto", "2.0"), "automatic": None, "donorp95": ("donor", "p95"), "donor:p42": None, "abs": None, "abs:1e-2": ("abs", "0.01"), "-1": None, "7": ("dial", "7.0"), "[1, 2]": ("vector", "[1, 2]"), "": None, None: None}
    rows = spark.createDataFrame([(k,) for k in want], "s string").select("s", gate_kind(F.col("s")).alias("g")).collect()
    assert {r["s"]: r["g"] and tuple(r["g"]) for r in rows} == want


def test_report_values_go_by_type(spark):
    from skein.functions.tasks import report_section, report_value

    rows = spark.createDataFrame([(3.0, 20000, "x", True), (20000.0, -20000, "", False), (float("nan"), 9999, "10000", None), (None, None, None, None)], "f double, i long, s string, b boolean")
    got = [tuple(r) for r in rows.select(*(report_value(rows, c).alias(c) for c in rows.columns)).collect()]
    assert got == [("3.0000", "20,000", "x", "True"), ("20000.0000", "-20000", "", "False"), ("nan", "9999", "10000", "None"), ("None", "None", "None", "None")]
    text = rows.limit(1).select(report_section(rows, F.lit("Stage"), F.lit("2024-05-06 07:08:09").cast("timestamp_ntz"), ["f", "i"], F.lit("note\n")).alias("t")).first()["t"]
    assert text == "## Stage\ntimestamp: 2024-05-06 07:08:09\n\nnote\n- f: 3.0000\n- i: 20,000\n\n"


def test_ids_and_texts_are_made_part_by_part():
    """Encoder and decoder have some texts of a batch at hand, not all; parts change no result."""
    import tracemalloc

    import public_tokenizers
    import pyarrow as pa

    from skein.functions import tokens as N

    path = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    enc, dec = N.encoder(*path).func, N.decoder(*path).func
    texts = pa.array([None, "", *["some words of a text. " * 2_500] * 100, "é🌍"])
    ids = enc(texts)
    assert [len(x) for x in ids.to_pylist()[:2]] == [0, 0] and ids[2] == ids[101] and ids[102] == enc(texts[102:])[0]
    tracemalloc.start()
    found = dec(ids)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.to_pylist() == ["", *texts.to_pylist()[1:]] and most < 3e6
    assert len(enc(texts[:0])) == len(dec(ids[:0])) == 0 and dec(pa.array([None], pa.list_(pa.int32()))).to_pylist() == [None]

"""Token tables, prompts, conversations and packing as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import tokens as K
from ..operators import packing as P
from ..session import shared_folder
from ..sources import conversations as C
from ..sources import tables as S
from .registry import query


def _vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("pretoken_counts")
def pretoken_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each piece occurs; pieces put together give back every text."""
    pieces = S.table(spark, d, "documents").select(F.explode(X.pretokens(F.col("text"))).alias("piece"))
    return pieces.groupBy("piece").agg(F.count("*").alias("n"))


@query("encode_round_trip")
def encode_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path, pattern = _vocabulary()
    enc, dec = K.encoder(path, pattern, prepend="<|bos|>"), K.decoder(path, pattern)
    ids = S.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("ids", enc(F.col("text")))
    return ids.select("doc_id", F.size("ids").alias("n_tokens"), F.try_divide(F.octet_length("text"), F.size("ids") - 1).alias("ratio"), (dec(F.slice("ids", 2, 1 << 30)) == F.col("text")).alias("same"))


@query("compression_by_lang")
def compression_by_lang(spark: SparkSession, d: str) -> DataFrame:
    """UTF-8 bytes a token of two vocabularies by language, and the relative difference."""
    import public_tokenizers

    path, pattern = _vocabulary()
    count = K.counter([path, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")], pattern)
    n = S.table(spark, d, "documents").select("lang", F.octet_length("text").alias("bytes"), count(F.col("text")).alias("n"))
    s = n.groupBy("lang").agg(F.try_divide(F.sum("bytes"), F.sum(F.col("n")[0])).alias("ratio_a"), F.try_divide(F.sum("bytes"), F.sum(F.col("n")[1])).alias("ratio_b"))
    return s.withColumn("diff_percent", (F.col("ratio_a") - F.col("ratio_b")) / F.col("ratio_b") * 100).withColumn("better", F.when(F.col("ratio_a") > F.col("ratio_b"), "a").otherwise("b"))


@query("special_tokens", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 257 WHEN 'assistant' THEN 259 END::INT AS begins, CASE role WHEN 'user' THEN 258 WHEN 'assistant' THEN 260 END::INT AS ends FROM conversations")
def special_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The ids of the marks around each turn, none around a system turn."""
    names = K.special_ids(spark, 256)
    turns = S.table(spark, d, "conversations").select("conv_id", "turn", "role")
    for column, mark in (("begins", "_start"), ("ends", "_end")):
        known = names.select(F.regexp_extract("name", rf"<\|(\w+){mark}\|>", 1).alias("role"), F.col("token_id").alias(column)).where("role <> ''")
        turns = turns.join(F.broadcast(known), "role", "left")  # nine names
    return turns.select("conv_id", "turn", "begins", "ends")


@query(
    "visualized_tokens",
    r"""WITH b AS (SELECT item_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::INT) AS ids FROM benchmark)
    SELECT item_id, array_to_string(list_transform(range(1, len(ids) + 1), lambda i: chr(27) || CASE WHEN i % 3 = 0 THEN '[92m' ELSE '[91m' END || ids[i]::VARCHAR || chr(27) || '[0m'), '|') AS shown FROM b""",
)
def visualized_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Byte tokens coloured by a mask that trains on every third."""
    b = S.table(spark, d, "benchmark").select("item_id", K.byte_ids("text").alias("ids"))
    mask = F.transform("ids", lambda _, i: F.when(i % 3 == 2, 1).otherwise(0))
    return b.select("item_id", K.visualized(F.col("ids"), mask).alias("shown"))


@query(
    "transcript_ids",
    """SELECT conv_id, (sum(strlen(text) + 2) + 2)::INT AS n_tokens, 259 AS last FROM conversations WHERE role <> 'system' GROUP BY conv_id""",
)
def transcript_ids(spark: SparkSession, d: str) -> DataFrame:
    """Chats without system turns as ids that end on the mark that begins a reply."""
    turns = S.table(spark, d, "conversations").where("role <> 'system'")
    r = K.render(turns, K.byte_ids, K.BYTE_SPECIALS, max_tokens=1 << 30)
    ids = F.concat("ids", F.array(F.lit(K.BYTE_SPECIALS["<|assistant_start|>"])))
    return r.select("conv_id", F.size(ids).alias("n_tokens"), F.element_at(ids, -1).alias("last"))


@query(
    "request_errors",
    """SELECT conv_id, CASE WHEN count(*) > 500 THEN 'too many messages' WHEN count(*) FILTER (text = '') > 0 THEN 'empty text' WHEN max(length(text)) > 8000 THEN 'a message is too long' WHEN sum(length(text)) > 32000 THEN 'the conversation is too long'
      WHEN count(*) FILTER (role NOT IN ('user', 'assistant')) > 0 THEN 'unknown role' WHEN conv_id % 5 = 0 THEN 'temperature out of range' WHEN conv_id % 5 = 1 THEN 'top_k out of range' WHEN conv_id % 5 = 2 THEN 'max_tokens out of range' END AS request,
      CASE WHEN count(*) < 2 THEN 'fewer than two messages' WHEN count(*) FILTER (trim(text) = '') > 0 THEN 'empty text' END AS blank FROM conversations GROUP BY conv_id""",
)
def request_errors(spark: SparkSession, d: str) -> DataFrame:
    """The rules that chats break as requests and as generated data; a chat is one row's list here, as it is in a request."""
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    c = S.table(spark, d, "conversations").groupBy("conv_id").agg(m.alias("m"))
    k = F.col("conv_id") % 5
    pick = lambda bad, n, good: F.when(k == n, bad).otherwise(good)
    error = X.request_error(F.col("m"), pick(F.lit(2.5), 0, F.lit(1.0)), pick(F.lit(201), 1, F.lit(None).cast("int")), pick(F.lit(0), 2, F.lit(64)))
    return c.select("conv_id", error.alias("request"), X.blank_error(F.col("m")).alias("blank"))


@query(
    "quarantined_lines",
    """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, first(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'system' AS sys FROM conversations),
    m AS (SELECT conv_id, i - sys::INT AS k, role, CASE WHEN (i - sys::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END AS due FROM c),
    e AS (SELECT conv_id, count(*) FILTER (k >= 0) AS n, min(k) FILTER (k >= 0 AND role <> due) AS k0 FROM m GROUP BY conv_id)
    SELECT CASE WHEN conv_id % 11 = 0 THEN 'not JSON' WHEN n < 2 THEN 'fewer than two messages' WHEN k0 IS NOT NULL THEN 'message ' || k0 || ' is not of the ' || CASE WHEN k0 % 2 = 0 THEN 'user' ELSE 'assistant' END ELSE 'none' END AS error, count(*) AS lines FROM e GROUP BY 1""",
)
def quarantined_lines(spark: SparkSession, d: str) -> DataFrame:
    """Conversations written as lines of a file, every eleventh cut off in the middle, and read back: lines by the rule that sets them aside, or by none."""
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"))))  # one conversation, which is one line
    c = S.table(spark, d, "conversations").groupBy("conv_id").agg(m.alias("m"))
    line = F.to_json(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))))
    cut = F.when(F.col("conv_id") % 11 == 0, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    c.select(cut.alias("value")).write.text(path)
    good, bad = C.split_conversations(spark, path, "dialogue")
    return good.select(F.lit("none").alias("error")).union(bad.select("error")).groupBy("error").agg(F.count("*").alias("lines"))


@query("token_byte_stats", "SELECT item_id, strlen(text)::BIGINT AS n_bytes FROM benchmark WHERE length(text) > 0")
def token_byte_stats(spark: SparkSession, d: str) -> DataFrame:
    """The bytes of each item's tokens, joined from the table of token lengths: as many as its text has."""
    lengths = K.byte_lengths(spark, *_vocabulary()).withColumnRenamed("n_bytes", "b")  # a row a token of the vocabulary
    ids = S.table(spark, d, "benchmark").select("item_id", F.explode(K.encoder(*_vocabulary())(F.col("text"))).alias("token_id"))
    return ids.join(lengths, "token_id").groupBy("item_id").agg(F.sum("b").alias("n_bytes"))


_CONV = "c AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nxt, lag(role) OVER w AS prev, lag(text) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"


@query(
    "conversation_errors",
    """WITH c AS (SELECT *, min(role) FILTER (turn = 0) OVER (PARTITION BY conv_id) = 'system' AS sys,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
    SELECT conv_id, CASE WHEN count(*) FILTER (NOT (sys AND i = 0)) < 2 THEN 'fewer than two turns'
      WHEN count(*) FILTER (NOT (sys AND i = 0) AND role <> CASE WHEN (i - sys::INT) % 2 = 0 THEN 'user' ELSE 'assistant' END) > 0 THEN 'roles do not alternate'
      WHEN count(*) FILTER (trim(text) = '') > 0 THEN 'empty text' END AS error
    FROM c GROUP BY conv_id""",
)
def conversation_errors(spark: SparkSession, d: str) -> DataFrame:
    """The first rule each conversation breaks, from counts over its turns; no conversation is collected."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = S.table(spark, d, "conversations").withColumn("i", F.row_number().over(order) - 1).withColumn("sys", F.coalesce(F.first("role").over(order) == "system", F.lit(False)))
    rest = ~(F.col("sys") & (F.col("i") == 0))
    due = F.when((F.col("i") - F.col("sys").cast("int")) % 2 == 0, "user").otherwise("assistant")
    blank = F.coalesce(X.strip(F.col("text")), F.lit("")) == ""
    found = turns.groupBy("conv_id").agg(F.count_if(rest).alias("n"), F.count_if(rest & (F.col("role") != due)).alias("wrong"), F.count_if(blank).alias("blank"))
    return found.select("conv_id", F.when(F.col("n") < 2, "fewer than two turns").when(F.col("wrong") > 0, "roles do not alternate").when(F.col("blank") > 0, "empty text").alias("error"))


def _alternating(spark: SparkSession, d: str) -> DataFrame:
    """The turns of conversations in which user and assistant take turns."""
    turns = S.table(spark, d, "conversations")
    prev = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    wrong = ((F.col("role") == "user") & (F.col("prev") == "user")) | ((F.col("role") == "assistant") & F.coalesce(F.col("prev") != "user", F.lit(True)))
    bad = turns.withColumn("prev", prev).where(wrong).select("conv_id").distinct()
    return turns.join(bad, "conv_id", "left_anti")


_RENDER = f"""WITH {_CONV}, ok AS (SELECT conv_id FROM c GROUP BY conv_id HAVING count(*) FILTER (role = 'user' AND prev = 'user') = 0 AND count(*) FILTER (role = 'assistant' AND (prev IS NULL OR prev <> 'user')) = 0),
    t AS (SELECT conv_id, role, strlen(text) + CASE WHEN prev = 'system' THEN strlen(before) + 2 ELSE 0 END + 2 AS n FROM c WHERE role <> 'system' AND conv_id IN (SELECT conv_id FROM ok))"""


@query("rendered_lengths", f"{_RENDER} SELECT conv_id, (sum(n) + 1)::INT AS n_tokens, coalesce(sum(n - 1) FILTER (role = 'assistant'), 0)::INT AS n_trained FROM t GROUP BY conv_id")
def rendered_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and trained tokens of conversations in the byte vocabulary."""
    r = K.render(_alternating(spark, d), K.byte_ids, K.BYTE_SPECIALS, max_tokens=1 << 30)
    return r.select("conv_id", F.size("ids").alias("n_tokens"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("n_trained"))


@query(
    "shifted_targets",
    rf"""WITH {_CONV}, ok AS (SELECT conv_id FROM c GROUP BY conv_id HAVING count(*) FILTER (role = 'user' AND prev = 'user') = 0 AND count(*) FILTER (role = 'assistant' AND (prev IS NULL OR prev <> 'user')) = 0),
    t AS (SELECT conv_id, turn, role = 'user' AS u, list_transform(regexp_extract_all(hex(encode(CASE WHEN prev = 'system' THEN before || chr(10) || chr(10) || text ELSE text END)), '..'), lambda h: ('0x' || h)::INT) AS b FROM c WHERE role <> 'system' AND conv_id IN (SELECT conv_id FROM ok)),
    s AS (SELECT conv_id, turn, list_concat([CASE WHEN u THEN 257 ELSE 259 END], b, [CASE WHEN u THEN 258 ELSE 260 END]) AS ids, list_concat([0], list_transform(range(len(b) + 1), lambda i: CASE WHEN u THEN 0 ELSE 1 END)) AS mask FROM t),
    w AS (SELECT conv_id, list_concat([256], flatten(list(ids ORDER BY turn)))[1:2048] AS ids, list_concat([0], flatten(list(mask ORDER BY turn)))[1:2048] AS mask FROM s GROUP BY conv_id)
    SELECT conv_id, ids[1:len(ids) - 1] AS inputs, list_transform(range(2, len(ids) + 1), lambda i: CASE WHEN mask[i] = 1 THEN ids[i] ELSE -1 END) AS targets FROM w""",
)
def shifted_targets(spark: SparkSession, d: str) -> DataFrame:
    """Inputs and targets of rendered conversations whose turns alternate, -1 where not trained on."""
    r = K.render(_alternating(spark, d), K.byte_ids, K.BYTE_SPECIALS)
    return r.select("conv_id", F.slice("ids", 1, F.size("ids") - 1).alias("inputs"), X.shift_targets(F.col("ids"), F.col("mask")).alias("targets"))


#: The last words of an item are its choices or continuation, all before them the question.
_ITEMS = "b AS (SELECT item_id, string_split(text, ' ') AS w, len(string_split(text, ' ')) AS n FROM benchmark)"


def _items(spark: SparkSession, d: str, tail: int) -> DataFrame:
    """item_id, q (all but the last ``tail`` words) and t (these)."""
    w = F.split("text", " ")
    n = F.greatest(F.size(w) - tail, F.lit(0))
    return S.table(spark, d, "benchmark").select("item_id", F.array_join(F.slice(w, F.lit(1), n), " ").alias("q"), F.slice(w, n + 1, F.lit(tail)).alias("t"))


@query(
    "multiple_choice_prompts",
    rf"""WITH {_ITEMS}
    SELECT item_id, 'Multiple Choice question: ' || array_to_string(w[1:n - 3], ' ') || chr(10) || '- ' || w[n - 2] || '=A' || chr(10) || '- ' || w[n - 1] || '=B' || chr(10) || '- ' || w[n] || '=C' || chr(10)
      || chr(10) || 'Respond only with the letter of the correct answer.' AS prompt FROM b""",
)
def multiple_choice_prompts(spark: SparkSession, d: str) -> DataFrame:
    letters = F.array(*map(F.lit, "ABC"))
    return _items(spark, d, 3).select("item_id", X.multiple_choice(F.col("q"), letters, F.col("t")).alias("prompt"))


@query(
    "choice_prompts_few_shot",
    rf"""WITH {_ITEMS}, shots AS (SELECT item_id, array_to_string(w[1:n - 2], ' ') || ' => ' || w[n - 1] || chr(10) || chr(10) AS s FROM b),
    f AS (SELECT b.*, coalesce((SELECT min_by(s, item_id) FROM shots WHERE shots.item_id <> b.item_id), '') AS s FROM b)
    SELECT item_id, unnest([0, 1])::INT AS choice, unnest([s || array_to_string(w[1:n - 2], ' ') || ' => ' || w[n - 1], s || array_to_string(w[1:n - 2], ' ') || ' => ' || w[n]]) AS prompt FROM f""",
)
def choice_prompts_few_shot(spark: SparkSession, d: str) -> DataFrame:
    """One solved example, the first that is not the item itself, before each prompt; an only item has none."""
    b = _items(spark, d, 2)
    two = [(r["item_id"], r["q"], r["t"][0]) for r in b.orderBy("item_id").limit(2).collect()]
    said = [(F.lit(i).cast(b.schema["item_id"].dataType), F.array(F.lit(f"{q} => {t}"))) for i, q, t in two]
    shots = F.array().cast("array<string>")
    for i, s in reversed(said):
        shots = F.when(F.col("item_id") != i, s).otherwise(shots)
    return b.select("item_id", F.posexplode(X.choice_prompts(F.col("q"), F.col("t"), " => ", shots)).alias("choice", "prompt"))


@query(
    "lm_prompts",
    rf"""WITH {_ITEMS}
    SELECT item_id, trim(array_to_string(w[1:n - 1], ' ')) AS without, trim(array_to_string(w[1:n - 1], ' ')) || ' ' || w[n] AS with_ FROM b""",
)
def lm_prompts(spark: SparkSession, d: str) -> DataFrame:
    p = X.lm_prompts(F.concat(F.lit(" "), F.col("q"), F.lit("\t")), F.col("t")[0], " ")
    return _items(spark, d, 1).select("item_id", p.alias("p")).select("item_id", F.col("p")[0].alias("without"), F.col("p")[1].alias("with_"))


@query(
    "schema_prompts",
    rf"""WITH {_ITEMS} SELECT item_id, unnest([0, 1])::INT AS choice, unnest([array_to_string(w[1:n - 2], ' ') || ' -> ' || w[n], w[n - 1] || ' -> ' || w[n]]) AS prompt FROM b""",
)
def schema_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Two contexts before one continuation."""
    t = F.col("t")
    return _items(spark, d, 2).select("item_id", F.posexplode(X.schema_prompts(F.array(F.col("q"), F.get(t, F.lit(0))), F.coalesce(F.element_at(t, -1), F.lit("")), " -> ")).alias("choice", "prompt"))


@query(
    "padded_items",
    rf"""WITH {_ITEMS} SELECT item_id, array_to_string(w, ' ') || repeat(' _', greatest(40 - n, 0)::BIGINT) AS padded, greatest(n, 40)::INT AS size FROM b""",
)
def padded_items(spark: SparkSession, d: str) -> DataFrame:
    w = F.split("text", " ")
    p = X.pad(w, F.greatest(F.size(w), F.lit(40)), F.lit("_"))
    return S.table(spark, d, "benchmark").select("item_id", F.array_join(p, " ").alias("padded"), F.size(p).alias("size"))


@query(
    "common_suffix_words",
    rf"""WITH {_ITEMS}, v AS (SELECT *, list_reverse(w) AS r, list_reverse(string_split(regexp_replace((SELECT text FROM benchmark o WHERE o.item_id = b.item_id), '^[^ ]* ', 'other '), ' ')) AS o FROM b)
    SELECT item_id, coalesce(list_position(list_transform(generate_series(1, least(len(r), len(o))), lambda i: r[i] = o[i]), false) - 1, least(len(r), len(o)))::INT AS n FROM v""",
)
def common_suffix_words(spark: SparkSession, d: str) -> DataFrame:
    """Words that an item shares at its end with itself under another first word."""
    other = F.split(F.regexp_replace("text", "^[^ ]* ", "other "), " ")
    return S.table(spark, d, "benchmark").select("item_id", X.common_suffix(F.split("text", " "), other).alias("n"))


@query(
    "common_prefix_words",
    r"""WITH b AS (SELECT doc_id, string_split(text, ' ') AS w, string_split(lead(text) OVER (ORDER BY text, doc_id), ' ') AS v FROM documents)
    SELECT doc_id, CASE WHEN v IS NULL THEN NULL ELSE coalesce(list_position(list_transform(generate_series(1, least(len(w), len(v))), lambda i: w[i] = v[i]), false) - 1, least(len(w), len(v)))::INT END AS n FROM b""",
)
def common_prefix_words(spark: SparkSession, d: str) -> DataFrame:
    """Words that a text shares at its head with the next text in order; null for the last."""
    return S.shared_with_next(S.table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")


@query("final_numbers", r"SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE replace(format('{:,}', o_orderkey), ',', '') END AS answer FROM orders")
def final_numbers(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    said = F.when(key % 7 == 0, F.lit("no answer")).otherwise(F.concat(F.lit("It is\n#### "), F.format_number(key, 0), F.lit(" dollars")))
    return S.table(spark, d, "orders").select("o_orderkey", X.final_number(said).alias("answer"))


@query("tool_call_parts", r"""SELECT o_orderkey, i::INT AS pos, ['text', 'python', 'python_output', 'text'][i + 1] AS type,
    [ 'so ', o_orderkey || '*2=' || o_custkey, (o_orderkey * 2)::VARCHAR, ' it is'][i + 1] AS text FROM orders CROSS JOIN generate_series(0, 3) g(i)""")
def tool_call_parts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    answer = F.concat(F.lit("so <<"), k, F.lit("*2="), F.col("o_custkey"), F.lit("="), (k * 2).cast("string"), F.lit(">> it is"))
    parts = S.table(spark, d, "orders").select("o_orderkey", F.posexplode(X.tool_parts(answer)).alias("pos", "p"))
    return parts.select("o_orderkey", "pos", "p.type", "p.text")


@query("calculator", "SELECT o_orderkey, (o_orderkey * 3 + o_custkey)::VARCHAR AS result FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 2 = 1")
def calculator(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    expr = F.when(k % 2 == 0, F.concat(k, F.lit("*3+"), F.col("o_custkey"))).otherwise(F.concat(F.lit("__import__('os')."), k))
    return S.table(spark, d, "orders").select("o_orderkey", X.calculator(expr).alias("result"))


@query(
    "cut_pieces",
    """WITH p AS (SELECT doc_id, text, length(text) AS n FROM documents), m AS (SELECT doc_id, text, list_sort(list_distinct(list_filter([0, 3, 7, n], lambda x: x <= n))) AS m FROM p)
    SELECT doc_id, (i - 1)::INT AS pos, substr(text, m[i] + 1, m[i + 1] - m[i]) AS piece FROM m CROSS JOIN LATERAL (SELECT unnest(generate_series(1, len(m) - 1)) AS i)""",
)
def cut_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every text cut at characters 3 and 7, where it has them."""
    docs = S.table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(X.cut_at(F.col("text"), F.array(F.lit(7), F.lit(3), F.lit(3), F.lit(0)))).alias("pos", "piece"))


@query(
    "clamped_spans",
    "SELECT doc_id, least(least(n, 500), least(n, 100))::INT AS s, greatest(least(n, 500), least(n, 100))::INT AS e FROM (SELECT doc_id, length(text) AS n FROM documents)",
)
def clamped_spans(spark: SparkSession, d: str) -> DataFrame:
    """An inverted span that may lie beyond its text."""
    span = F.array(F.struct(F.lit(500).alias("s"), F.lit(100).alias("e")))
    c = S.table(spark, d, "documents").select("doc_id", X.clamp_spans(span, F.col("text"))[0].alias("c"))
    return c.select("doc_id", "c.s", "c.e")


@query(
    "code_completions",
    r"""SELECT item_id, regexp_extract(text, '[A-Za-z]+') AS code, 'import ' || regexp_extract(text, '[A-Za-z]+') AS imports FROM benchmark""",
)
def code_completions(spark: SparkSession, d: str) -> DataFrame:
    """The code of fenced completions, and the import lines at a prompt's head."""
    word = F.regexp_extract("text", "([A-Za-z]+)", 1)
    said = F.concat(F.lit("Sure:\n```python\n"), word, F.lit("\n```\nand "), F.col("text"))
    prompt = F.concat(F.lit("# head\n\nimport "), word, F.lit("\ndef f():\n    import os"))
    return S.table(spark, d, "benchmark").select("item_id", X.code_block(said).alias("code"), X.import_lines(prompt).alias("imports"))


@query("test_programs", "SELECT item_id, 'import ' || w || chr(10) || chr(10) || w || chr(10) || chr(10) || 'def check(f): pass' || chr(10) || 'check(f' || item_id || ')' AS program FROM (SELECT item_id, regexp_extract(text, '[A-Za-z]+') AS w FROM benchmark)")
def test_programs(spark: SparkSession, d: str) -> DataFrame:
    """Programs put together from a prompt, a fenced completion and a test; they are not run."""
    word = F.regexp_extract("text", "([A-Za-z]+)", 1)
    said = F.concat(F.lit("```python\n"), word, F.lit("\n```"))
    made = X.program(F.concat(F.lit("import "), word, F.lit("\nx = 1")), said, F.lit("def check(f): pass"), F.concat(F.lit("f"), F.col("item_id").cast("string")))
    return S.table(spark, d, "benchmark").select("item_id", made.alias("program"))


@query(
    "compact_tokens",
    """SELECT doc_id, strlen(text)::INT AS n, len(list_distinct(list_filter([0, 3, 7, length(text)], lambda x: x <= length(text)))) - 1 AS pieces FROM documents""",
)
def compact_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut at another tokenizer's boundaries, each piece encoded alone, the ids put together."""
    pieces = X.cut_at(F.coalesce("text", F.lit("")), F.array(F.lit(3), F.lit(7)))
    ids = S.table(spark, d, "documents").select("doc_id", K.encoded_lists(K.byte_ids)(pieces).alias("ids"), F.size(pieces).alias("pieces"))
    return ids.select("doc_id", F.size("ids").alias("n"), F.col("pieces").cast("long").alias("pieces"))


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents").select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("int").alias("n"))
    return P.ranks(docs.withColumn("ord", F.col("doc_id")), "ord", row_group=16)


@query("pack_crop")
def pack_crop(spark: SparkSession, d: str) -> DataFrame:
    """Best-fit rows of 2048 with cropping: where each document went."""
    return P.packed(_ranked(spark, d), 2048, 1000, "crop")


@query("pack_pad")
def pack_pad(spark: SparkSession, d: str) -> DataFrame:
    """Best-fit rows of 2048 with padding: every document has a place, those above 2048 their first part."""
    return P.packed(_ranked(spark, d), 2048, 100, "pad")


@query("pack_from_sql")
def pack_from_sql(spark: SparkSession, d: str) -> DataFrame:
    """The rows of ``pack_crop``, asked for in SQL."""
    P.register_packers(spark)
    text = "SELECT * FROM pack_rows(TABLE({docs}) PARTITION BY rank ORDER BY (ord, doc_id, n), capacity => 2048, buffer_size => 1000, mode => 'crop')"
    return spark.sql(text, docs=_ranked(spark, d))


@query(
    "pack_pad_totals",
    """WITH d AS (SELECT ((doc_id // 16) % greatest(8, ceil((SELECT count(*) FROM documents) / 65536.0)))::INT AS rank, strlen(coalesce(text, '')) + 1 AS n FROM documents)
    SELECT rank, count(*) AS documents, sum(n)::BIGINT AS tokens, sum(least(n, 2048))::BIGINT AS used, count(*) FILTER (n > 2048) AS n_truncated FROM d GROUP BY rank""",
)
def pack_pad_totals(spark: SparkSession, d: str) -> DataFrame:
    """What each rank's padded rows hold: no document is missing, and those above 2048 tokens are counted."""
    places = P.packed(_ranked(spark, d), 2048, 100, "pad")
    return places.groupBy("rank").agg(F.count("*").alias("documents"), F.sum("n").alias("tokens"), F.sum("used").alias("used"), F.count_if(F.col("used") < F.col("n")).alias("n_truncated"))


@query("pack_accounting")
def pack_accounting(spark: SparkSession, d: str) -> DataFrame:
    docs = _ranked(spark, d)
    out = None
    for mode, size in (("crop", 1000), ("pad", 100)):
        a = P.accounting(P.packed(docs, 2048, size, mode), docs, 2048).withColumn("mode", F.lit(mode))
        out = a if out is None else out.unionByName(a)
    return out


@query("padded_rows")
def padded_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the pad packer as ids and targets: padded with the start token, which is not trained on, and what was consumed by then."""
    docs = S.placed(S.table(spark, d, "documents")).select(F.col("place").alias("doc_id"), K.byte_ids(F.coalesce("text", F.lit(""))).alias("ids"), F.col("doc_id").alias("ord"))
    sized = P.ranks(docs.select("doc_id", "ord", F.size("ids").alias("n")), "ord", row_group=16)
    rows = P.padded(P.packed(sized, 1024, 100, "pad"), docs, 1024, K.BYTE_SPECIALS["<|bos|>"])
    return rows.select("rank", "row", "consumed", F.size("ids").alias("n"), F.size(F.filter("targets", lambda t: t == -1)).alias("ignored"))


@query(
    "length_batches",
    """WITH RECURSIVE d AS (SELECT doc_id, length(text)::BIGINT AS n, ((doc_id // 16) % greatest(8, ceil((SELECT count(*) FROM documents) / 65536.0)))::INT AS rank FROM documents),
    o AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY n, doc_id) AS i FROM d),
    r AS (SELECT doc_id, n, rank, i, 0::BIGINT AS batch, 1::BIGINT AS held FROM o WHERE i = 1
      UNION ALL SELECT o.doc_id, o.n, o.rank, o.i, CASE WHEN (r.held + 1) * o.n > 32768 THEN r.batch + 1 ELSE r.batch END, CASE WHEN (r.held + 1) * o.n > 32768 THEN 1 ELSE r.held + 1 END FROM r JOIN o ON o.rank = r.rank AND o.i = r.i + 1)
    SELECT doc_id, n, rank, batch FROM r""",
)
def length_batches(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    return P.length_batches(P.ranks(docs, "doc_id", row_group=16), 32768, "rank")


@query("windows_of_tokens", "SELECT doc_id, (i // 256)::INT AS part, i::INT AS start, least(256, strlen(text) - i)::INT AS n FROM documents CROSS JOIN LATERAL (SELECT unnest(generate_series(0, strlen(text) - 1, 256)) AS i)")
def windows_of_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Windows of at most 256 byte tokens."""
    docs = S.table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("len")).where("len > 0")
    w = docs.select("doc_id", "len", F.posexplode(F.sequence(F.lit(0), F.col("len") - 1, F.lit(256))).alias("part", "start"))
    return w.select("doc_id", "part", "start", F.least(F.lit(256), F.col("len") - F.col("start")).alias("n"))

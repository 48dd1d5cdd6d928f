"""Tasks, grading, scores over tasks and report values as queries; benchmark items stand for task rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import draws as D
from ..functions import tasks as K
from ..functions import text as X
from ..operators import joins as J
from ..operators import metrics as M
from ..sources import tables as S
from .registry import query

#: An item's last three words as choices, all before them as the question.
_ITEMS = "b AS (SELECT item_id, string_split(text, ' ') AS w, len(string_split(text, ' ')) AS n FROM benchmark)"


def _items(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    return S.table(spark, d, "benchmark").select("item_id", F.split("text", " ").alias("w")), F.col("w")


def _head(w: Column, tail: int) -> Column:
    return F.slice(w, 1, F.greatest(F.size(w) - tail, F.lit(0)))


@query(
    "task_conversations",
    f"""WITH {_ITEMS} SELECT item_id, md5('42:' || item_id) AS order_key,
      'Multiple Choice question: ' || array_to_string(w[1:n - 3], ' ') || chr(10) || '- ' || w[n - 2] || '=A' || chr(10) || '- ' || w[n - 1] || '=B' || chr(10) || '- ' || w[n] || '=C' || chr(10)
      || chr(10) || 'Respond only with the letter of the correct answer.' AS asked, ['A', 'B', 'C'][item_id % 3 + 1] AS answered FROM b WHERE n > 3""",
)
def task_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Task rows as conversations, in a seeded order."""
    rows, w = _items(spark, d)
    letters = F.array(*map(F.lit, "ABC"))
    talk = K.choice_conversation(F.array_join(_head(w, 3), " "), letters, F.slice(w, -3, 3), F.col("item_id") % 3)
    task = K.Task(rows.where(F.size("w") > 3), talk, lambda a: K.same_letter(a, F.col("messages")[1]["content"], letters), "categorical", letters)
    key = F.md5(F.concat(F.lit("42:"), F.col("item_id").cast("string")).cast("binary"))
    m = F.col("messages")
    return task.conversations().select("item_id", key.alias("order_key"), m[0]["content"].alias("asked"), m[1]["content"].alias("answered"))


@query("numeric_grades", "SELECT o_orderkey, (CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey + o_custkey % 2 END) IS NOT DISTINCT FROM (CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey END) AS correct, CASE WHEN (CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey + o_custkey % 2 END) IS NOT DISTINCT FROM (CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey END) THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM orders")
def numeric_grades(spark: SparkSession, d: str) -> DataFrame:
    """Final numbers of a completion and its reference; no number on both sides counts as right."""
    k = F.col("o_orderkey")
    said = F.when(k % 5 == 0, F.lit("none")).otherwise(F.concat(F.lit("so\n#### "), F.format_number(k + F.col("o_custkey") % 2, 0)))
    right = F.when(k % 10 == 0, F.lit("none")).otherwise(F.concat(F.lit("#### "), k))
    rows = S.table(spark, d, "orders").select("o_orderkey", said.alias("said"), right.alias("reference"))
    task = K.Task(rows, K.question_and_answer(F.lit("?"), F.col("reference")), lambda a: K.same_number(a, F.col("reference")), "generative")
    return task.graded("said").select("o_orderkey", "correct", "reward")


@query("letter_grades", "SELECT item_id, (item_id % 4) = (item_id % 3) AS correct FROM benchmark")
def letter_grades(spark: SparkSession, d: str) -> DataFrame:
    letters = F.array(*map(F.lit, "ABCD"))
    at = lambda m: F.element_at(letters, (F.col("item_id") % m).cast("int") + 1)
    return S.table(spark, d, "benchmark").select("item_id", K.same_letter(at(4), at(3), letters).alias("correct"))


@query("allowed_argmax", "SELECT vec_id, arg_max(i, (x, -i))::INT AS picked FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS x FROM embeddings) WHERE i % 3 = 1 GROUP BY vec_id")
def allowed_argmax(spark: SparkSession, d: str) -> DataFrame:
    """The allowed channel with the largest logit; of ties the first."""
    x = S.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).where("i % 3 = 1")
    return x.groupBy("vec_id").agg(M.first_max("i", F.col("x"), -F.col("i")).alias("picked"))


@query("first_minimum", "SELECT l_orderkey, arg_min(l_linenumber, (l_quantity, l_linenumber)) AS picked FROM lineitem GROUP BY l_orderkey")
def first_minimum(spark: SparkSession, d: str) -> DataFrame:
    """The option with the least mean loss; of ties the first."""
    return S.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct("l_quantity", "l_linenumber")).alias("picked"))


@query(
    "answer_spans",
    f"""WITH {_ITEMS} SELECT item_id, greatest(n - 1, 0)::INT AS mc_start, n::INT AS mc_end, 1::INT AS schema_start, n::INT AS schema_end, greatest(n - 2, 0)::INT AS lm_start, n::INT AS lm_end FROM b""",
)
def answer_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of the answer tokens: behind a shared head, before a shared tail, behind the prompt."""
    rows, w = _items(spark, d)
    other = lambda i, word: F.transform(w, lambda x, k: F.when(k == i, F.concat(x, F.lit(word))).otherwise(x))
    heads = F.array(w, other(F.size(w) - 1, "~1"), other(F.size(w) - 1, "~2"))
    tails = F.array(w, other(F.lit(0), "~1"))
    mc, schema, lm = K.spans_after_prefix(heads)[1], K.spans_before_suffix(tails)[1], K.span_of_continuation(_head(w, 2), w)
    out = rows.select("item_id", mc.alias("m"), schema.alias("s"), lm.alias("l"))
    return out.select("item_id", F.col("m.s").alias("mc_start"), F.col("m.e").alias("mc_end"), F.col("s.s").alias("schema_start"), F.col("s.e").alias("schema_end"), F.col("l.s").alias("lm_start"), F.col("l.e").alias("lm_end"))


@query("truncated_spans", f"WITH {_ITEMS} SELECT item_id, least(n, 12)::INT AS n, (greatest(n - 2, 0) - greatest(n - 12, 0))::INT AS s, (n - greatest(n - 12, 0))::INT AS e, array_to_string(w[greatest(n - 12, 0) + 1:n], ' ') AS held FROM b")
def truncated_spans(spark: SparkSession, d: str) -> DataFrame:
    """Prompts cut from the left to twelve words, their answer spans moved along."""
    rows, w = _items(spark, d)
    cut = rows.select("item_id", K.left_cut(w, K.span_of_continuation(_head(w, 2), w), 12).alias("c"))
    return cut.select("item_id", F.size("c.ids").alias("n"), "c.s", "c.e", F.array_join("c.ids", " ").alias("held"))


_CORE = "acc AS (SELECT lang AS task, avg(quality)::DOUBLE AS a FROM labels JOIN documents USING (doc_id) GROUP BY lang), base(task, b) AS (VALUES ('en', 25.0::DOUBLE), ('de', 50.0), ('fr', 20.0), ('es', 10.0))"


def _accuracies(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "labels").join(S.table(spark, d, "documents").select("doc_id", F.col("lang").alias("task")).where("task IS NOT NULL"), "doc_id").groupBy("task").agg(F.avg("quality").alias("accuracy"))


@query("core_score", f"WITH {_CORE} SELECT count(*) AS tasks, round(avg((a - 0.01 * b) / (1 - 0.01 * b)), 9) AS core FROM acc JOIN base USING (task)")
def core_score(spark: SparkSession, d: str) -> DataFrame:
    """Mean over tasks of the accuracy above the task's baseline (percent)."""
    base = spark.createDataFrame([("en", 25.0), ("de", 50.0), ("fr", 20.0), ("es", 10.0)], "task string, base double")
    held = J.with_baseline(_accuracies(spark, d), base, "task", "base")
    return held.agg(F.count("*").alias("tasks"), F.round(F.avg(M.centered(F.col("accuracy"), F.col("base"))), 9).alias("core"))


@query("chat_core", f"WITH {_CORE}, c AS (SELECT *, CASE WHEN task IN ('en', 'de') THEN 0.25 ELSE 0.0 END::DOUBLE AS f FROM acc) SELECT round(CASE WHEN count(*) = 4 THEN avg((a - f) / (1 - f)) END, 9) AS all_tasks, round(CASE WHEN count(*) FILTER (f > 0) = 2 THEN avg((a - f) / (1 - f)) FILTER (f > 0) END, 9) AS categorical, NULL::DOUBLE AS incomplete FROM c")
def chat_core(spark: SparkSession, d: str) -> DataFrame:
    """The mean over tasks with baselines as fractions; only if every task ran."""
    acc = _accuracies(spark, d)
    base = spark.createDataFrame([("en", 0.25), ("de", 0.25), ("fr", 0.0), ("es", 0.0)], "task string, base double")
    part = base.where("base > 0")
    whole, chosen = M.mean_if_complete(acc, base, "task"), M.mean_if_complete(acc, part, "task")
    missing = M.mean_if_complete(acc.where("task <> 'en'"), base, "task")
    one = lambda df, name: df.select(F.round("score", 9).alias(name))
    return one(whole, "all_tasks").crossJoin(one(chosen, "categorical")).crossJoin(one(missing, "incomplete"))  # one row each


@query("pass_rates", "WITH e AS (SELECT l_orderkey, l_orderkey % 4 AS rank, bool_or(l_quantity > 40) AS ok FROM lineitem GROUP BY l_orderkey) SELECT count(*) AS examples, round(avg(ok::INT), 9)::DOUBLE AS micro FROM e")
def pass_rates(spark: SparkSession, d: str) -> DataFrame:
    """Any sample right, counted by rank and put together as one micro-average."""
    e = S.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_quantity") > 40).alias("ok"))
    parts = e.groupBy((F.col("l_orderkey") % 4).alias("rank")).agg(F.count("*").alias("n"), F.count_if("ok").alias("passed"))
    return parts.agg(F.sum("n").alias("examples"), F.round(F.sum("passed") / F.sum("n"), 9).alias("micro"))


@query("rollout_means", "SELECT l_orderkey, round(avg(l_quantity), 9)::DOUBLE AS reward, round(avg(l_linenumber), 9)::DOUBLE AS length, count(*) AS samples FROM lineitem GROUP BY l_orderkey")
def rollout_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean reward and length of each example's samples."""
    t = S.table(spark, d, "lineitem").groupBy("l_orderkey")
    return t.agg(F.round(F.avg(F.col("l_quantity").cast("double")), 9).alias("reward"), F.round(F.avg("l_linenumber"), 9).alias("length"), F.count("*").alias("samples"))


_TOP = 8


@query(
    "seeded_draws",
    f"""WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
    k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS r FROM x QUALIFY r <= {_TOP}),
    p AS (SELECT *, sum(exp((x - mx) / 0.7)) OVER (PARTITION BY vec_id ORDER BY r) AS c, sum(exp((x - mx) / 0.7)) OVER (PARTITION BY vec_id) AS z FROM (SELECT *, max(x) OVER (PARTITION BY vec_id) AS mx FROM k)),
    u AS (SELECT *, (('0x' || substr(md5('42:' || vec_id), 1, 8))::BIGINT) / 4294967296.0::DOUBLE AS u FROM p)
    SELECT vec_id, min(i) FILTER (r = 1)::INT AS greedy, coalesce(arg_min(i, r) FILTER (u * z < c), max_by(i, r))::INT AS drawn FROM u GROUP BY vec_id""",
)
def seeded_draws(spark: SparkSession, d: str) -> DataFrame:
    """The first of the largest logits, and a seeded draw from the softmax of the eight largest at temperature 0.7."""
    return M.top_k_draw(S.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("logits")), "vec_id", "logits", _TOP, 0.7, 42)


@query("byte_weighted_loss", "SELECT l_returnflag, round(sum(CASE WHEN b > 0 THEN l_extendedprice ELSE 0 END)::DOUBLE / (ln(2) * sum(b)), 6) AS bpb, count(*) FILTER (b = 0) AS specials FROM (SELECT *, CASE WHEN l_partkey % 300 < 256 THEN 1 + l_partkey % 4 ELSE 0 END AS b FROM lineitem) GROUP BY l_returnflag")
def byte_weighted_loss(spark: SparkSession, d: str) -> DataFrame:
    """Bits a byte with the byte length of each target looked up in the vocabulary's table; special ids have none."""
    ids = spark.range(300).select(F.col("id").alias("token"), F.when(F.col("id") < 256, 1 + F.col("id") % 4).otherwise(0).alias("n_bytes"))
    t = S.table(spark, d, "lineitem").select("l_returnflag", (F.col("l_partkey") % 300).alias("token"), F.col("l_extendedprice").cast("double").alias("nats"))
    t = t.join(F.broadcast(ids), "token")  # a row an id of the vocabulary
    return t.groupBy("l_returnflag").agg(F.round(M.bits_per_byte(F.col("nats"), F.col("n_bytes")), 6).alias("bpb"), F.count_if(F.col("n_bytes") == 0).alias("specials"))



@query(
    "report_values",
    """SELECT o_orderkey, CASE WHEN o_orderkey >= 10000 THEN format('{:,}', o_orderkey) ELSE o_orderkey::VARCHAR END AS key_said, printf('%.4f', o_totalprice::DOUBLE) AS price_said, printf('%.4f', o_custkey::DOUBLE * 1000) AS whole_said,
    '## Order ' || o_orderkey || chr(10) || 'timestamp: 2024-01-01 00:00:00' || chr(10) || chr(10) || '- o_orderkey: ' || CASE WHEN o_orderkey >= 10000 THEN format('{:,}', o_orderkey) ELSE o_orderkey::VARCHAR END || chr(10) || '- price: ' || printf('%.4f', o_totalprice::DOUBLE) || chr(10) || chr(10) AS section FROM orders""",
)
def report_values(spark: SparkSession, d: str) -> DataFrame:
    """Integers and numbers with a point as a report states them, and a section of both for each order."""
    o = S.table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), (F.col("o_custkey") * 1000).cast("double").alias("whole"))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    section = K.report_section(o, F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), at, ["o_orderkey", "price"])
    return o.select("o_orderkey", K.report_value(o, "o_orderkey").alias("key_said"), K.report_value(o, "price").alias("price_said"), K.report_value(o, "whole").alias("whole_said"), section.alias("section"))


@query(
    "metric_union",
    "SELECT metric, (row_number() OVER (ORDER BY metric <> 'CORE', metric = 'ChatCORE', metric) - 1)::INT AS place FROM (SELECT DISTINCT lang AS metric FROM documents UNION SELECT DISTINCT event_type FROM events UNION SELECT unnest(['CORE', 'ChatCORE']))",
)
def metric_union(spark: SparkSession, d: str) -> DataFrame:
    """The names of all stages' metrics once each, the score over tasks first and that over chats last."""
    names = S.table(spark, d, "documents").select(F.col("lang").alias("metric")).union(S.table(spark, d, "events").select("event_type")).union(spark.createDataFrame([("CORE",), ("ChatCORE",)], "metric string")).distinct()
    place = F.row_number().over(Window.orderBy(F.col("metric") != "CORE", F.col("metric") == "ChatCORE", "metric")) - 1  # a row a name
    return names.withColumn("place", place)


@query("seeded_head")
def seeded_head(spark: SparkSession, d: str) -> DataFrame:
    """The first ten items of a seeded shuffle."""
    b = S.running_total(S.table(spark, d, "benchmark").select("item_id"), ["item_id"], F.lit(1).cast("long"), "idx")
    return D.shuffled(b, "idx", 1337).where("place < 10").select("place", "item_id")


@query(
    "gate_specs",
    """SELECT c_custkey, CASE c_custkey % 12 WHEN 0 THEN 'auto' WHEN 1 THEN 'auto' WHEN 3 THEN 'donor' WHEN 4 THEN 'donor' WHEN 5 THEN 'donor' WHEN 7 THEN 'abs' WHEN 9 THEN 'dial' WHEN 11 THEN 'vector' END AS mode,
    CASE c_custkey % 12 WHEN 0 THEN '0.05' WHEN 1 THEN '0.5' WHEN 3 THEN 'p50' WHEN 4 THEN 'p95' WHEN 5 THEN 'p95' WHEN 7 THEN '0.25' WHEN 9 THEN (c_nationkey::DOUBLE)::VARCHAR WHEN 11 THEN '[' || c_nationkey || ', 0.2]' END AS value FROM customer""",
)
def gate_specs(spark: SparkSession, d: str) -> DataFrame:
    """Kinds and values of gate specifications made of customers' rows; null for what the grammar refuses."""
    n = F.col("c_nationkey").cast("string")
    forms = ["auto", "auto:0.5", "automatic", "donor", "donor:p95", "donorp95", "donor:p42", "abs:0.25", "abs", n, F.concat(F.lit("-1"), n), F.concat(F.lit("["), n, F.lit(", 0.2]"))]
    spec = F.element_at(F.array(*(F.lit(x) if isinstance(x, str) else x for x in forms)), (F.col("c_custkey") % 12 + 1).cast("int"))
    g = S.table(spark, d, "customer").select("c_custkey", K.gate_kind(spec).alias("g"))
    return g.select("c_custkey", F.col("g.mode").alias("mode"), F.col("g.value").alias("value"))


@query(
    "run_costs",
    "SELECT c_custkey, CASE WHEN lower(c_name) LIKE '%9%' THEN 3.0 WHEN lower(c_name) LIKE '%8%' THEN 1.79 WHEN lower(c_name) LIKE '%customer%' THEN 2.0 END::DOUBLE * (1 + c_nationkey) AS dollars_per_hour FROM customer",
)
def run_costs(spark: SparkSession, d: str) -> DataFrame:
    """Price an hour by the first pattern that a device's name contains, times the devices."""
    price = K.first_pattern(F.col("c_name"), [("9", 3.0), ("8", 1.79), ("Customer", 2.0)])
    return S.table(spark, d, "customer").select("c_custkey", (price * (1 + F.col("c_nationkey"))).alias("dollars_per_hour"))


@query(
    "training_rates",
    """WITH log AS (SELECT user_id AS run, event_id, value + 1 AS dt, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step FROM events),
    t AS (SELECT *, sum(CASE WHEN step > 10 THEN dt ELSE 0 END) OVER (PARTITION BY run ORDER BY event_id) AS spent FROM log)
    SELECT event_id, round(524288 / dt, 6) AS tokens_per_second, round(100 * 6e9 * 524288 / dt / 989e12, 9) AS mfu, round(100.0 * step / 2000, 9)::DOUBLE AS percent, round(CASE WHEN step > 10 THEN spent / (step - 10) * (2000 - step) / 60 END, 6) AS eta_minutes FROM t""",
)
def training_rates(spark: SparkSession, d: str) -> DataFrame:
    """Tokens a second, utilisation, progress and time left of a run of 2,000 steps; the first ten steps do not count for the last."""
    w = Window.partitionBy("run").orderBy("event_id")
    t = S.table(spark, d, "events").select(F.col("user_id").alias("run"), "event_id", (F.col("value") + 1).alias("dt"))
    t = t.withColumn("step", F.row_number().over(w) - 1)
    return M.run_rates(t, "run", "event_id", tokens=524_288, flops_per_token=6e9, peak=989e12, steps=2000).select("event_id", F.round("tokens_per_second", 6).alias("tokens_per_second"), F.round("mfu", 9).alias("mfu"), F.round("percent", 9).alias("percent"), F.round("eta_minutes", 6).alias("eta_minutes"))


@query(
    "spelling_transcripts",
    r"""WITH w AS (SELECT item_id, lower(regexp_extract(text, '[A-Za-z]+')) AS word FROM benchmark)
    SELECT item_id, word, array_to_string(string_split(word, ''), ',') AS spelled, substr(word, 1, 1) AS letter,
      list_reduce(list_prepend('', list_transform(range(1, len(word) + 1), lambda i: i::VARCHAR || ':' || substr(word, i::BIGINT, 1) || CASE WHEN substr(word, i::BIGINT, 1) = substr(word, 1, 1) THEN ' hit! count=' || len(list_filter(string_split(word, '')[1:i], lambda c: c = substr(word, 1, 1)))::VARCHAR ELSE '' END || chr(10))), lambda a, b: a || b) AS transcript
    FROM w WHERE len(word) > 0""",
)
def spelling_transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Letters of a word, counted one by one."""
    word = F.lower(F.regexp_extract("text", "([A-Za-z]+)", 1))
    w = S.table(spark, d, "benchmark").select("item_id", word.alias("word")).where("length(word) > 0")
    letter = F.substring("word", 1, 1)
    return w.select("item_id", "word", F.array_join(F.split("word", ""), ",").alias("spelled"), letter.alias("letter"), K.counted_letters(F.col("word"), letter).alias("transcript"))


@query("sets_that_agree", "SELECT (SELECT count(*) FROM (SELECT DISTINCT lang FROM documents) WHERE lang NOT IN ('de', 'en', 'es', 'fr')) = 0 AND (SELECT count(DISTINCT lang) FROM documents WHERE lang IN ('de', 'en', 'es', 'fr')) = 4 AS names_agree, false AS short_agree")
def sets_that_agree(spark: SparkSession, d: str) -> DataFrame:
    """Whether the names found and the names due are the same set."""
    found = S.table(spark, d, "documents").agg(F.collect_set("lang").alias("found"))  # a value a language
    agree = lambda *names: M.same_set(F.col("found"), F.array(*map(F.lit, names)))
    return found.select(agree("de", "en", "es", "fr").alias("names_agree"), agree("de", "en").alias("short_agree"))


@query("results_table", f"WITH {_CORE}, c AS (SELECT task, a, (a - 0.01 * b) / (1 - 0.01 * b) AS z FROM acc JOIN base USING (task)) SELECT 0::INT AS place, printf('%-35s, %-10s, %-10s', 'Task', 'Accuracy', 'Centered') AS value UNION ALL SELECT 1, printf('%-35s, %-10s, %-10s', task, printf('%.6f', a), printf('%.6f', z)) FROM c UNION ALL SELECT 2, printf('%-35s, %-10s, %-10s', 'CORE', '', printf('%.6f', avg(z))) FROM c")
def results_table(spark: SparkSession, d: str) -> DataFrame:
    """The lines of a results file: a heading, the tasks, the score over tasks."""
    base = spark.createDataFrame([("en", 25.0), ("de", 50.0), ("fr", 20.0), ("es", 10.0)], "task string, base double")
    r = J.with_baseline(_accuracies(spark, d), base, "task", "base").select("task", "accuracy", M.centered(F.col("accuracy"), F.col("base")).alias("centered"))
    return S.results_lines(r, r.agg(F.avg("centered").alias("core")))


@query("report_fields", "SELECT o_orderkey, o_totalprice::DOUBLE::VARCHAR AS price, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE timestamp '2024-01-01 00:00:00' + to_seconds(o_custkey) END AS began FROM orders")
def report_fields(spark: SparkSession, d: str) -> DataFrame:
    """A key and a time read out of report sections; a time that is none is skipped."""
    t = F.timestamp_add("SECOND", F.col("o_custkey").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    said = F.when(F.col("o_orderkey") % 3 == 0, F.lit("soon")).otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
    section = F.concat(F.lit("## Orders\ntimestamp: "), said, F.lit("\n- price: "), F.col("o_totalprice").cast("double").cast("string"), F.lit("\n"))
    return S.table(spark, d, "orders").select("o_orderkey", X.report_field(section, "price").alias("price"), X.report_time(section, "timestamp:").cast("timestamp_ntz").alias("began"))


@query("seeded_choices")
def seeded_choices(spark: SparkSession, d: str) -> DataFrame:
    """A topic, a persona, a dynamic and openers for each document, drawn from its id."""
    topics = {"trade": ["prices", "goods"], "craft": ["wood", "iron", "clay"], "travel": ["trains", "boats"]}
    openers = {"plain": ["hello", "hi there"], "question": ["why is that?", "can you explain?"], "task": ["write a poem", "fix my code"], "odd": ["beep"]}
    draw = D.diversity(topics, ["novice", "expert", "skeptic", "child"], ["short", "long", "curious"], openers)
    return S.table(spark, d, "documents").select("doc_id", draw(F.col("doc_id")).alias("d")).select("doc_id", "d.*")


@query("fill_progress", "SELECT event_id, round(100 * least(greatest(value / 80.0, 0), 1), 9)::DOUBLE AS percent, round(CASE WHEN event_id % 4 > 0 THEN greatest(80 - value, 0) / (event_id % 4) END, 9)::DOUBLE AS seconds, round(4e8 / (1000.0 * (event_id % 4 + 1) * 8), 6)::DOUBLE AS cover FROM events")
def fill_progress(spark: SparkSession, d: str) -> DataFrame:
    """How full a buffer is, the seconds that are left at its rate, and how long a shard lasts."""
    percent, seconds = M.progress(F.col("value"), F.lit(80.0), F.col("event_id") % 4)
    cover = M.cover_seconds(F.lit(4e8), 1000.0 * (F.col("event_id") % 4 + 1), 8)
    return S.table(spark, d, "events").select("event_id", F.round(percent, 9).alias("percent"), F.round(seconds, 9).alias("seconds"), F.round(cover, 6).alias("cover"))


@query("newest_checkpoint", "SELECT 'd' || max(c_nationkey) AS folder, (SELECT max(c_custkey) FROM customer WHERE c_nationkey = (SELECT max(c_nationkey) FROM customer)) AS step FROM customer")
def newest_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    """The deepest model's last step, from file names."""
    files = S.table(spark, d, "customer").select(F.concat(F.lit("d"), "c_nationkey").alias("folder"), F.concat(F.lit("model_"), "c_custkey", F.lit(".pt.gz")).alias("name"), F.lit(0).alias("modified"))
    return S.newest(files)


def _words(spark: SparkSession, d: str) -> DataFrame:
    """idx, word: the first word of each item in lower case, a word list in the items' order."""
    word = F.lower(F.regexp_extract("text", "([A-Za-z]+)", 1))
    items = S.table(spark, d, "benchmark").select("item_id", word.alias("word")).where("length(word) > 0")
    return S.running_total(items, ["item_id", "word"], F.lit(1).cast("long"), "idx").select("idx", "word")


@query("spelling_examples")
def spelling_examples(spark: SparkSession, d: str) -> DataFrame:
    """A drawn question about the letters of a drawn word for each document's id, with the conversation that answers it."""
    at = S.table(spark, d, "documents").select(F.col("doc_id").alias("index"))
    c = K.spelling_conversations(at, _words(spark, d))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["type"], F.lit("|"), p["text"])), "\n")
    return c.select("index", "word", "letter", "answer", "asked", text.alias("conversation"))


@query("spelling_words")
def spelling_words(spark: SparkSession, d: str) -> DataFrame:
    """A word to spell for each document's id, drawn out of a shuffled list, with seeds of the test split."""
    at = S.table(spark, d, "documents").select(F.col("doc_id").alias("index"))
    return K.spelling_only(at, _words(spark, d), "test")

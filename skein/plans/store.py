"""Activation stores, alignment, sites and gates as queries; byte chunks of three stand for tokens, embeddings for activations."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tokens as K
from ..operators import packing as P
from ..operators import store as A
from ..session import shared_folder
from ..sources import stores as R
from ..sources import tables as S
from .registry import query


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", "text", "source")


@query("content_hashes")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", A.content_hash("text").alias("doc_hash"))


def _chunk_spans(spark: SparkSession, d: str) -> DataFrame:
    """Character spans of chunks of three bytes."""
    n = F.octet_length("text")
    lens = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(3)), lambda i: F.least(F.lit(3), n - i))
    t = _docs(spark, d).where("length(text) > 0").select("doc_id", F.posexplode(A.char_spans("text", lens)).alias("pos", "x"))
    return t.select("doc_id", "pos", "x.s", "x.e")


_CHUNKS = """ch AS (SELECT doc_id, k, strlen(c) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS k FROM documents WHERE length(text) > 0)),
    lead AS (SELECT doc_id, k, sum(n) OVER (PARTITION BY doc_id ORDER BY k) - n AS byte0 FROM ch),
    t AS (SELECT doc_id, unnest(generate_series(0, (strlen(text) - 1) // 3)) AS pos FROM documents WHERE length(text) > 0),
    per AS (SELECT t.doc_id, t.pos, count(l.k) AS n FROM t LEFT JOIN (SELECT doc_id, k, (byte0 // 3)::BIGINT AS pos FROM lead) l ON t.doc_id = l.doc_id AND t.pos = l.pos GROUP BY t.doc_id, t.pos),
    spans AS (SELECT doc_id, pos::INT AS pos, (sum(n) OVER w - n)::INT AS s, (sum(n) OVER w)::INT AS e FROM per WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""


@query("token_char_spans", f"WITH {_CHUNKS} SELECT doc_id, count(*) AS tokens, sum(s)::BIGINT AS starts, sum(e)::BIGINT AS ends, sum(s::BIGINT * pos)::BIGINT AS weighted, count(*) FILTER (s = e) AS empty FROM spans GROUP BY doc_id")
def token_char_spans(spark: SparkSession, d: str) -> DataFrame:
    """Sums over the character spans of each document's tokens."""
    t = _chunk_spans(spark, d).groupBy("doc_id")
    return t.agg(F.count("*").alias("tokens"), F.sum("s").alias("starts"), F.sum("e").alias("ends"), F.sum(F.col("s").cast("long") * F.col("pos")).alias("weighted"), F.count_if(F.col("s") == F.col("e")).alias("empty"))


@query(
    "rebased_windows",
    f"""WITH {_CHUNKS}, w AS (SELECT *, pos // 256 AS part, s - first_value(s) OVER (PARTITION BY doc_id, pos // 256 ORDER BY pos) AS rs, e - first_value(s) OVER (PARTITION BY doc_id, pos // 256 ORDER BY pos) AS re FROM spans)
    SELECT doc_id, part::INT AS part, count(*) AS n, min(rs)::INT AS first, max(re)::INT AS chars, count(*) FILTER (rs >= 500) AS capped FROM w GROUP BY doc_id, part""",
)
def rebased_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 256 tokens with spans from their own first character; what begins beyond 500 characters is capped."""
    t = A.windows(_chunk_spans(spark, d), "doc_id", 256, foreign=500).groupBy("doc_id", "part")
    return t.agg(F.count("*").alias("n"), F.min("s").alias("first"), F.max("e").alias("chars"), F.count_if("capped").alias("capped"))


_WORDS = "w AS (SELECT item_id, unnest(string_split(text, ' ')) AS piece, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM benchmark)"


@query(
    "boundary_map",
    f"""WITH {_WORDS}, n AS (SELECT *, strlen(piece) AS n, coalesce(sum(strlen(piece)) OVER (PARTITION BY item_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM w)
    SELECT item_id, pos::INT AS pos, CASE WHEN n = 0 THEN []::BIGINT[] ELSE generate_series(before, before + n - 1) END AS indices FROM n""",
)
def boundary_map(spark: SparkSession, d: str) -> DataFrame:
    """The places of each word's byte tokens among the tokens of all words."""
    w = S.table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "piece"))
    pieces = w.select("item_id", "pos", F.lit(0).alias("s"), F.length("piece").alias("e"), F.size(K.byte_ids("piece")).alias("count"))
    return A.local_indices(pieces, "item_id", "count")


@query("token_inflation", "SELECT lang, round(sum(strlen(text)) / sum(length(text) - length(replace(text, ' ', '')) + 1), 9)::DOUBLE AS inflation FROM documents GROUP BY lang")
def token_inflation(spark: SparkSession, d: str) -> DataFrame:
    words = F.size(F.split("text", " "))
    return S.table(spark, d, "documents").groupBy("lang").agg(F.round(A.inflation(F.octet_length("text"), words), 9).alias("inflation"))


@query(
    "store_activations",
    "SELECT doc_id, doc_id % 9 <> 0 AND doc_id % 10 <> 0 AS hit, list_sum(list_transform(range(3), lambda i: CASE WHEN doc_id % 9 <> 0 AND doc_id % 10 <> 0 THEN (doc_id * 7 + i) % 11 ELSE 0 END))::BIGINT AS total FROM documents",
)
def store_activations(spark: SparkSession, d: str) -> DataFrame:
    """Activations by content and token count: missing documents and other counts get exact zeros."""
    from ..operators.joins import join_store

    docs = S.table(spark, d, "documents").select("doc_id", F.concat_ws(":", "doc_id", F.md5(F.col("text").cast("binary"))).alias("key"), F.length("text").alias("n"))
    row = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: ((F.col("doc_id") * 7 + i) % 11).cast("float"))
    store = docs.where("doc_id % 9 <> 0").select("key", (F.col("n") + (F.col("doc_id") % 10 == 0).cast("int")).alias("n"), F.array(row).alias("values"))
    t = join_store(docs, store, "key", "n", {"values": A.zeros(F.lit(1), 3)})
    return t.select("doc_id", "hit", F.aggregate(F.flatten("values"), F.lit(0.0), lambda a, x: a + x).cast("long").alias("total"))


@query(
    "indexed_documents",
    "SELECT source AS shard, count(*) AS docs, sum(length(text))::BIGINT AS n, sum(row)::BIGINT AS rows FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row FROM documents) GROUP BY source",
)
def indexed_documents(spark: SparkSession, d: str) -> DataFrame:
    """A hash index over spans by place, checked against the corpus, counted by shard."""
    corpus = S.as_shards(_docs(spark, d)).select("shard", "row", "text")
    spans = corpus.select("shard", "row", F.col("row").alias("start"), F.length("text").cast("long").alias("n"))
    index = A.hash_index(spans, corpus).where("doc_hash IS NOT NULL")
    return index.groupBy("shard").agg(F.count("*").alias("docs"), F.sum("n").alias("n"), F.sum("start").alias("rows"))


@query("picked_channels", "SELECT vec_id, round(embedding[6]::DOUBLE, 6) AS a, round(embedding[2]::DOUBLE, 6) AS b FROM embeddings")
def picked_channels(spark: SparkSession, d: str) -> DataFrame:
    """Channels by name, in the order asked for; the layout has to come in its own order."""
    names = A.same_order([f"c{i}" for i in range(64)], [f"c{i}" for i in range(64)])
    v = A.selected(F.col("embedding"), names, ["c5", "c1"])
    return S.table(spark, d, "embeddings").select("vec_id", F.round(v[0].cast("double"), 6).alias("a"), F.round(v[1].cast("double"), 6).alias("b"))


_CHANNELS = "ch AS (SELECT (i - 1)::INT AS channel, sqrt(avg(x * x)) AS rms, avg(CASE WHEN x <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE) AS nonzero, ((i - 1) % 5)::DOUBLE AS loudness FROM (SELECT generate_subscripts(embedding, 1) AS i, CASE WHEN generate_subscripts(embedding, 1) % 7 = 0 THEN 0 ELSE unnest(embedding)::DOUBLE END AS x FROM embeddings) GROUP BY i)"


def _channels(spark: SparkSession, d: str) -> DataFrame:
    """Channels with every seventh one dead, and a loudness."""
    e = S.table(spark, d, "embeddings").select(F.posexplode("embedding").alias("channel", "x"))
    x = F.when(F.col("channel") % 7 == 6, 0.0).otherwise(F.col("x").cast("double"))
    return e.groupBy("channel").agg(F.sqrt(F.avg(x * x)).alias("rms"), F.avg((x != 0).cast("double")).alias("nonzero")).withColumn("loudness", (F.col("channel") % 5).cast("double"))


@query("auto_gates", f"WITH {_CHANNELS}, w AS (SELECT channel, CASE WHEN rms > 0.001 AND nonzero > 0 THEN 1 / rms ELSE 0 END AS w, rms > 0.001 AND nonzero > 0 AS active FROM ch) SELECT channel, active, round(w * 0.05 / (SELECT sqrt(avg(w * w)) FROM w), 9)::DOUBLE AS gate FROM w")
def auto_gates(spark: SparkSession, d: str) -> DataFrame:
    return A.gates(_channels(spark, d), 0.05).select("channel", "active", F.round("gate", 9).alias("gate"))


@query("donor_gates", f"WITH {_CHANNELS}, w AS (SELECT channel, rms > 0.001 AND nonzero > 0 AND loudness > 0 AS active, CASE WHEN rms > 0.001 AND nonzero > 0 AND loudness > 0 THEN loudness / rms ELSE 0 END AS w FROM ch) SELECT channel, active, round(w * 0.2 / (SELECT sqrt(avg(w * w)) FROM w), 9)::DOUBLE AS gate FROM w")
def donor_gates(spark: SparkSession, d: str) -> DataFrame:
    return A.gates(_channels(spark, d), 0.2, "loudness").select("channel", "active", F.round("gate", 9).alias("gate"))


@query(
    "site_outputs",
    """WITH x AS (SELECT vec_id, list_transform(embedding[1:8], lambda v: v::DOUBLE) AS x, list_transform(embedding[9:11], lambda v: CASE WHEN vec_id % 4 = 0 THEN 0.0 ELSE v::DOUBLE END) AS a FROM embeddings),
    g AS (SELECT *, sqrt((0.01 + 0.04 + 0.09) / 3) AS loud FROM x),
    m AS (SELECT *, [a[1] * 0.1 / loud, a[2] * 0.2 / loud, a[3] * 0.3 / loud] AS s FROM g),
    z AS (SELECT *, list_transform(range(8), lambda j: s[1] * cos(j) + s[2] * cos(2 * j) + s[3] * cos(3 * j)) AS z FROM m),
    r AS (SELECT *, sqrt(greatest(list_sum(list_transform(x, lambda v: v * v)) / 8, 1e-8)) AS rx, sqrt(greatest(list_sum(list_transform(z, lambda v: v * v)) / 8, 1e-8)) AS rz FROM z)
    SELECT vec_id, unnest(range(8))::INT AS channel, round(unnest(list_transform(range(8), lambda j: x[j + 1] + loud * rx / rz * z[j + 1])), 6) AS y FROM r""",
)
def site_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Three activations laid along three directions of eight channels; a row of zeros changes nothing."""
    directions = [[math.cos(k * j) for j in range(8)] for k in (1, 2, 3)]
    double = lambda v: F.transform(v, lambda e: e.cast("double"))
    a = F.transform(double(F.slice("embedding", 9, 3)), lambda v: F.when(F.col("vec_id") % 4 == 0, 0.0).otherwise(v))
    t = S.table(spark, d, "embeddings").select("vec_id", double(F.slice("embedding", 1, 8)).alias("x"), a.alias("a"))
    y = t.select("vec_id", F.posexplode(A.site(F.col("x"), F.col("a"), directions, [0.1, 0.2, 0.3])).alias("channel", "y"))
    return y.select("vec_id", "channel", F.round("y", 6).alias("y"))


@query("table_lookup", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 20 < 12 THEN round(0.5 * cos(2 * pi() * (l_partkey % 20) / 12), 9) ELSE 0.0 END AS x, CASE WHEN l_partkey % 20 < 12 THEN round(0.5 * sin(2 * pi() * (l_partkey % 20) / 12), 9) ELSE 0.0 END AS y FROM lineitem")
def table_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Twelve ids on a ring of amplitude one half; all others have the zero vector."""
    angle = F.lit(2.0) * F.pi() * F.col("id") / 12
    ring = spark.range(12).select(F.col("id").alias("token"), F.array(F.cos(angle) * 0.5, F.sin(angle) * 0.5).alias("vector"))
    ids = S.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 20).alias("id"))
    v = A.lookup(ids, "id", ring, 2)
    return v.select("l_orderkey", "l_linenumber", F.round(F.col("vector")[0], 9).alias("x"), F.round(F.col("vector")[1], 9).alias("y"))


@query("sphere_points", "SELECT p_partkey, i::INT AS i, round(sqrt(1 - z * z) * cos(pi() * (3 - sqrt(5)) * i), 9) AS x, round(sqrt(1 - z * z) * sin(pi() * (3 - sqrt(5)) * i), 9) AS y, round(z, 9)::DOUBLE AS z, round(-1 + 2.0 * i / 49, 9)::DOUBLE AS line FROM (SELECT p_partkey, i, 1.0::DOUBLE - 2.0 * (i + 0.5) / 50 AS z FROM (SELECT p_partkey, p_partkey % 50 AS i FROM part))")
def sphere_points(spark: SparkSession, d: str) -> DataFrame:
    """The point of each part among fifty of a spiral on the sphere, and among fifty on a line from -1 to 1."""
    i = F.col("p_partkey") % 50
    z = 1.0 - 2.0 * (i + 0.5) / 50
    r, turn = F.sqrt(1 - z * z), i * (math.pi * (3 - math.sqrt(5)))
    return S.table(spark, d, "part").select("p_partkey", i.cast("int").alias("i"), F.round(r * F.cos(turn), 9).alias("x"), F.round(r * F.sin(turn), 9).alias("y"), F.round(z, 9).alias("z"), F.round(-1 + 2.0 * i / 49, 9).alias("line"))


@query(
    "channel_families",
    """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
    f AS (SELECT *, CASE WHEN pos < 12 THEN 'months' WHEN pos < 19 THEN 'weekdays' WHEN pos < 23 THEN 'seasons' ELSE 'rest' END AS family, CASE WHEN pos < 12 THEN 2 * pi() * pos / 12 WHEN pos < 19 THEN 2 * pi() * (pos - 12) / 7 WHEN pos < 23 THEN 2 * pi() * (pos - 19) / 4 END AS t FROM e)
    SELECT vec_id, family, round(sum(x * coalesce(cos(t), 1)), 6) AS c, round(sum(x * coalesce(sin(t), 0)), 6) AS s FROM f GROUP BY vec_id, family""",
)
def channel_families(spark: SparkSession, d: str) -> DataFrame:
    """All channels by family: cyclic ones as two sums at the angles of their order, the others as they are."""
    rows = []
    for family, first, n in (("months", 0, 12), ("weekdays", 12, 7), ("seasons", 19, 4)):
        rows += [(first + k, family, math.cos(2 * math.pi * k / n), math.sin(2 * math.pi * k / n)) for k in range(n)]
    rows += [(k, "rest", 1.0, 0.0) for k in range(23, 64)]
    concepts = spark.createDataFrame(rows, "pos int, family string, c double, s double")
    scores = S.table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", "pos", F.col("x").cast("double").alias("score"))
    return A.families(scores, concepts, ["vec_id"]).select("vec_id", "family", F.round("c", 6).alias("c"), F.round("s", 6).alias("s"))


@query(
    "store_preflight",
    """WITH p AS (SELECT doc_id, length(text) AS n, length(text) + CASE WHEN doc_id % 50 = 0 THEN 1 ELSE 0 END AS cn, doc_id % 97 <> 0 AS ok, doc_id % 9 <> 0 AS stored FROM documents), t AS (SELECT *, stored AND cn = n AS hit FROM p WHERE ok)
    SELECT count(*) FILTER (cn > 0) AS docs, count(*) FILTER (cn > 0 AND hit) AS covered, count(*) FILTER (cn > 0 AND NOT hit) AS missing, count(*) FILTER (cn = 0) AS empty, count(*) FILTER (cn <> n) AS contract_mismatch,
      round(count(*) FILTER (cn > 0 AND hit) / count(*) FILTER (cn > 0), 9)::DOUBLE AS doc_coverage, round(sum(cn) FILTER (hit) / sum(cn), 9)::DOUBLE AS token_coverage, round(sum(n // 3) FILTER (hit) / sum(cn) FILTER (hit), 9)::DOUBLE AS zero_row_share,
      (SELECT count(*) FROM p WHERE NOT ok) AS bad_first, false AS ok FROM t""",
)
def store_preflight(spark: SparkSession, d: str) -> DataFrame:
    """Every counter of a store against the tokens its consumer makes; some counts drift, some documents are not stored."""
    n = F.length("text")
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("key"), n.alias("n"), (n + (F.col("doc_id") % 50 == 0).cast("int")).alias("consumer_n"), (F.col("doc_id") % 97 != 0).alias("first"))
    store = docs.where("key % 9 <> 0").select("key", "n", F.expr("n div 3").alias("zero_rows"))
    out = A.preflight(docs, store)
    return out.select(*(F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes))


@query("lockstep_rows")
def lockstep_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of 512 byte tokens packed with a payload (each id's double) that stays in step."""
    docs = S.placed(_docs(spark, d)).select(F.col("doc_id").alias("ord"), F.col("place").alias("doc_id"), F.concat(F.array(F.lit(256)), K.byte_ids(F.coalesce("text", F.lit("")))).alias("ids"))
    docs = docs.withColumn("values", F.transform("ids", lambda i: i * 2))
    sized = P.ranks(docs.select("doc_id", "ord", F.size("ids").alias("n")), "ord", row_group=16)
    rows = A.with_payload(P.packed(sized, 512, 100, "crop"), docs)
    return rows.select("rank", "row", F.size("ids").alias("n"), F.forall(F.zip_with("ids", "values", lambda i, v: i * 2 == v), lambda x: x).alias("in_step"))


@query(
    "completion_prompts",
    """WITH c AS (SELECT *, lag(role) OVER w AS prev, lag(text) OVER w AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    e AS (SELECT conv_id, CASE WHEN count(*) FILTER (role = 'user' AND prev = 'user') + count(*) FILTER (role = 'assistant' AND (prev IS NULL OR prev <> 'user')) > 0 THEN 'roles do not alternate' WHEN max(CASE WHEN back = 1 THEN role END) <> 'assistant' THEN 'ends without a reply' END AS error FROM c GROUP BY conv_id),
    n AS (SELECT conv_id, (sum(strlen(text) + CASE WHEN prev = 'system' THEN strlen(before) + 2 ELSE 0 END + 2) + 2)::INT AS n_tokens, 259 AS last FROM c WHERE role <> 'system' AND back > 1 GROUP BY conv_id)
    SELECT conv_id, CASE WHEN error IS NULL THEN n_tokens END AS n_tokens, CASE WHEN error IS NULL THEN last END AS last, error FROM e LEFT JOIN n USING (conv_id)""",
)
def completion_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Conversations without their last reply, ending on the mark that begins one; a conversation that has no such prompt says why."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = S.table(spark, d, "conversations").withColumn("prev", F.lag("role").over(w))
    wrong = ((F.col("role") == "user") & (F.col("prev") == "user")) | ((F.col("role") == "assistant") & F.coalesce(F.col("prev") != "user", F.lit(True)))
    judged = turns.groupBy("conv_id").agg(F.count_if(wrong).alias("wrong"), F.max_by("role", "turn").alias("end"))
    error = F.when(F.col("wrong") > 0, "roles do not alternate").when(F.coalesce(F.col("end") != "assistant", F.lit(True)), "ends without a reply")
    judged = judged.select("conv_id", error.alias("error"))
    good = turns.join(judged.where("error IS NULL").select("conv_id"), "conv_id", "left_semi")
    ids = K.completions(good.select("conv_id", "turn", "role", "text"), K.byte_ids, K.BYTE_SPECIALS, max_tokens=1 << 30)
    found = ids.select("conv_id", F.size("ids").alias("n_tokens"), F.element_at("ids", -1).alias("last"))
    return judged.join(found, "conv_id", "left").select("conv_id", "n_tokens", "last", "error")


@query(
    "tool_call_masks",
    "SELECT o_orderkey, (1 + 2 + 4 + 1 + 3 + (strlen(o_orderkey::VARCHAR) + 2 + 2) + (strlen((o_orderkey * 2)::VARCHAR) + 2) + 6 + 1)::INT AS n_tokens, (3 + (strlen(o_orderkey::VARCHAR) + 2 + 2) + 6 + 1)::INT AS n_trained FROM orders",
)
def tool_call_masks(spark: SparkSession, d: str) -> DataFrame:
    """Replies with tool calls: text and calls are trained on, the calls' output is not."""
    k = F.col("o_orderkey").cast("string")
    answer = F.concat(F.lit("so <<"), k, F.lit("*2="), (F.col("o_orderkey") * 2).cast("string"), F.lit(">> it is"))
    orders = S.table(spark, d, "orders")
    from ..functions.text import tool_parts

    asked = orders.select(F.col("o_orderkey").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.lit("what").alias("text"))).alias("parts"))
    told = orders.select(F.col("o_orderkey").alias("conv_id"), F.lit(1).alias("turn"), F.lit("assistant").alias("role"), tool_parts(answer).alias("parts"))
    r = K.render_parts(asked.unionByName(told), K.byte_ids, K.BYTE_SPECIALS, max_tokens=2048)
    return r.select(F.col("conv_id").alias("o_orderkey"), F.size("ids").alias("n_tokens"), F.aggregate("mask", F.lit(0), lambda a, x: a + x).alias("n_trained"))


@query("tool_use")
def tool_use(spark: SparkSession, d: str) -> DataFrame:
    """Token logs of samples that call the calculator: what is forced into them, and where they end."""
    from ..streaming.tools import continued

    k = F.col("o_orderkey")
    said = F.concat(F.lit("so "), F.lit("\x01"), k.cast("string"), F.lit("*2"), F.lit("\x02"), F.lit(" is it"), F.lit("\x03"), F.lit("beyond"))
    log = S.table(spark, d, "orders").select(k.alias("sample"), F.posexplode(K.byte_ids(said)).alias("step", "token"))
    marks = {1: K.BYTE_SPECIALS["<|python_start|>"], 2: K.BYTE_SPECIALS["<|python_end|>"], 3: K.BYTE_SPECIALS["<|assistant_end|>"]}
    token = F.col("token")
    for byte, special in marks.items():
        token = F.when(F.col("token") == byte, special).otherwise(token)
    return continued(log.withColumn("token", token)).groupBy("sample").agg(F.count("*").alias("n"), F.count_if(F.col("mask") == 0).alias("forced"), F.max("done").alias("done"))


_PROBE = {"zero": [[0.25] * 32, [0.5] * 32], "scale": [[0.5] * 32, [0.25] * 32]}
_PROBE_STATS = {"mean": [[1.0] * 32, [2.0] * 32], "std": [[2.0] * 32, [4.0] * 32]}
#: Vectors of one score file, about.
SHARD_ROWS = 1 << 16


@query(
    "score_shards",
    """WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(-128, least(127, round(x::DOUBLE * 200, 0)))) AS q FROM embeddings)
    SELECT (vec_id % 3)::INT AS shard, vec_id // 3 AS row, 1::INT AS n, i::INT AS concept, round((q[33 + i] * 0.25 + 0.5 - 2.0) / 4.0, 4)::DOUBLE AS score FROM q, range(32) r(i)""",
)
def score_shards(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as int8 score files of two layers, and the second layer read back from these, standardised.

    Shards are those of the SQL, ids modulo 3, each in as many files as keep about ``SHARD_ROWS`` vectors; lines name the
    vectors, whose ids may have gaps, repeat or be null. Files have no room for a vector of fewer than 64 components:
    what such a one has is standardised without them, the rest is null.
    """
    path = f"{shared_folder(spark)}/scores-{uuid.uuid4().hex}"
    t = S.table(spark, d, "embeddings").select("vec_id", "embedding")
    files = -(-t.count() // (3 * SHARD_ROWS)) or 1
    shard = F.pmod(F.coalesce("vec_id", F.lit(0)), F.lit(3)) + 3 * F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(files))
    int8 = lambda x: F.greatest(F.lit(-128), F.least(F.lit(127), F.round(x.cast("double") * 200))).cast("tinyint")
    whole = F.coalesce(F.size("embedding") >= 64, F.lit(False))
    q = F.transform(F.slice("embedding", 1, 64), int8)
    rows = t.where(whole).select(shard.cast("int").alias("shard"), F.col("vec_id").alias("doc"), F.lit(1).alias("n"), q.alias("q"))
    shards = R.write_scores(rows, path, [4, 8], [f"c{i}" for i in range(32)], _PROBE, _PROBE_STATS)
    read = R.read_scores(spark, path, shards, layer=8).select(F.col("doc").cast("long").alias("vec_id"), "n", F.posexplode("values").alias("concept", "score"))
    short = t.where(~whole).select("vec_id", "embedding", F.lit(1).alias("n"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("concept"))
    at, zero, scale, mean, std = F.col("concept") + 32, *(F.lit(x[1][0]) for x in (*_PROBE.values(), *_PROBE_STATS.values()))
    has = F.when(F.size("embedding") > at, (int8(F.get("embedding", at)) * scale + zero - mean) / std)
    found = read.unionByName(short.select("vec_id", "n", "concept", has.cast("float").alias("score")))
    score = F.round(F.col("score").cast("double"), 4).alias("score")
    return found.select((F.col("vec_id") % 3).cast("int").alias("shard"), F.expr("vec_id div 3").alias("row"), "n", "concept", score)


@query(
    "observed_sweep",
    """WITH q AS (SELECT unnest(list_transform(embedding, lambda x: greatest(-127, least(127, round(x::DOUBLE * 400, 0)))))::INT AS q FROM embeddings)
    SELECT (SELECT count(*) FROM embeddings) AS documents, (SELECT coalesce(sum(len(embedding)), 0)::BIGINT FROM embeddings) AS tokens, 0::BIGINT AS drift, count(*) AS values, count(*) FILTER (q = 0) AS zero, count(*) FILTER (abs(q) >= 127) AS clipped FROM q""",
)
def observed_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a store of int8 values, taken while its shards are written."""
    q = F.transform("embedding", lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") * 400)))).cast("array<tinyint>")
    rows = S.table(spark, d, "embeddings").select((F.col("vec_id") % 4).alias("shard"), "vec_id", F.size("embedding").alias("n"), q.alias("q"))
    found = A.sweep(rows, f"{shared_folder(spark)}/sweep-{uuid.uuid4().hex}", A.write_measures(F.col("n"), F.size("q"), F.col("q")))
    names = ("documents", "tokens", "drift", "values", "zero", "clipped")
    return spark.createDataFrame([tuple(int(found.get(k, 0)) for k in names)], ", ".join(f"{k} long" for k in names))


#: Channels of the query below: months in alphabetical order, five continents, and concepts without a family.
_CHANNELS = [*sorted(A.CYCLES["months"]), "africa", "america", "asia", "europe", "oceania", *(f"c{k}" for k in range(17, 64))]
_SAVED = [[0.1, 0.5], [0.2, -0.25], [0.3, 0.125], [0.4, 0.0], [-0.5, 1.0]]


@query(
    "structured_families",
    f"""WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding)::DOUBLE AS x FROM embeddings),
    m AS (SELECT unnest({[A.CYCLES["months"].index(c) for c in sorted(A.CYCLES["months"])]}) AS i, unnest(range(12)) AS k),
    p AS (SELECT unnest({[r[0] for r in _SAVED]})::DOUBLE AS a, unnest({[r[1] for r in _SAVED]})::DOUBLE AS b, unnest(range(12, 17)) AS k)
    SELECT vec_id, 'continents.pc1' AS name, round(sum(x * a), 6) AS value FROM e JOIN p USING (k) GROUP BY vec_id UNION ALL SELECT vec_id, 'continents.pc2', round(sum(x * b), 6) FROM e JOIN p USING (k) GROUP BY vec_id
    UNION ALL SELECT vec_id, 'months.cos', round(sum(x * cos(2 * pi() * i / 12)), 6) FROM e JOIN m USING (k) GROUP BY vec_id UNION ALL SELECT vec_id, 'months.sin', round(sum(x * sin(2 * pi() * i / 12)), 6) FROM e JOIN m USING (k) GROUP BY vec_id
    UNION ALL SELECT vec_id, 'c' || k, round(x, 6) FROM e WHERE k >= 17""",
)
def structured_families(spark: SparkSession, d: str) -> DataFrame:
    """All channels as structured activations: a cyclic family, one with saved principal axes, and plain concepts."""
    family = {c: "months" for c in _CHANNELS[:12]} | {c: "continents" for c in _CHANNELS[12:17]} | {c: c for c in _CHANNELS[17:]}
    axes = A.family_axes(_CHANNELS, family, {"continents": _SAVED})
    found = A.structured(S.table(spark, d, "embeddings"), ["vec_id"], "embedding", axes)
    return found.select("vec_id", "name", F.round("value", 6).alias("value"))

"""Activation stores: hashes, spans, windows, layouts, sites, gates; writing, resuming and opening a store.

A store is a folder of Parquet partitioned by shard under ``data``, a list of
finished shards under ``done`` and one row of metadata under ``meta``, written
last. Values are arrays with one row of channels a token.
"""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

FORMAT = "activation-store-v2"
KINDS = ("activations", "probe_scores")
SPAN = T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])


# ------------------------------------------------------------ hashes and spans


@F.arrow_udf(T.LongType())
def content_hash(texts: pa.Array) -> pa.Array:
    """64-bit BLAKE2b of a text's UTF-8, little-endian, as a signed long; null stays null."""
    return pa.array([None if t.as_py() is None else int.from_bytes(hashlib.blake2b(t.as_py().encode(), digest_size=8).digest(), "little", signed=True) for t in texts], pa.int64())


@F.arrow_udf(T.ArrayType(SPAN))
def char_spans(texts: pa.Array, lengths: pa.Array) -> pa.Array:
    """Character spans of tokens from their byte lengths.

    A character belongs to the token that holds its first byte; a token of
    continuation bytes alone has an empty span. Lengths that do not add up to
    the text's bytes are an error.
    """
    sizes = pc.fill_null(pc.list_value_length(lengths), 0).to_numpy(zero_copy_only=False)
    flat = lengths.flatten().to_numpy(zero_copy_only=False)
    starts, stops, at = np.empty(len(flat), np.int32), np.empty(len(flat), np.int32), 0
    for text, n in zip(texts, sizes.tolist(), strict=True):
        raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
        ends = np.concatenate([[0], np.cumsum(flat[at : at + n], dtype=np.int64)])
        if ends[-1] != len(raw):
            raise ValueError(f"tokens have {ends[-1]} bytes, the text has {len(raw)}")
        before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        marks = before[ends]
        starts[at : at + n], stops[at : at + n] = marks[:-1], marks[1:]
        at += n
    spans = pa.StructArray.from_arrays([pa.array(starts), pa.array(stops)], names=["s", "e"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), spans)


def windows(spans: DataFrame, by: str, size: int, foreign: int | None = None) -> DataFrame:
    """``spans(by, pos, s, e)`` in windows of ``size`` tokens: adds part, at (place in the window) and spans rebased to the window's first character.

    ``foreign`` caps the characters of a window that another tokenizer gets to
    see; ``capped`` marks tokens that begin beyond.
    """
    t = spans.withColumn("part", F.floor(F.col("pos") / size).cast("int")).withColumn("at", (F.col("pos") % size).cast("int"))
    w = Window.partitionBy(by, "part")
    base = F.min_by("s", "pos").over(w)
    t = t.withColumns({"s": F.greatest(F.col("s") - base, F.lit(0)), "e": F.greatest(F.col("e") - base, F.lit(0))})
    return t.withColumn("capped", F.lit(False) if foreign is None else F.col("s") >= foreign)


def local_indices(pieces: DataFrame, by: str, count: str) -> DataFrame:
    """``pieces(by, pos, s, e, count)``: the places of each piece's own tokens in the sequence of all pieces' tokens.

    ``count`` is how many tokens a second tokenizer makes of the piece alone;
    empty spans have none, and a count below zero is an error.
    """
    n = F.when(F.col("e") <= F.col("s"), 0).when(F.col(count) < 0, F.raise_error(F.lit("a piece has a negative number of tokens")).cast("int")).otherwise(F.col(count))
    before = Window.partitionBy(by).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    t = pieces.withColumn("_n", n.cast("long"))
    first = F.coalesce(F.sum("_n").over(before), F.lit(0))
    at = F.when(F.col("_n") > 0, F.sequence(first, first + F.col("_n") - 1)).otherwise(F.array().cast("array<bigint>"))
    return t.select(by, "pos", at.alias("indices"))


def inflation(compact: Column, standard: Column) -> Column:
    """Tokens of one tokenizer over those of another, as an aggregate; 1 without any."""
    return F.when(F.sum(standard) > 0, F.sum(compact) / F.sum(standard)).otherwise(1.0)


# ------------------------------------------------------------ values


def seeded_noise(seed: int, sigma: float):
    """A function of (values, key): Gaussian noise that depends on seed and key alone; rows of zeros stay zero."""

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.FloatType())))
    def noise(values: pa.Array, keys: pa.Array) -> pa.Array:
        out = []
        for v, k in zip(values, keys, strict=True):
            z = v.as_py()
            if z and sigma > 0:
                z = np.array(z, np.float32)
                rng = np.random.default_rng([seed & 0x7FFFFFFF, k.as_py() & 0xFFFFFFFFFFFFFFFF])
                z = np.where((z != 0).any(axis=1, keepdims=True), z + rng.normal(0.0, sigma, size=z.shape).astype(np.float32), z).tolist()
            out.append(z)
        return pa.array(out, pa.list_(pa.list_(pa.float32())))

    return noise


def zeros(n: Column, channels: int) -> Column:
    """``n`` rows of zeros."""
    return F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), channels), n.cast("int"))


def selected(values: Column, names: list[str], wanted: list[str]) -> Column:
    """The channels ``wanted`` of a row whose channels are ``names``, in their own order; an unknown one is an error."""
    at = {n: i for i, n in enumerate(names)}
    missing = [w for w in wanted if w not in at]
    if missing:
        raise ValueError(f"no channels {missing}")
    return F.array(*(F.element_at(values, at[w] + 1) for w in wanted))


def same_order(found: list[str], due: list[str]) -> list[str]:
    """``found`` if it equals ``due`` in order too; a permutation would weigh every channel wrongly."""
    if list(found) != list(due):
        raise ValueError(f"columns differ or come in another order: {found[:5]} against {due[:5]}")
    return found


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def rms(v: Column) -> Column:
    return F.sqrt(F.greatest(_dot(v, v) / F.size(v), F.lit(1e-8)))


def site(x: Column, a: Column, directions: list[list[float]], gate: float | list[float]) -> Column:
    """``x`` with activations ``a`` laid along ``directions`` (one a channel) at the loudness of the gate, in units of x's own rms.

    A gate per channel has the loudness of its rms and mixes the channels by its
    shape. A row of zeros leaves ``x`` exactly as it is.
    """
    if isinstance(gate, list):
        loud = math.sqrt(sum(g * g for g in gate) / len(gate))
        a = F.zip_with(a, F.array(*(F.lit(g / max(loud, 1e-8)) for g in gate)), lambda v, g: v * g)
    else:
        loud = float(gate)
    z = F.array(*(_dot(a, F.array(*(F.lit(float(d[j])) for d in directions))) for j in range(len(directions[0]))))
    scale = F.lit(loud) * rms(x) / rms(z)
    return F.zip_with(x, z, lambda u, v: u + scale * v)


def gates(channels: DataFrame, target: float, loudness: str | None = None, floor: float = 1e-3, docs: int | None = None, least_docs: int = 16) -> DataFrame:
    """``channels(channel, rms, nonzero)`` with ``gate``: in proportion to 1 / rms, or loudness / rms, of active channels, with rms ``target``.

    Active channels have an rms above ``floor``, fire at all and, with a
    loudness, have one above zero; the others get 0. Too few documents behind
    the figures, or no active channel, are errors.
    """
    if docs is not None and docs < least_docs:
        raise ValueError(f"{docs} documents are too few to fit gates")
    active = (F.col("rms") > floor) & (F.col("nonzero") > 0)
    weight = F.lit(1.0)
    if loudness:
        active, weight = active & (F.col(loudness) > 0), F.col(loudness)
    w = channels.withColumn("_w", F.when(active, weight / F.col("rms")).otherwise(0.0))
    total = w.agg(F.sqrt(F.avg(F.col("_w") * F.col("_w"))).alias("_wr"))
    loud = F.when(F.col("_wr") > 0, F.col("_wr")).otherwise(F.raise_error(F.lit("no active channels")).cast("double"))
    return w.crossJoin(F.broadcast(total)).withColumn("gate", F.col("_w") * (target / loud)).withColumn("active", active).drop("_w", "_wr")  # one row


def families(scores: DataFrame, concepts: DataFrame, key: list[str]) -> DataFrame:
    """``scores(key, pos, score)`` joined to ``concepts(pos, family, c, s)``: the two sums of each family's scores along its axes."""
    t = scores.join(F.broadcast(concepts), "pos")  # a row a concept
    return t.groupBy(*key, "family").agg(F.sum(F.col("score") * F.col("c")).alias("c"), F.sum(F.col("score") * F.col("s")).alias("s"))


#: Orders of families whose members go round in a circle (fixed values).
CYCLES = {
    "months": ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"],
    "weekdays": ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"],
    "seasons": ["spring", "summer", "autumn", "winter"],
    "directions": ["north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest"],
    "moon_phases": ["new_moon", "waxing_crescent", "first_quarter", "waxing_gibbous", "full_moon", "waning_gibbous", "last_quarter", "waning_crescent"],
    "color_wheel": ["red", "red-orange", "orange", "yellow", "yellow-green", "green", "blue-green", "blue", "violet"],
}


def family_axes(channels: list[str], families: dict[str, str], pca: dict[str, list[list[float]]] | None = None, cycles: dict[str, list[str]] = CYCLES) -> list[tuple[int, str, int, float]]:
    """The axes of structured activations as rows (place, name, channel, weight), families in name order.

    ``channels`` are the concepts in the order of the scores, ``families`` the family of each. A family of ``cycles`` has a cosine and a sine at the
    angles of its own order, one of ``pca`` an axis for each column of its saved matrix (a row a concept, in the order of the channels), any other an axis for each concept.
    """
    members: dict[str, list[str]] = {}
    for c in channels:
        members.setdefault(families[c], []).append(c)
    at, out, place = {c: k for k, c in enumerate(channels)}, [], 0
    for family in sorted(members):
        if family in cycles:
            order = cycles[family]
            if lost := [c for c in members[family] if c not in order]:
                raise ValueError(f"{lost} have no place among {family}")
            for name, turn in (("cos", math.cos), ("sin", math.sin)):
                out += [(place, f"{family}.{name}", at[c], turn(2 * math.pi * order.index(c) / len(order))) for c in members[family]]
                place += 1
        elif pca and family in pca:
            matrix = pca[family]
            if len(matrix) != len(members[family]):
                raise ValueError(f"the axes of {family} have {len(matrix)} rows for {len(members[family])} concepts")
            for k in range(len(matrix[0])):
                out += [(place, f"{family}.pc{k + 1}", at[c], float(row[k])) for c, row in zip(members[family], matrix, strict=True)]
                place += 1
        else:
            for c in members[family]:
                out.append((place, c, at[c], 1.0))
                place += 1
    return out


def structured(rows: DataFrame, key: list[str], scores: str, axes: list[tuple[int, str, int, float]]) -> DataFrame:
    """*key, place, name and value: each row's ``scores`` along all ``axes``, applied in one join with their table.

    Scores that are null count as 0, and so do channels that a row lacks; a null or empty row gives nothing.
    """
    table = rows.sparkSession.createDataFrame(axes, "place int, name string, channel int, weight double")
    t = rows.select(*key, F.posexplode(scores).alias("channel", "_score")).join(F.broadcast(table), "channel")  # a row a weight: channels by axes of one family
    return t.groupBy(*key, "place", "name").agg(F.sum(F.coalesce(F.col("_score").cast("double"), F.lit(0.0)) * F.col("weight")).alias("value"))


def lookup(ids: DataFrame, token: str, table: DataFrame, channels: int) -> DataFrame:
    """``ids`` with ``vector`` from ``table(token, vector)``; ids that the table does not place get zeros."""
    out = ids.join(table.select(F.col("token").alias(token), "vector"), token, "left")
    return out.withColumn("vector", F.coalesce("vector", F.array_repeat(F.lit(0.0), channels)))


def with_payload(places: DataFrame, docs: DataFrame) -> DataFrame:
    """Packed rows with ids and payload in lockstep: ``places`` of a packer, ``docs(doc_id, ids, values)`` -> rank, row, ids, values.

    A document's first row of values belongs to its first id; both are cut alike.
    """
    t = places.join(docs.select("doc_id", "ids", "values"), "doc_id")
    same = F.size("ids") == F.size("values")
    ids = F.when(same, F.slice("ids", F.lit(1), F.col("used"))).otherwise(F.raise_error(F.lit("ids and values differ in number")).cast(docs.schema["ids"].dataType))
    part = F.struct("start", ids.alias("ids"), F.slice("values", F.lit(1), F.col("used")).alias("values"))
    rows = t.groupBy("rank", "row").agg(F.array_sort(F.collect_list(part)).alias("p"))  # a row's documents
    return rows.select("rank", "row", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.flatten(F.transform("p", lambda x: x["values"])).alias("values"))


# ------------------------------------------------------------ tables of a store


def hash_index(spans: DataFrame, corpus: DataFrame) -> DataFrame:
    """``spans(shard, row, start, n)`` by content: joins ``corpus(shard, row, text)`` and gives doc_hash, shard, start, n.

    A span without its document is an error: the index would name other texts. A null text counts as empty.
    """
    t = spans.join(corpus.select("shard", "row", F.coalesce("text", F.lit("")).alias("text")), ["shard", "row"], "left")
    lost = F.raise_error(F.concat(F.lit("no document at row "), F.col("row"), F.lit(" of "), F.col("shard"))).cast("string")
    return t.select(content_hash(F.when(F.col("text").isNull(), lost).otherwise(F.col("text"))).alias("doc_hash"), "shard", "start", "n")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """One row of JSON, written beside its place and moved there, so that readers see the old or the new one."""
    fresh = f"{path}.new"
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(fresh)
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(jvm(path), True)
    if not fs.rename(jvm(fresh), jvm(path)):
        raise OSError(f"{path} could not be written")


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def unfinished(data: DataFrame, path: str) -> DataFrame:
    """The rows of shards that the store at ``path`` has not finished."""
    spark = data.sparkSession
    if not _exists(spark, f"{path}/done"):
        return data
    return data.join(F.broadcast(spark.read.parquet(f"{path}/done").select("shard").distinct()), "shard", "left_anti")  # a row a shard


def write_measures(n: Column, expected: Column, values: Column, limit: int = 127) -> dict[str, Column]:
    """What a sweep observes of its documents: their number and tokens, those whose count is not the expected one (``drift``), and of all values
    how many there are, are zero, and lie at ``limit`` or its negative (``clipped``). ``values`` is an array of numbers."""
    def held(of) -> Column:
        return F.coalesce(F.sum(F.size(F.filter(values, of))), F.lit(0)).cast("long")

    return {
        "documents": F.count(F.lit(1)), "tokens": F.coalesce(F.sum(n), F.lit(0)).cast("long"), "drift": F.count_if(~n.eqNullSafe(expected)),
        "values": held(lambda x: x.isNotNull()), "zero": held(lambda x: x == 0), "clipped": held(lambda x: F.abs(x.cast("long")) >= limit),
    }


def sweep(data: DataFrame, path: str, measures: dict[str, Column] | None = None) -> dict:
    """Write the shards that are not finished yet, then mark them as finished; gives what ``measures`` observed of the rows as they were written.

    A run that dies before the mark leaves no mark, so its shards are written
    again, over what it left; finished ones are not touched. Measures are taken in the pass
    that writes, without a scan of their own; where one named ``drift`` is not 0 the shards are not
    marked and the sweep is an error. No shard to write gives an empty result.
    """
    spark = data.sparkSession
    left = unfinished(data, path)
    shards = left.select("shard").distinct().collect()  # names of shards
    if not shards:
        return {}
    seen = Observation()
    if measures:
        left = left.observe(seen, *(c.alias(k) for k, c in measures.items()))
    left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(f"{path}/data")
    found = dict(seen.get) if measures else {}
    if found.get("drift"):
        raise ValueError(f"{found['drift']} documents of the shards {sorted(r['shard'] for r in shards)} have another number of tokens than was expected")
    spark.createDataFrame(shards, data.select("shard").schema).coalesce(1).write.mode("append").parquet(f"{path}/done")
    return found


def assemble(spark: SparkSession, path: str, expected: list[str], kind: str, **meta: object) -> dict:
    """Write the metadata of a store whose shards are all finished; the missing ones are an error."""
    done = {r["shard"] for r in spark.read.parquet(f"{path}/done").distinct().collect()} if _exists(spark, f"{path}/done") else set()
    missing = sorted(set(expected) - done)
    if missing:
        raise ValueError(f"shards {missing} are not finished")
    out = {"format": FORMAT, "kind": kind, "shards": sorted(expected), **meta}
    write_json(spark, f"{path}/meta", out)
    return out


def open_store(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The data and metadata of a store; another format or an unknown kind is an error. Filters on ``shard`` prune files."""
    meta = read_json(spark, f"{path}/meta")
    if meta.get("format") != FORMAT:
        raise ValueError(f"not a store of {FORMAT}: {meta.get('format')}")
    if meta.get("kind") not in KINDS:
        raise ValueError(f"unknown kind of store: {meta.get('kind')}")
    return spark.read.parquet(f"{path}/data"), meta


def preflight(docs: DataFrame, store: DataFrame) -> DataFrame:
    """Counters of ``docs(key, n, consumer_n, first)`` against ``store(key, n, zero_rows)``.

    ``n`` is the producer's count of tokens, ``consumer_n`` the consumer's and
    ``first`` whether its row begins as it has to.
    """
    s = store.select(F.col("key").alias("_k"), F.col("n").alias("_n"), "zero_rows")
    t = docs.where("first").join(s, (F.col("key") == F.col("_k")) & (F.col("consumer_n") == F.col("_n")), "left")
    full, hit, n = F.col("consumer_n") > 0, F.col("_k").isNotNull(), F.col("consumer_n")
    share = lambda a, b: F.coalesce(F.try_divide(a, b).cast("double"), F.lit(0.0))
    covered, held, total = F.count_if(full & hit), F.sum(F.when(full & hit, n).otherwise(0)), F.sum(F.when(full, n).otherwise(0))
    out = t.agg(
        F.count_if(full).alias("docs"), covered.alias("covered"), F.count_if(full & ~hit).alias("missing"), F.count_if(~full).alias("empty"), F.count_if(F.col("n") != n).alias("contract_mismatch"),
        share(covered, F.count_if(full)).alias("doc_coverage"), share(held, total).alias("token_coverage"), share(F.sum(F.when(full & hit, F.col("zero_rows")).otherwise(0)), held).alias("zero_row_share"),
    )
    bad = docs.agg(F.count_if(~F.col("first")).alias("bad_first"))
    return out.crossJoin(F.broadcast(bad)).withColumn("ok", (F.col("token_coverage") >= 0.999) & (F.col("contract_mismatch") == 0) & (F.col("bad_first") == 0))  # one row each

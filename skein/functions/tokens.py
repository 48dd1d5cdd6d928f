"""Encoding with public vocabularies in Arrow batches, byte lengths, masks."""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Special names in the order of their ids, behind the vocabulary (fixed values).
SPECIALS = ("<|bos|>", "<|user_start|>", "<|user_end|>", "<|assistant_start|>", "<|assistant_end|>", "<|python_start|>", "<|python_end|>", "<|output_start|>", "<|output_end|>")
BYTE_SPECIALS = {name: 256 + i for i, name in enumerate(SPECIALS)}
#: Bytes of texts or ids that a function of a batch has at hand at a time (a longer text is a part of its own).
PART_BYTES = 1 << 20
_CACHE: dict[tuple, object] = {}


def in_parts(run: Callable[[pa.Array], pa.Array], values: pa.Array) -> pa.Array:
    """``run`` over neighbouring texts, or lists of ids, of about ``PART_BYTES`` together, so that what it holds meanwhile is that of a part and not of a batch."""
    lists = pa.types.is_list(values.type) or pa.types.is_large_list(values.type)
    sizes = pc.multiply(pc.list_value_length(values), 4) if lists else pc.binary_length(values)
    part = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64) // PART_BYTES
    bounds = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(values)]
    return pa.concat_arrays([run(values[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)])


def encoding(path: str, pattern: str):
    """The encoding of a rank file, one per worker process."""
    if (path, pattern) not in _CACHE:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {s: len(ranks) + i for i, s in enumerate(SPECIALS)}
        _CACHE[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _CACHE[path, pattern]


def counter(paths: list[str], pattern: str):
    """A function of a text column that gives its number of ids under each vocabulary, without the ids; a null text has none."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def count(texts: pa.Array) -> pa.Array:
        encs = [encoding(p, pattern) for p in paths]
        counts = ([len(e.encode_to_numpy(t.as_py() or "", allowed_special=set(), disallowed_special=())) for e in encs] for t in texts)
        return pa.array(counts, pa.list_(pa.int32()))

    return count.asNondeterministic()  # or each use of the result would count again


def encoder(path: str, pattern: str, prepend: str | None = None, append: str | None = None):
    """A function of a text column that gives its ids; special strings in texts are ordinary text, a null text is empty."""

    def part(texts: pa.Array) -> pa.Array:
        enc = encoding(path, pattern)
        head = np.array([enc.encode_single_token(prepend)] if prepend else [], np.int32)
        tail = np.array([enc.encode_single_token(append)] if append else [], np.int32)
        parts, ends = [np.zeros(0, np.int32)], [0]
        for t in texts.to_pylist():
            body = enc.encode_to_numpy(t, allowed_special=set(), disallowed_special=()).view(np.int32) if t else head[:0]
            parts += [head, body, tail]
            ends.append(ends[-1] + len(head) + len(body) + len(tail))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        return in_parts(part, texts)

    return encode.asNondeterministic()  # or each use of the ids would encode again


def decoder(path: str, pattern: str):
    def part(ids: pa.Array) -> pa.Array:
        enc = encoding(path, pattern)
        flat, starts, lengths = ids.flatten().to_numpy(zero_copy_only=False), 0, pc.fill_null(pc.list_value_length(ids), 0).to_pylist()
        out = []
        for n, there in zip(lengths, ids.is_valid().to_pylist(), strict=True):
            out.append(enc.decode(flat[starts : starts + n].tolist()) if there else None)
            starts += n
        return pa.array(out, pa.string())

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        return in_parts(part, ids)

    return decode


def byte_lengths(spark: SparkSession, path: str, pattern: str, mode: str = "exact", zero_specials: bool = True) -> DataFrame:
    """token_id, n_bytes: 0 for special ids, or the bytes of their names where these are not zeroed. ``decoded`` measures the decoded string, where an incomplete character has three bytes."""
    enc = encoding(path, pattern)
    n = enc.n_vocab
    rows = []
    for i in range(n):
        if i >= n - len(SPECIALS):
            rows.append((i, 0 if zero_specials else len(SPECIALS[i - n + len(SPECIALS)])))
        else:
            raw = enc.decode_single_token_bytes(i)
            rows.append((i, len(raw) if mode == "exact" else len(raw.decode("utf-8", "replace").encode())))
    return spark.createDataFrame(rows, "token_id int, n_bytes int")


def special_ids(spark: SparkSession, first: int) -> DataFrame:
    """name, token_id of the special tokens behind a vocabulary of ``first`` ids."""
    return spark.createDataFrame([(name, first + k) for k, name in enumerate(SPECIALS)], "name string, token_id int")


def start_token(names: dict[str, int]) -> int:
    """The id that begins a document: the start mark's, or the end-of-text mark's where a vocabulary has none."""
    return names["<|bos|>"] if "<|bos|>" in names else names["<|endoftext|>"]


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def byte_ids(texts: pa.Array) -> pa.Array:
    """The byte-level vocabulary of tests: ids are UTF-8 bytes."""
    texts = texts.cast(pa.string())
    _, marks, data = texts.buffers()
    ends = np.frombuffer(marks, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return pa.ListArray.from_arrays(pa.array(ends - ends[0]), pa.array(raw.astype(np.int32)), mask=texts.is_null())


def encoded_lists(encode):
    """A function of a list of texts that gives the ids of all in order, each encoded alone; ``encode`` is one of this module's."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids_of(lists: pa.Array) -> pa.Array:
        one = encode.func(lists.flatten().cast(pa.string()))
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(one), 0).to_numpy(zero_copy_only=False))])
        at = ends[np.concatenate([[0], np.cumsum(sizes)])]
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), one.flatten(), mask=lists.is_null())

    return ids_of


#: Encoders by name: a function of the path of a rank file and its pattern, or of nothing for bytes.
ENCODERS = {"ranks": encoder, "bytes": lambda: byte_ids}


def render(turns: DataFrame, encode, special: dict[str, int], max_tokens: int = 2048) -> DataFrame:
    """``turns(conv_id, turn, role, text)``, validated, as ids and mask per conversation.

    A leading system turn joins the first user turn. Turns are encoded as rows
    of their own and put together in order, so a text is encoded once.
    """
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns.withColumn("_prev", F.lag("role").over(w)).withColumn("_before", F.lag("text").over(w))
    t = t.where("role <> 'system'").withColumn("text", F.when(F.col("_prev") == "system", F.concat("_before", F.lit("\n\n"), "text")).otherwise(F.col("text")))
    user = F.col("role") == "user"
    ids = encode(F.col("text"))
    start = F.when(user, special["<|user_start|>"]).otherwise(special["<|assistant_start|>"]).cast("int")
    end = F.when(user, special["<|user_end|>"]).otherwise(special["<|assistant_end|>"]).cast("int")
    t = t.select("conv_id", "turn", user.alias("user"), start.alias("start"), end.alias("end"), ids.alias("ids"))
    trained = F.when(F.col("user"), 0).otherwise(1).cast("int")
    seg = F.concat(F.array("start"), F.col("ids"), F.array("end"))
    mask = F.concat(F.array(F.lit(0)), F.array_repeat(trained, F.size("ids") + 1))
    parts = t.select("conv_id", F.struct("turn", seg.alias("ids"), mask.alias("mask")).alias("p"))
    held = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    bos = F.array(F.lit(special["<|bos|>"]))
    whole = F.concat(bos, F.flatten(F.transform("p", lambda x: x["ids"])))
    masks = F.concat(F.array(F.lit(0)), F.flatten(F.transform("p", lambda x: x["mask"])))
    return held.select("conv_id", F.slice(whole, 1, max_tokens).alias("ids"), F.slice(masks, 1, max_tokens).alias("mask"))


def completions(turns: DataFrame, encode, special: dict[str, int], max_tokens: int = 2048) -> DataFrame:
    """``turns`` without each conversation's last one, the assistant's, rendered as ids that end on the mark that begins a reply."""
    from pyspark.sql.window import Window

    last = F.max("turn").over(Window.partitionBy("conv_id"))
    kept = turns.withColumn("_last", last).where("turn < _last").drop("_last")
    return render(kept, encode, special, max_tokens).select("conv_id", F.concat("ids", F.array(F.lit(special["<|assistant_start|>"]))).alias("ids"))


def render_parts(turns: DataFrame, encode, special: dict[str, int], max_tokens: int = 2048) -> DataFrame:
    """``turns(conv_id, turn, role, parts)``, parts of type text, python or python_output, as ids and mask per conversation.

    Text and calls of the assistant are trained on, with the marks of a call;
    the output of calls, its marks and all of the user are not. Each part is
    encoded once, as a row of its own.
    """
    p = turns.select("conv_id", "turn", (F.col("role") == "user").alias("user"), F.posexplode("parts").alias("nth", "part"), F.size("parts").alias("of"))
    kind = F.col("part")["type"]
    known = F.when(kind.isin("text", "python", "python_output"), kind).otherwise(F.raise_error(F.concat(F.lit("unknown part: "), kind)).cast("string"))
    p = p.withColumn("kind", known).withColumn("ids", encode(F.col("part")["text"]))

    def mark(name: str) -> Column:
        return F.array(F.lit(special[name]))

    none = F.array().cast("array<int>")
    before = F.when(F.col("kind") == "python", mark("<|python_start|>")).when(F.col("kind") == "python_output", mark("<|output_start|>")).otherwise(none)
    after = F.when(F.col("kind") == "python", mark("<|python_end|>")).when(F.col("kind") == "python_output", mark("<|output_end|>")).otherwise(none)
    first = F.when(F.col("nth") > 0, none).when(F.col("user"), mark("<|user_start|>")).otherwise(mark("<|assistant_start|>"))
    last = F.when(F.col("nth") < F.col("of") - 1, none).when(F.col("user"), mark("<|user_end|>")).otherwise(mark("<|assistant_end|>"))
    body = F.concat(before, F.col("ids"), after)
    trained = F.when(F.col("user") | (F.col("kind") == "python_output"), 0).otherwise(1).cast("int")
    own = F.when(F.col("user"), 0).otherwise(1).cast("int")
    mask = F.concat(F.array_repeat(F.lit(0), F.size(first)), F.array_repeat(trained, F.size(body)), F.array_repeat(own, F.size(last)))
    parts = p.select("conv_id", F.struct("turn", "nth", F.concat(first, body, last).alias("ids"), mask.alias("mask")).alias("p"))
    held = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    whole = F.concat(mark("<|bos|>"), F.flatten(F.transform("p", lambda x: x["ids"])))
    masks = F.concat(F.array(F.lit(0)), F.flatten(F.transform("p", lambda x: x["mask"])))
    return held.select("conv_id", F.slice(whole, 1, max_tokens).alias("ids"), F.slice(masks, 1, max_tokens).alias("mask"))


def visualized(tokens: Column, mask: Column) -> Column:
    """Tokens in green where trained on and red elsewhere, joined by bars."""
    return F.array_join(F.zip_with(tokens, mask, lambda t, m: F.concat(F.when(m == 1, "\x1b[92m").otherwise("\x1b[91m"), t.cast("string"), F.lit("\x1b[0m"))), "|")

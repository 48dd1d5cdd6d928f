"""Files of conversations, one JSON list of messages a line, read strictly or with what is broken set aside.

Every line that is not blank is judged by the first rule it breaks. Types are
checked before anything is turned into text: a number is no content, and a line
that is no JSON (a key twice in one object and more than 16 MB included) is not
a null. Lines are numbered in their file from 1 without moving any text: blocks
of files are counted, and a line adds what the blocks before its own hold.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

MESSAGE = "array<struct<role:string,content:string>>"
#: Kinds of file: whether a system message may lead, and whether a text may be blank.
RULES = {"plain": (False, True), "dialogue": (True, True), "generated": (False, False)}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and value of each line of text files."""
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")]
    lines = spark.read.text(path).select("value", *at)
    blocks = lines.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # a row a block of a file
    from pyspark.sql.window import Window

    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "_block", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    line = F.col("_at") - F.col("_first") + F.col("_before") + 1
    return lines.join(blocks, ["file", "_block"]).select("file", line.alias("line"), "value")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _field(message: Column, name: str) -> Column:
    return F.try_variant_get(message, f"$.{name}", "variant")


def message_error(message: Column, i: Column, due: Column, blank: bool) -> Column:
    """The first rule that a message breaks, or null: an object, with a role and a content, the role that is due, a content that is text."""
    role, content = _field(message, "role"), _field(message, "content")
    said = lambda text: F.concat(F.lit("message "), i.cast("string"), F.lit(f" {text}"))
    out = F.when(~_kind(message).startswith("OBJECT"), said("is no object"))
    out = out.when(role.isNull(), said("has no role")).when(content.isNull(), said("has no content"))
    out = out.when((_kind(role) != "STRING") | (F.try_variant_get(role, "$", "string") != due), F.concat(said("is not of the "), due))
    out = out.when(_kind(content) != "STRING", said("has a content that is no text"))
    return out if blank else out.when(strip(F.try_variant_get(content, "$", "string")) == "", said("has a blank content"))


def judged(lines: DataFrame, rule: str = "plain") -> DataFrame:
    """``lines(value)`` with ``messages`` (null where a rule is broken) and ``error``, the first broken rule; blank lines go.

    ``plain``: a list of two messages or more, user and assistant in turn. ``dialogue``: a system message may come
    first. ``generated``: as plain, and no content of white space alone. Messages are numbered without the system message.
    """
    system, blank = RULES[rule]
    v = F.col("_json")
    items = F.try_variant_get(v, "$", "array<variant>")
    out = lines.where(strip(F.col("value")) != "").withColumn("_json", F.try_parse_json("value")).withColumn("_items", items)
    leads = (F.try_variant_get(F.get("_items", F.lit(0)), "$.role", "string") == "system") & (F.size("_items") > 0) if system else F.lit(False)
    out = out.withColumn("_lead", F.coalesce(leads, F.lit(False)).cast("int"))
    broken = F.transform("_items", lambda m, i: F.when(i >= F.col("_lead"), message_error(m, i - F.col("_lead"), F.when((i - F.col("_lead")) % 2 == 0, F.lit("user")).otherwise("assistant"), blank)))
    if system:  # what leads has to be text as well
        broken = F.transform(F.arrays_zip(broken.alias("e"), F.col("_items").alias("m")), lambda x, i: F.when(i < F.col("_lead"), F.when(F.coalesce(_kind(_field(x["m"], "content")) != "STRING", F.lit(True)), "the system message has no text")).otherwise(x["e"]))
    error = F.when(v.isNull(), "not JSON").when(F.col("_items").isNull() | ~_kind(v).startswith("ARRAY"), "not a list")
    error = error.when(F.size("_items") - F.col("_lead") < 2, "fewer than two messages").otherwise(F.get(F.filter(broken, lambda e: e.isNotNull()), F.lit(0)))
    text = lambda m, name: F.try_variant_get(m, f"$.{name}", "string").alias(name)
    messages = F.transform("_items", lambda m: F.struct(text(m, "role"), text(m, "content")))
    out = out.withColumn("error", error)
    return out.withColumn("messages", F.when(F.col("error").isNull(), messages)).drop("_json", "_items", "_lead")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines; a path that is not there is a warning and no lines."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    if not found:
        warnings.warn(f"{path} does not exist; there are no conversations", stacklevel=3)
        return spark.createDataFrame([], "file string, line long, value string")
    return numbered_lines(spark, path)


def read_conversations(spark: SparkSession, path: str, rule: str = "plain") -> DataFrame:
    """file, line and messages; a broken line ends the job with its file, line and rule."""
    rows = judged(_lines(spark, path), rule)
    stop = F.raise_error(F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(": "), "error")).cast(MESSAGE)
    return rows.select("file", "line", F.when(F.col("error").isNotNull(), stop).otherwise(F.col("messages")).alias("messages"))


def split_conversations(spark: SparkSession, path: str, rule: str = "plain") -> tuple[DataFrame, DataFrame]:
    """Good rows (file, line, messages) and those set aside (file, line, value, error); every line that is not blank is in exactly one."""
    rows = judged(_lines(spark, path), rule)
    return rows.where("error IS NULL").select("file", "line", "messages"), rows.where("error IS NOT NULL").select("file", "line", "value", "error")

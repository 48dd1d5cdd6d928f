"""Tables of odd rows for tests: nulls, empty texts, repeated ids, repeated rows, columns of clashing names; and tables without rows."""

from pyspark.sql import functions as F

LONG = "word " * 40_000


def odd_documents(spark):
    rows = [
        (0, None, "en", "src0", None), (1, "", "en", "src0", 0), (2, "a b c", "es", "src1", 5), (2, "another text of this id", "es", "src1", 23), (3, "a b c", "es", "src1", 5), (3, "a b c", "es", "src1", 5),
        (None, "no id at all", "de", "src2", 12), (4, "no source", "de", None, 9), (5, "no language", None, "src2", 11), (6, LONG, "fr", "src9", len(LONG)), (7, " \t\n ", "fr", "src9", 4), (8, "é🌍 ñ", "es", "src0", 4),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_row", F.lit(1)).withColumn("idx", F.lit("x"))


def odd_conversations(spark):
    rows = [(0, 0, "user", None), (0, 1, "assistant", ""), (1, 0, "assistant", "first"), (2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "assistant", "a"), (3, 0, "user", "u"), (3, 0, "user", "u"), (None, 0, "user", "x"), (4, None, None, None), (5, 0, "user", LONG), (5, 1, "assistant", "ok")]
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")


def odd_tables(spark, sf_dir, path):
    """Every table of ``sf_dir`` under ``path``: documents, conversations, labels and benchmark odd, the others as they are."""
    import os
    import shutil

    for name in os.listdir(sf_dir):
        if name.endswith(".parquet") and name.split(".")[0] not in ("documents", "conversations", "benchmark"):
            shutil.copy(f"{sf_dir}/{name}", f"{path}/{name}")
    odd_documents(spark).coalesce(2).write.parquet(f"{path}/documents.parquet")
    odd_conversations(spark).coalesce(2).write.parquet(f"{path}/conversations.parquet")
    bench = spark.createDataFrame([(0, "some words of a first item here"), (1, ""), (2, None), (3, "one"), (3, "the same id again it is"), (4, LONG)], "item_id long, text string")
    bench.coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def empty_tables(spark, sf_dir, path):
    import os

    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            spark.read.parquet(f"{sf_dir}/{name}").where("false").coalesce(1).write.parquet(f"{path}/{name}")
    return str(path)

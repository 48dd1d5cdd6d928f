"""Tool use as a stream: any cut into micro-batches, stops and restarts give the rows of the batch form."""

import random
import time

import pytest

from skein.functions.tokens import BYTE_SPECIALS as B
from skein.streaming import tools

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STORE)
    yield spark
    spark.conf.set(key, before)


def log_rows(seed=3):
    rng, rows = random.Random(seed), []
    for sample in range(6):
        tokens = list(b"let me see ")
        for _ in range(rng.randint(0, 3)):
            tokens += [B["<|python_start|>"], *rng.choice([b"2+3", b"12*7", b"oops", b"'strawberry'.count('r')", b""]), *([B["<|python_end|>"]] if rng.random() < 0.9 else []), *b" so"]
        tokens += [B["<|assistant_end|>"], *b"late"] if rng.random() < 0.7 else []
        rows += [(sample, step, t) for step, t in enumerate(tokens)]
    return rows


def run_over(spark, frames, out, mark, idle_ms=0):
    """Files of rows, one a micro-batch, with a restart between any two."""
    import shutil

    schema = "sample long, step long, token int"
    folder = f"{out}-in"
    for k, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        q = tools.stream_continued(log, idle_ms).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination(120)
        if q.exception():
            raise q.exception()
        if idle_ms and k == len(frames) - 1:
            time.sleep(idle_ms / 1000 + 1)
    shutil.rmtree(folder, ignore_errors=True)
    return sorted(tuple(r) for r in spark.read.parquet(out).select("sample", "place", "token", "mask").collect() if r["token"] is not None)


@pytest.mark.parametrize("cuts", [1, 3])
def test_any_cut(rocks, tmp_path, cuts):
    rows = log_rows()
    rng = random.Random(cuts)
    marks = {s: sorted(rng.randint(0, 60) for _ in range(cuts - 1)) for s in range(6)}
    frames = [[r for r in rows if sum(r[1] >= m for m in marks[r[0]]) == k] for k in range(cuts)]
    got = run_over(rocks, [f for f in frames if f], str(tmp_path / "o"), str(tmp_path / "c"))
    want = tools.continued(rocks.createDataFrame(rows, "sample long, step long, token int")).select("sample", "place", "token", "mask")
    assert got == sorted(map(tuple, want.collect()))


def test_late_steps_are_an_error(rocks, tmp_path):
    with pytest.raises(Exception, match="comes after step"):
        run_over(rocks, [[(1, 5, 65)], [(1, 4, 66)]], str(tmp_path / "o"), str(tmp_path / "c"))


def test_idle_samples_end(rocks, tmp_path):
    """A sample without an end mark ends by its timer, once."""
    schema, folder = "sample long, step long, token int", str(tmp_path / "in")
    rocks.createDataFrame([(1, 0, 65), (2, 0, B["<|assistant_end|>"])], schema).coalesce(1).write.parquet(folder)
    log = rocks.readStream.schema(schema).parquet(folder)
    q = tools.stream_continued(log, 500).writeStream.format("memory").queryName("idle_samples").outputMode("append").trigger(processingTime="300 milliseconds").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for _ in range(60):
            time.sleep(1)
            if rocks.table("idle_samples").count() >= 3:
                break
        time.sleep(2)
    finally:
        q.stop()
    assert sorted(map(tuple, rocks.table("idle_samples").collect()), key=str) == sorted([(1, 0, 65, 1), (1, 1, None, 0), (2, 0, B["<|assistant_end|>"], 1)], key=str)


def test_samples_across_batches(spark):
    """Samples that cross Arrow batches, of which many share one, are each what the state makes of them token by token."""
    rng = random.Random(5)
    some = [*b"2*31+,4 ", *B.values(), B["<|python_start|>"], B["<|python_end|>"], 300]
    logs = {s: [rng.choice(some) for _ in range(rng.choice((1, 3, 40, 400)))] for s in [None, *range(40)]}
    logs[7] = [65] * 30 + [B["<|python_start|>"], *b"2*21", B["<|python_end|>"], 66]  # no end mark
    rows = [(s, k, t) for s, log in logs.items() for k, t in enumerate(log)]
    want = []
    for s, log in logs.items():
        state, out = tools.ToolUse(), []
        for t in log:
            out += [(*x, state.done) for x in state.feed(t)]
        want += [(s, k, *x) for k, x in enumerate(out)]
    log = spark.createDataFrame(rows, "sample long, step long, token int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        got = [tuple(r) for r in tools.continued(log).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=str) == sorted(want, key=str)


def test_samples_are_no_groups_of_python(spark, sf_dir):
    """A sample is no call of Python: nine million short ones would take hours."""
    from skein.plans import store

    plan = store.tool_use(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan

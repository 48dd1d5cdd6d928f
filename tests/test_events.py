"""Events on disk: every batch once, whole characters, nothing of what failed."""

import json
import os

import pytest
from pyspark.sql import functions as F

from skein.streaming import events as E
from skein.streaming.state import stream_text

TEXTS = {1: "héllo 🌍 wörld", 2: "你好, ok", 3: "plain"}


@pytest.fixture(scope="module")
def live(spark, tmp_path_factory):
    """Pieces of one or two bytes, a file a micro-batch, which cut characters apart."""
    folder = tmp_path_factory.mktemp("pieces")
    pieces = [(s, i, t.encode()[i : i + 2]) for s, t in TEXTS.items() for i in range(0, len(t.encode()), 2)]
    for k in range(3):
        mine = [p for p in pieces if (p[1] // 8) % 3 == k]
        spark.createDataFrame(mine, "session long, ord long, piece binary").coalesce(1).write.parquet(str(folder / str(k)))
    schema = "session long, ord long, piece binary"

    def frame(numbers):
        flat = folder / f"flat-{'-'.join(map(str, numbers))}"
        flat.mkdir(exist_ok=True)
        for k in numbers:
            for f in (folder / str(k)).glob("*.parquet"):
                target = flat / f"{k}-{f.name}"
                if not target.exists():
                    target.write_bytes(f.read_bytes())
                    os.utime(target, (1_700_000_000 + k, 1_700_000_000 + k))  # a file stream takes older files first
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(flat))

    return frame


def texts_of(spark, path):
    said = {}
    for r in E.read_events(spark, path).collect():
        x = json.loads(r["value"])
        said.setdefault(x["session"], []).append(x["token"])
    return said


def test_texts_come_whole(spark, live, tmp_path):
    out = str(tmp_path / "o")
    q = E.write_events(stream_text(live([0, 1, 2])), out, str(tmp_path / "c"))
    assert q.awaitTermination(120)
    for session, parts in texts_of(spark, out).items():
        assert sorted("".join(parts)) == sorted(TEXTS[session]) and "�" not in "".join(parts)
    assert len([d for d in os.listdir(out) if d.startswith("batch=")]) >= 3


def test_a_batch_again_changes_nothing(tmp_path):
    """The commit of a batch that was committed before leaves its files and drops the new ones; an abort leaves nothing."""
    from pyspark.sql import Row

    w = E.EventWriter({"path": str(tmp_path)})
    rows = [Row(session=1, text="a", done=None), Row(session=1, text=None, done=True), Row(session=2, text="", done=None)]
    w.commit([w.write(iter(rows)), w.write(iter([]))], 4)
    before = {p: p.read_text() for p in (tmp_path / "batch=000000000004").iterdir()}
    assert list(before.values()) == ['data: {"token": "a", "session": 1}\n\ndata: {"done": true}\n\n']
    again = E.EventWriter({"path": str(tmp_path)})
    again.commit([again.write(iter(rows))], 4)
    assert {p: p.read_text() for p in (tmp_path / "batch=000000000004").iterdir()} == before
    again.abort([again.write(iter(rows)), None], 5)
    assert list((tmp_path / "_writing").iterdir()) == [] and not (tmp_path / "batch=000000000005").exists()


def test_failed_tasks_leave_no_event(spark, live, tmp_path):
    out, mark = str(tmp_path / "o"), str(tmp_path / "c")
    bad = F.when(F.col("session") == 3, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("text"))
    with pytest.raises(Exception, match="lost"):
        E.write_events(stream_text(live([0, 1])).withColumn("text", bad), out, mark).awaitTermination(120)
    assert not [d for d in (os.listdir(out) if os.path.exists(out) else []) if d.startswith("batch=")]
    q = E.write_events(stream_text(live([0, 1])), out, mark)  # the same batch, run again
    assert q.awaitTermination(120)
    assert {s: sorted("".join(p)) for s, p in texts_of(spark, out).items()}.keys() == TEXTS.keys()

"""The endless scan against a plain loop; stops, failures and restarts lose nothing and repeat nothing."""

import collections

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from skein.streaming import corpus as C


@pytest.fixture(scope="module")
def shards(tmp_path_factory, sf_dir):
    """Five shards of 1 to 7 row groups cut from the documents, one of them without rows."""
    path = tmp_path_factory.mktemp("shards")
    texts = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist()
    for k, groups in enumerate((4, 1, 7, 0, 3)):
        part = texts[k * 30 : k * 30 + groups * 5 - (groups > 1)]
        pq.write_table(pa.table({"more": list(range(len(part))), "text": pa.array(part, pa.string())}), path / f"shard_{k:05d}.parquet", row_group_size=5)
    (path / "notes.txt").write_text("no shard")
    return str(path)


def scan(path, rank, world, epochs, split="train", state=None):
    """(pq_idx, rg_idx, epoch, texts) of a reader, in order."""
    import glob

    files = sorted(glob.glob(f"{path}/*.parquet"))
    files = files[:-1] if split == "train" else files[-1:]
    epoch, first = (state["epoch"] if state else 1), True
    while epoch <= epochs:
        for k in range(state["pq_idx"] if state and first else 0, len(files)):
            f = pq.ParquetFile(files[k])
            start = (state["rg_idx"] // world + 1) * world + rank if state and first and k == state["pq_idx"] else rank
            for g in range(start, f.num_row_groups, world):
                yield k, g, epoch, f.read_row_group(g, columns=["text"])["text"].to_pylist()
        first, epoch = False, epoch + 1


def expected(*args, **kw):
    return [(k, g, e, i, t) for k, g, e, texts in scan(*args, **kw) for i, t in enumerate(texts)]


def drained(spark, frame, out, mark):
    q = frame.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return sorted(map(tuple, spark.read.parquet(out).select("pq_idx", "rg_idx", "epoch", "row", "text").collect()))


@pytest.mark.parametrize(("rank", "world", "split"), [(0, 1, "train"), (1, 3, "train"), (2, 3, "train"), (0, 2, "val")])
def test_scan_of_a_reader(spark, shards, tmp_path, rank, world, split):
    frame = C.stream_corpus(spark, shards, rank, world, split, groups_per_batch=2, epochs=2)
    assert drained(spark, frame, str(tmp_path / "o"), str(tmp_path / "c")) == sorted(expected(shards, rank, world, 2, split))


def test_state_of_a_loader(spark, shards, tmp_path):
    for n, state in enumerate(({"pq_idx": 0, "rg_idx": 2, "epoch": 1}, {"pq_idx": 2, "rg_idx": 6, "epoch": 2})):
        frame = C.stream_corpus(spark, shards, 0, 2, epochs=2, groups_per_batch=3, resume=state)
        assert drained(spark, frame, str(tmp_path / f"o{n}"), str(tmp_path / f"c{n}")) == sorted(expected(shards, 0, 2, 2, state=state))


def test_stops_and_restarts(spark, shards, tmp_path):
    """A query that fails in each of its batches, before or after the work, and is started again each time."""
    want = [(k, g, e) for k, g, e, texts in scan(shards, 0, 1, 2) if texts]
    done: dict[int, list] = {}
    failed: set[tuple[int, str]] = set()

    def work(batch, number):
        rows = batch.select("pq_idx", "rg_idx", "epoch").distinct().collect()
        for when in ("before", "after"):
            if when == "after":
                found = sorted(map(tuple, rows), key=lambda r: (r[2], r[0], r[1]))
                assert done.setdefault(number, found) == found  # a batch run again has the same groups
            if (number, when) not in failed and number % 2 == (when == "after"):
                failed.add((number, when))
                raise RuntimeError("lost")

    for _ in range(60):
        q = C.stream_corpus(spark, shards, groups_per_batch=3, epochs=2).writeStream.foreachBatch(work).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            q.processAllAvailable()
            break
        except Exception:  # noqa: BLE001, S112
            continue
        finally:
            q.stop()
    got = [g for n in sorted(done) for g in done[n]]
    assert got == want and len(failed) >= len(done) - 1 and max(collections.Counter(got).values()) == 1


def test_stopped_after_a_committed_batch(spark, shards, tmp_path):
    out, mark = str(tmp_path / "o"), str(tmp_path / "c")
    drained(spark, C.stream_corpus(spark, shards, groups_per_batch=4, epochs=1), out, mark)
    both = drained(spark, C.stream_corpus(spark, shards, groups_per_batch=4, epochs=3), out, mark)
    assert both == sorted(expected(shards, 0, 1, 3))


def test_nothing_to_read(spark, shards, tmp_path):
    with pytest.raises(ValueError, match="split"):
        C.stream_corpus(spark, shards, split="test")
    frame = C.stream_corpus(spark, shards, rank=9, world=10, epochs=3)
    q = frame.writeStream.format("memory").queryName("no_groups").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("no_groups").count() == 0

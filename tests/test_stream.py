"""The incremental scorer: each id once, over restarts and replays, at a cost that its history does not change."""

import glob
import json
import os

import pytest

from spendgrid.session import scratch_path
from spendgrid.streaming import cases as X


@pytest.fixture
def stream(spark):
    base = scratch_path(spark, "stream-test").replace("file:", "", 1)
    os.makedirs(f"{base}/in")
    hints = spark.createDataFrame([("fraud", 0, "hacked", ["password"])], "category string, cat_order int, hint string, extra array<string>")
    orders = spark.createDataFrame([("u1", "ord_1", 0, "Blue Shop", "active", 5)], "user_id string, order_id string, pos int, merchant string, status string, total int")
    inst = spark.createDataFrame([], "user_id string, order_id string, installment int, amount int, due_date date, status string")

    class Stream:
        out, ckpt = f"{base}/out", f"{base}/ckpt"

        def arrive(self, name, rows):
            with open(f"{base}/in/{name}.json", "w") as f:
                f.writelines(json.dumps({"id": i, "user_id": u, "question": q}) + "\n" for i, u, q in rows)

        def search(self, q):
            return q.selectExpr("qid", "'doc' AS doc")

        def run(self):
            query = X.start_cases(spark, f"{base}/in", self.out, self.ckpt, hints, orders, inst, self.search, X.CASE, max_files=1)
            query.awaitTermination()
            return [p for p in query.recentProgress if p["numInputRows"]]

        def rows(self):
            return sorted((r.id, r.question) for r in spark.read.parquet(self.out).collect())

    return Stream()


def test_once_over_restarts_and_copies(stream):
    stream.arrive("a", [("1", "u1", "I was hacked"), ("2", "u2", "b"), ("2", "u2", "a"), ("3", "u3", None)])
    stream.arrive("b", [("2", "u2", "late"), ("4", "u4", "x")])
    stream.run()
    stream.arrive("c", [("1", "u1", "again"), ("5", "u5", "new"), ("4", "u4", "again")])
    stream.run()
    assert [p["numInputRows"] for p in stream.run()] == []
    assert stream.rows() == [("1", "I was hacked"), ("2", "a"), ("3", None), ("4", "x"), ("5", "new")]


def test_a_batch_reads_nothing_of_what_was_written(stream):
    """The output of earlier batches is made unreadable; later batches still know its ids, and look up only their own."""
    stream.arrive("a", [(str(i), "u", f"q{i}") for i in range(500)])
    stream.run()
    for f in glob.glob(f"{stream.out}/batch_id=*/*.parquet"):
        with open(f, "wb") as broken:
            broken.write(b"no parquet")
    stream.arrive("b", [(str(i), "u", "again") for i in range(490, 505)])
    (progress,) = stream.run()
    state = progress["stateOperators"][0]
    assert state["numRowsTotal"] == 505 and state["numRowsUpdated"] == 5
    assert state["customMetrics"]["rocksdbGetCount"] <= 4 * 15
    new = glob.glob(f"{stream.out}/batch_id=1/*.parquet")
    import pyarrow.parquet as pq

    assert sorted(v for f in new for v in pq.read_table(f).column("id").to_pylist()) == ["500", "501", "502", "503", "504"]


def test_a_replayed_batch_gives_the_same_rows(stream):
    """A batch that failed after it was written runs again from the state before it."""
    stream.arrive("a", [("1", "u", "a"), ("2", "u", "b")])
    stream.run()
    stream.arrive("b", [("2", "u", "again"), ("3", "u", "c")])
    stream.run()
    os.remove(f"{stream.ckpt}/commits/1")  # as if the driver died between the write and the commit
    for f in glob.glob(f"{stream.ckpt}/commits/.1*"):
        os.remove(f)
    stream.run()
    assert stream.rows() == [("1", "a"), ("2", "b"), ("3", "c")]

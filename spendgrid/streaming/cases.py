"""Incremental case scorer (X1): new case files -> E4, J8, O7 and T6 columns -> append.

A file-source stream with a declared schema. Each id is kept once across restarts: a flag per id
lies in the query's state store, which is versioned with the checkpoint, so a micro-batch looks up
its own ids only and never reads what was written before. Of copies of an id inside one batch the
first stays, by file name, then text. The new cases are scored with the batch operators inside
``foreachBatch`` and written to their own ``batch_id=N`` folder with overwrite, so a replayed batch
is idempotent. ``trigger(availableNow=True)`` processes what is there and stops.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spendgrid.operators.support import classify_tickets, lookup_order, match_merchant, next_payment
from spendgrid.session import stored

CASE = "id string, user_id string, question string"
#: A store that looks up single keys and saves what a batch changed, not all of its state.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
OUTPUT = (
    "id string, user_id string, question string, forced_escalate boolean, category string, matched_phrase string, "
    "extra_required array<string>, order_id string, order_result string, next_due date, policy_doc string"
)


def score_cases(cases: DataFrame, hints: DataFrame, orders: DataFrame, installments: DataFrame,
                search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of one batch of ``cases(id, user_id, question)``: E4's decision; the order of a
    merchant that the question names (J9), looked up for its user (J8); the due date of the user's
    next payment (O7); the best policy document (T6). ``search`` takes ``(qid, text)`` queries and
    returns ``(qid, doc)``, one row a query at most."""
    e4 = classify_tickets(cases, hints)
    named = match_merchant(cases, orders)
    asked = cases.select("id", "user_id").join(named, "id")
    found = lookup_order(asked, orders).select("id", "order_id", F.col("result").alias("order_result"))
    due = next_payment(installments).select("user_id", F.col("due_date").alias("next_due"))
    hits = search(cases.select(F.col("id").alias("qid"), F.col("question").alias("text")))
    out = cases.join(e4, "id").join(found, "id", "left").join(due, "user_id", "left")
    out = out.join(hits.select(F.col("qid").alias("id"), F.col("doc").cast("string").alias("policy_doc")), "id", "left")
    return out.select(*[c.split()[0] for c in OUTPUT.split(", ")])


def _first_if_new(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first row of an id, by file, question and user (nulls first), if no batch before had the id."""
    if state.exists:
        return
    state.update((True,))
    order = lambda r: [(v is not None, v or "") for v in r]
    rows = (r for f in frames for r in f[["_file", "question", "user_id"]].itertuples(index=False))
    _, question, user = min(rows, key=order)
    yield pd.DataFrame({"id": [key[0]], "user_id": [user], "question": [question]})


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Session settings for the time a query is started; it keeps those it started with."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start_cases(spark: SparkSession, src: str, out: str, ckpt: str, hints: DataFrame, orders: DataFrame, installments: DataFrame,
                search: Callable[[DataFrame], DataFrame], schema: str, max_files: int = 1000) -> StreamingQuery:
    """The running query of X1; ``max_files`` only paces micro-batches: every file is processed."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(src)
    stream = stream.select("id", "user_id", "question", F.col("_metadata.file_path").alias("_file"))
    new = stream.groupBy("id").applyInPandasWithState(_first_if_new, CASE, "seen boolean", "append", GroupStateTimeout.NoTimeout)

    def score(batch: DataFrame, batch_id: int) -> None:
        cases = stored(batch, "stream-batch")
        scored = score_cases(cases, hints, orders, installments, search)
        scored.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = new.writeStream.foreachBatch(score).option("checkpointLocation", ckpt).trigger(availableNow=True)
    with _settings(spark, STORE):
        return writer.start()


def stream_cases(spark: SparkSession, src: str, out: str, ckpt: str, hints: DataFrame, orders: DataFrame, installments: DataFrame,
                 search: Callable[[DataFrame], DataFrame], schema: str, max_files: int = 1000) -> DataFrame:
    """Process the case files below ``src`` that the checkpoint has not seen; returns the whole output."""
    start_cases(spark, src, out, ckpt, hints, orders, installments, search, schema, max_files).awaitTermination()
    return spark.read.schema(f"{OUTPUT}, batch_id bigint").parquet(out)

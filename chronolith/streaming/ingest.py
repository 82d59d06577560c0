"""Stateful ingest: submissions stream in, retries are classified, fresh ones get sequences and are committed.

State lives by store: a store has one order of commits, and stores spread over tasks. It is bounded by the retry tiers and the number of
series with a latest value. Every micro-batch is one group commit: rows first, then one commit row that names the batch; readers trust
rows of committed batches only, so a batch that failed half-way and ran again counts once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronolith.operators.retry import RetryTiers

SUBMISSION = "store long, n long, series long, key string, content string, epoch long, position long, value double"
OUTCOME = "store long, n long, series long, outcome string, seq long, epoch long, position long, value double, published string"


class Latest:
    """Latest position of each series: advances, ignores older ones, faults on equal positions with other contents."""

    def __init__(self, most: int):
        self.most, self.held = most, {}

    def publish(self, series: int, epoch: int | None, position: int | None, content: str) -> str:
        if position is None or pd.isna(position):
            return "unpositioned"
        at = (int(epoch), int(position))
        if series not in self.held:
            if len(self.held) >= self.most:
                return "fault:capacity"
            self.held[series] = (at, content)
            return "first"
        known, what = self.held[series]
        if at == known:
            return "ignored" if what == content else "fault:conflict"
        if at < known:
            return "ignored"
        self.held[series] = (at, content)
        return "advanced"


def _step(replay: int, guard: int, most_latest: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tiers, latest = pickle.loads(state.get[0]) if state.exists else (RetryTiers(replay, guard), Latest(most_latest))
        rows = pd.concat(list(batches)).sort_values("n", kind="stable")
        out = []
        for r in rows.itertuples():
            outcome, seq = tiers.submit((r.series, r.key), r.content)
            published = latest.publish(r.series, r.epoch, r.position, r.content) if outcome == "accepted" else "none"
            out.append((r.store, r.n, r.series, outcome, seq, r.epoch, r.position, r.value, published))
        state.update((pickle.dumps((tiers, latest)),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOME.split(", ")])

    return run


def outcomes(submissions: DataFrame, replay: int = 256, guard: int = 256, most_latest: int = 16) -> DataFrame:
    """A streaming DataFrame of outcomes; within a micro-batch a store's submissions are taken in the order of n."""
    return submissions.groupBy("store").applyInPandasWithState(_step(replay, guard, most_latest), OUTCOME, "state binary", "append", GroupStateTimeout.NoTimeout)


def ingest(submissions: DataFrame, out: str, checkpoint: str, **options):
    """Start the query that commits outcomes under `out`: admissions by batch, then the commit row."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            batch.write.mode("overwrite").parquet(f"{out}/admissions/batch={batch_id}")
            summary = batch.agg(F.lit(batch_id).cast("long").alias("batch"), F.count("*").alias("n"), F.coalesce(F.sum((F.col("outcome") == "accepted").cast("long")), F.lit(0)).alias("accepted"))
            summary.write.mode("overwrite").parquet(f"{out}/commits/id={batch_id}")
        finally:
            batch.unpersist()

    return outcomes(submissions, **options).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).outputMode("append").start()


def committed(spark: SparkSession, out: str) -> DataFrame:
    """Admissions of committed batches."""
    commits = spark.read.parquet(f"{out}/commits").select("batch")
    return spark.read.parquet(f"{out}/admissions").join(commits, "batch", "left_semi")

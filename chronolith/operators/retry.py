"""Retry identity: classification of pairs, FIFO tiers, and the full state machine over submissions."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def classify(a: str, b: str) -> Column:
    """distinct, equivalent or conflict, of struct columns with scope, key and content; nulls equal each other and nothing else."""

    def same(field: str) -> Column:
        return F.col(f"{a}.{field}").eqNullSafe(F.col(f"{b}.{field}"))

    return F.when(~(same("scope") & same("key")), "distinct").when(same("content"), "equivalent").otherwise("conflict")


def byte_ceiling(priority: Column, total: int, protected: int, normal: int) -> Column:
    """Bytes that may be outstanding when a command of this priority is admitted."""
    return F.when(priority == "protected", total).when(priority == "normal", total - protected).otherwise(total - protected - normal)


def tiers(accepted: DataFrame, totals: DataFrame, replay: int, guard: int) -> DataFrame:
    """Tier of each accepted key: the newest `replay` of its store, then `guard`, then fresh again.

    Sequences are contiguous inside a store, so a key's age is the store's last sequence less its own: no sort or window."""
    age = F.col("last") - F.col("store_seq")
    return accepted.join(totals, "store").withColumn("tier", F.when(age < replay, "replay").when(age < replay + guard, "guard").otherwise("fresh"))


def coalesce(submissions: DataFrame, outstanding: list[str]) -> DataFrame:
    """Disposition of submissions (n, scope, key, content) that are outstanding together, which the given columns say.

    The first of a scope and key is queued; a later one of the same content shares its receipt, of another content it conflicts and has
    none. What is outstanding together is bounded by the queue, and so is the window."""
    w = W.partitionBy(*outstanding, "scope", "key").orderBy("n")
    first, content = F.first("n").over(w), F.first("content").over(w)
    d = F.when(F.col("n") == first, "queued").when(F.col("content").eqNullSafe(content), "coalesced").otherwise("conflict")
    return submissions.withColumns({"disposition": d, "receipt": F.when(d != "conflict", first)})


class RetryTiers:
    """Replay and guard tiers of one store; hits never refresh an entry."""

    def __init__(self, replay: int, guard: int):
        self.sizes = (replay, guard)
        self.replay: OrderedDict[tuple, tuple] = OrderedDict()
        self.guard: OrderedDict[tuple, str] = OrderedDict()
        self.next = 1

    def submit(self, key: tuple, content: str) -> tuple[str, int]:
        """(outcome, sequence): the original commit's for a replay, a new one if accepted, else 0."""
        if key in self.replay:
            known, seq = self.replay[key]
            return ("replayed", seq) if known == content else ("conflict", 0)
        if key in self.guard:
            return ("expired", 0) if self.guard[key] == content else ("conflict", 0)
        seq, self.next = self.next, self.next + 1
        self.replay[key] = (content, seq)
        if len(self.replay) > self.sizes[0]:
            old, (known, _) = self.replay.popitem(last=False)
            self.guard[old] = known
            if len(self.guard) > self.sizes[1]:
                self.guard.popitem(last=False)
        return "accepted", seq


def run_submissions(submissions: DataFrame, replay: int, guard: int) -> DataFrame:
    """Outcome of each submission (store, n, scope, key, content) in the order n of its store; state is bounded by the tiers."""
    schema = StructType([*submissions.schema]).add("outcome", "string").add("seq", "long")
    names = submissions.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, state = object(), None
        for b in batches:
            out = []
            for s, *key, content in zip(*(b.column(names.index(c)).to_pylist() for c in ("store", "scope", "key", "content"))):
                if s != store:
                    store, state = s, RetryTiers(replay, guard)
                out.append(state.submit(tuple(key), content))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64())], schema.names)

    return submissions.repartition("store").sortWithinPartitions("store", "n").mapInArrow(run, schema)


def transition_faults(submissions: DataFrame, claimed: DataFrame, replay: int, guard: int) -> DataFrame:
    """(store, n): submissions whose claimed outcome (store, n, outcome, seq) isn't the one that the laws give, or is absent."""
    c = claimed.select("store", "n", F.struct("outcome", "seq").alias("_claimed"))
    real = run_submissions(submissions, replay, guard).withColumn("_real", F.struct("outcome", "seq"))
    return real.join(c, ["store", "n"], "left").where(~F.col("_real").eqNullSafe(F.col("_claimed"))).select("store", "n")

"""The registry of series: register, revise, retire as a fold over each series' requests; binding checks; read views.

A request changes one series only, so series are folded apart and in parallel. Capacity is the one law across series; as neither
series nor revisions are ever given back, it is two points in the order of requests, which `run_within` finds first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class History:
    """One series: its revisions (payload, evidence) and its retirement."""

    def __init__(self) -> None:
        self.binding: str | None = None
        self.revisions: list[tuple[str, str]] = []
        self.retired: tuple[int, str] | None = None

    def apply(self, op: str, binding: str, expected: int, payload: str, evidence: str, full: bool = False, frozen: bool = False) -> tuple[str, int]:
        """(outcome, revision). full: the registry takes no more series; frozen: no more revisions."""
        n = len(self.revisions)
        if op == "register":
            if self.retired:
                return "SeriesRetired", 0
            if n:
                same = n == 1 and self.binding == binding and self.revisions[0] == (payload, evidence)
                return ("replayed", 1) if same else ("SeriesAlreadyRegistered", 0)
            if full:
                return "RegistrySeriesCapacityExceeded", 0
            if frozen:
                return "RegistryRevisionCapacityExceeded", 0
            self.binding = binding
            self.revisions.append((payload, evidence))
            return "registered", 1
        if not n:
            return "SeriesNotFound", 0
        if op == "revise":
            if self.retired:
                return "SeriesRetired", 0
            if n > 1 and expected == n - 1 and self.revisions[-1] == (payload, evidence):
                return "replayed", n
            if expected != n:
                return "StaleDeclarationRevision", 0
            if self.revisions[-1][0] == payload:
                return "DeclarationUnchanged", 0
            if frozen:
                return "RegistryRevisionCapacityExceeded", 0
            self.revisions.append((payload, evidence))
            return "revised", n + 1
        if self.retired:
            return ("replayed", n) if self.retired == (expected, evidence) else ("SeriesRetired", 0)
        if expected != n:
            return "StaleDeclarationRevision", 0
        self.retired = (expected, evidence)
        return "retired", n


def run_requests(requests: DataFrame, full_after: int | None = None, frozen_after: int | None = None) -> DataFrame:
    """Outcome and revision of each request (series, n, op, binding, expected, payload, evidence).

    After request full_after no series is added, after frozen_after no revision; None: never."""
    schema = StructType([*requests.schema]).add("outcome", "string").add("revision", "long")
    names = requests.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series, state = object(), None
        for b in batches:
            out = []
            for s, n, *args in zip(*(b.column(names.index(c)).to_pylist() for c in ("series", "n", "op", "binding", "expected", "payload", "evidence"))):
                if s != series:
                    series, state = s, History()
                full = full_after is not None and n > full_after
                frozen = frozen_after is not None and n > frozen_after
                out.append(state.apply(*args, full=full, frozen=frozen))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64())], schema.names)

    return requests.repartition("series").sortWithinPartitions("series", "n").mapInArrow(run, schema)


def _nth(rows: DataFrame, k: int) -> int | None:
    """The k-th smallest n, None if there are fewer rows; for k = 0 what is before all."""
    if k == 0:
        return -(2**63)
    row = rows.select("n").orderBy("n").offset(k - 1).first()
    return row["n"] if row else None


def run_within(requests: DataFrame, most_series: int, most_revisions: int) -> DataFrame:
    """run_requests in a registry that holds most_series series and most_revisions revisions over all of them.

    A series' first request to register succeeds while there is room, so the registry is full after the most_series-th of these; it is
    frozen after the most_revisions-th declaration that is accepted without that limit. Two numbers reach the driver."""
    firsts = requests.where("op = 'register'").groupBy("series").agg(F.min("n").alias("n"))
    full = _nth(firsts, most_series)
    declared = F.col("outcome").isin("registered", "revised")
    frozen = _nth(run_requests(requests, full).where(declared), most_revisions)
    if full is not None and frozen is not None and full > frozen:
        full = None
    return run_requests(requests, full, frozen)


def snapshot(outcomes: DataFrame) -> DataFrame:
    """series, revisions, latest payload, retired: from accepted requests."""
    done = outcomes.where(F.col("outcome").isin("registered", "revised", "retired"))
    declared = F.col("outcome") != "retired"
    return done.groupBy("series").agg(F.sum(declared.cast("long")).alias("revisions"), F.max_by(F.when(declared, F.col("payload")), F.when(declared, F.col("n"))).alias("payload"), F.max(~declared).alias("retired"))


def bind(envelopes: DataFrame, registry: DataFrame) -> DataFrame:
    """Refusal of each envelope (seq, series, mode, kind) against the latest declarations; null if it binds."""
    e = envelopes.join(registry.withColumnsRenamed({"mode": "_mode", "family": "_family"}), "series", "left")
    refusal = (
        F.when(F.col("_mode").isNull(), "SeriesNotFound")
        .when(F.col("retired"), "SeriesRetired")
        .when(F.col("mode") != F.col("_mode"), "SeriesMetadataMismatch")
        .when((F.col("kind") != F.col("_family")) & (F.col("kind") != "unavailable"), "ObservationValueFamilyMismatch")
    )
    return e.select("seq", "series", refusal.alias("refusal"))


def counts(declarations: DataFrame) -> DataFrame:
    return declarations.agg(F.count_distinct("series").alias("series_count"), F.count("*").alias("revision_count"))


def latest_declarations(declarations: DataFrame) -> DataFrame:
    return declarations.groupBy("series").agg(F.max("revision").alias("revision"), F.max_by("payload", "revision").alias("payload"))


def chain(claimed: DataFrame) -> DataFrame:
    """(series, n, revision) with violation: a series begins with revision 1, and each revision is the one before plus 1, in order of n."""
    before = F.lag("revision").over(W.partitionBy("series").orderBy("n"))
    violation = F.when(before.isNull() & (F.col("revision") != 1), "BadFirst").when(F.col("revision") != before + 1, "RevisionGap")
    return claimed.withColumn("violation", violation)


def history(declarations: DataFrame) -> DataFrame:
    """(series, history): all revisions of a series with their payloads, in order; a series has few."""
    return declarations.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("revision", "payload"))).alias("history"))

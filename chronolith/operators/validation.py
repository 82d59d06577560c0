"""First-refusal validation of envelopes: one column, the checks in their fixed order.

Envelopes are rows with arrays `observations` (id, position struct or null, interval struct or null) and `gaps`
(epoch, start, end). Bounds are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pairs(items: Column, test) -> Column:
    """Whether some neighbours fail the test."""
    n = F.size(items)
    return F.when(n > 1, F.exists(F.arrays_zip(F.slice(items, F.lit(1), n - 1).alias("a"), F.slice(items, F.lit(2), n - 1).alias("b")), lambda p: test(p["a"], p["b"]))).otherwise(False)


def _first(items: Column, verdict) -> Column:
    """The first verdict that isn't null."""
    return F.get(F.filter(F.transform(items, verdict), lambda v: v.isNotNull()), F.lit(0))


def envelope_violation(mode: Column, observations: Column, gaps: Column, most_observations: int = 256, most_gaps: int = 64) -> Column:
    ids = F.transform(observations, lambda o: o["id"])
    n = F.size(observations)

    def each(o: Column, k: Column) -> Column:
        return (
            F.when((mode == "interval") & o["interval"].isNull(), "MissingObservationInterval")
            .when((mode != "interval") & o["interval"].isNotNull(), "UnexpectedObservationInterval")
            .when(F.array_position(ids, o["id"]) <= k, "DuplicateObservationId")
        )

    def gap_pair(a: Column, b: Column) -> Column:
        back = (b["epoch"] < a["epoch"]) | ((b["epoch"] == a["epoch"]) & (b["start"] < a["start"]))
        return F.when(back, "MisorderedGaps").when((b["epoch"] == a["epoch"]) & (b["start"] < a["end"]), "OverlappingGaps")

    first_has = F.get(observations, F.lit(0))["position"].isNotNull()
    mixed = F.exists(observations, lambda o: o["position"].isNotNull() != first_has)
    g = F.size(gaps)
    neighbours = F.when(g > 1, F.arrays_zip(F.slice(gaps, F.lit(1), g - 1).alias("a"), F.slice(gaps, F.lit(2), g - 1).alias("b")))
    inside = F.exists(observations, lambda o: F.exists(gaps, lambda x: (x["epoch"] == o["position"]["epoch"]) & (o["position"]["sequence"] >= x["start"]) & (o["position"]["sequence"] < x["end"])))
    return F.coalesce(
        F.when(n > most_observations, "TooManyObservations"),
        F.when(g > most_gaps, "TooManyGaps"),
        F.when((n == 0) & (g == 0), "EmptyObservedEvidence"),
        _first(observations, each),
        F.when((n > 0) & mixed, "MixedProducerPositions"),
        F.when((n > 0) & first_has & _pairs(observations, lambda a, b: a["position"] >= b["position"]), "MisorderedProducerPositions"),
        _first(neighbours, lambda p: gap_pair(p["a"], p["b"])),
        F.when((n > 0) & first_has & inside, "ObservationInsideGap"),
    )


def lifecycle_violation(started: Column, completed: Column, links: list[tuple[Column, Column, str]]) -> Column:
    """Completion before start, then the first link (child's parent, parent's id, name) that is broken."""
    return F.coalesce(F.when(completed < started, "CaptureRunEndsBeforeStart"), *(F.when(~a.eqNullSafe(b), name) for a, b, name in links))


def unique_ids(*ids: Column) -> Column:
    """Whether all ids of the given arrays and scalars differ."""
    every = F.concat(*ids)
    return F.size(F.array_distinct(every)) == F.size(every)


def gap_refusal(start: Column, end: Column) -> Column:
    """A gap is half-open and holds something."""
    return F.when(start >= end, "EmptyGap")

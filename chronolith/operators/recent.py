"""The bounded recent-first query, for one series and for all."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_RESULTS = 16


def check_limit(limit: int, most: int = MOST_RESULTS) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= most:
        raise ValueError(f"limit must be 1 to {most}")
    return limit


def within(t: Column, start: datetime | None, end: datetime | None) -> Column:
    """Half-open interval; None is no bound. An interval must hold some time."""
    if start is not None and end is not None and start >= end:
        raise ValueError("the interval is empty")
    out = F.lit(True)
    if start is not None:
        out = out & (t >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out & (t < F.lit(end).cast("timestamp_ntz"))
    return out


def recency(obs: DataFrame) -> list[Column]:
    """Newest effective time, receive time, id and append sequence first; then the ordinal upwards."""
    return [F.col(c).desc() for c in ("effective", "receive", "id", "seq") if c in obs.columns] + [F.col(c) for c in ("ordinal",) if c in obs.columns]


def recent(obs: DataFrame, series, limit: int, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """The newest `limit` observations of a series; an unknown series has none."""
    check_limit(limit)
    found = obs.where((F.col("series") == F.lit(series)) & within(F.col("effective"), start, end))
    return found.orderBy(*recency(obs)).limit(limit)


def recent_with_evidence(obs: DataFrame, series, limit: int, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """One row: series, returned, is_truncated. Only limit + 1 matches leave the scan's tasks."""
    found = obs.where((F.col("series") == F.lit(series)) & within(F.col("effective"), start, end)).select("series").limit(check_limit(limit) + 1)
    return found.agg(F.count("*").alias("n")).select(F.lit(series).cast("long").alias("series"), F.least(F.col("n"), F.lit(limit)).alias("returned"), (F.col("n") > limit).alias("is_truncated"))


def recent_of_each(obs: DataFrame, limit: int) -> DataFrame:
    """The newest `limit` observations of every series, with their rank; map tasks keep no more of a series than that."""
    rank = F.row_number().over(W.partitionBy("series").orderBy(*recency(obs)))
    return obs.withColumn("rank", rank).where(F.col("rank") <= check_limit(limit))


def late_decoded(index: DataFrame, payloads: DataFrame, series, limit: int) -> DataFrame:
    """Pick on narrow index rows first, then fetch the few payloads by append sequence."""
    top = recent(index, series, limit)
    return top.join(payloads, "seq")

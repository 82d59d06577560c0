"""Latest value of each series by producer position, and the conflicts that must stop publication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(obs: DataFrame, position: list[str]) -> DataFrame:
    """The row with the greatest position of each series; partial maxima on the map side, no sort."""
    row = F.struct(*[F.col(c) for c in obs.columns])
    return obs.where(F.col(position[0]).isNotNull()).groupBy("series").agg(F.max_by(row, F.struct(*position)).alias("r")).select("r.*")


def conflicts(obs: DataFrame, position: list[str], content: list[str]) -> DataFrame:
    """Positions of a series that carry more than one content."""
    c = F.struct(*content)
    return obs.where(F.col(position[0]).isNotNull()).groupBy("series", *position).agg(F.min(c).alias("lo"), F.max(c).alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("series", *position, "n")

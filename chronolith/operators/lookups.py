"""Lookups: declarations of a revision, undeclared frames, positions inside gaps, lineage links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def resolve(frames: DataFrame, declarations: DataFrame) -> DataFrame:
    """Each frame with the declaration of exactly its series and revision; null fields where there is none."""
    return frames.join(declarations, ["series", "revision"], "left")


def declared(frames: DataFrame, declarations: DataFrame, fields: list[str]) -> DataFrame:
    """Frames whose declaration equals the historical one in all fields, nulls included."""
    f, d = frames.alias("f"), declarations.alias("d")
    same = (F.col("f.series") == F.col("d.series")) & (F.col("f.revision") == F.col("d.revision"))
    for c in fields:
        same = same & F.col(f"f.{c}").eqNullSafe(F.col(f"d.{c}"))
    return f.join(d, same, "left_semi")


def undeclared(frames: DataFrame, declarations: DataFrame) -> DataFrame:
    return frames.join(declarations, ["series", "revision"], "left_anti")


def inside_gap(positions: DataFrame, gaps: DataFrame, keys: list[str]) -> DataFrame:
    """Positions that fall into a gap [start, end) of the same keys. Gaps don't overlap, so only the last one that starts at or
    before a position can hold it: an as-of join by one sorted pass over both, without a range join's candidates."""
    p = positions.select(*keys, F.col("position"), F.lit(None).cast("long").alias("gap_end"), F.lit(1).alias("kind"), *[c for c in positions.columns if c not in (*keys, "position")])
    extra = [F.lit(None).cast(positions.schema[c].dataType).alias(c) for c in positions.columns if c not in (*keys, "position")]
    g = gaps.select(*keys, F.col("gap_start").alias("position"), "gap_end", F.lit(0).alias("kind"), *extra)
    so_far = W.partitionBy(*keys).orderBy("position", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    start = F.last(F.when(F.col("kind") == 0, F.col("position")), ignorenulls=True).over(so_far)
    end = F.last("gap_end", ignorenulls=True).over(so_far)
    both = p.unionByName(g).withColumns({"gap_start": start, "gap_end": end})
    return both.where((F.col("kind") == 1) & (F.col("position") < F.col("gap_end"))).drop("kind")


def lineage_links(frames: DataFrame) -> DataFrame:
    """seq, ordinal, links_ok from arrays `observations` (ids) and `lineage` (ordinal, observation id, raw id, normalized raw id): zipped by
    position, all links must agree."""
    z = frames.select("seq", F.posexplode_outer(F.arrays_zip("observations", "lineage")).alias("ordinal", "z"))
    link = F.col("z.lineage")
    ok = (link["ordinal"] == F.col("ordinal")) & (link["observation"] == F.col("z.observations")) & (link["normalized_raw"] == link["raw"])
    return z.where("ordinal IS NOT NULL").select("seq", F.col("ordinal").cast("long").alias("ordinal"), F.coalesce(ok, F.lit(False)).alias("links_ok"))

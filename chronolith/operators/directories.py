"""Directories of a sealed generation: by series, by append order, by recency; its layout and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Bytes of the segment's header, series, append and observation entries and its checksum
HEADER, SERIES_ENTRY, APPEND_ENTRY, OBSERVATION_ENTRY, CHECKSUM = 192, 64, 48, 96, 4


def series_directory(frames: DataFrame) -> DataFrame:
    return frames.groupBy("series").agg(F.count("*").alias("frame_count"), F.sum("n_obs").alias("observation_count"), F.sum("len").alias("block_length"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def append_directory(frames: DataFrame) -> DataFrame:
    """seq, series, ordinal of the frame in its series and its offset in the series' block."""
    w = W.partitionBy("series").orderBy("seq")
    before = F.sum("len").over(w.rowsBetween(W.unboundedPreceding, -1))
    return frames.select("seq", "series", (F.row_number().over(w) - 1).cast("long").alias("frame_ordinal"), F.coalesce(before, F.lit(0)).cast("long").alias("frame_offset"))


def block_offsets(directory: DataFrame) -> DataFrame:
    """Where each series' block starts; a window over the directory, which has a row a series."""
    before = F.sum("block_length").over(W.orderBy("series").rowsBetween(W.unboundedPreceding, -1))
    start = HEADER + F.lit(SERIES_ENTRY) * F.count("*").over(W.partitionBy(F.lit(0)))
    return directory.select("series", (start + F.coalesce(before, F.lit(0))).cast("long").alias("block_offset"), "block_length")


def segment_layout(frames: DataFrame) -> DataFrame:
    t = frames.agg(F.count_distinct("series").alias("series_count"), F.count("*").alias("frame_count"), F.sum("n_obs").alias("observation_count"), F.sum("len").alias("frame_bytes"))
    blocks = F.lit(HEADER) + F.col("series_count") * SERIES_ENTRY
    append = blocks + F.col("frame_bytes")
    recent = append + F.col("frame_count") * APPEND_ENTRY
    checksum = recent + F.col("observation_count") * OBSERVATION_ENTRY
    return t.select("series_count", "frame_count", "observation_count", blocks.cast("long").alias("blocks_offset"), append.cast("long").alias("append_offset"), recent.cast("long").alias("recent_offset"), (checksum + CHECKSUM).cast("long").alias("total"))


def recency_directory(frames: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations by series upwards and newest first inside it: range-partitioned and sorted, so files hold neighbouring series."""
    rows = frames.select("seq", "series", "effective").join(observations.select("seq", "ordinal", "receive"), "seq")
    order = [F.col("series"), F.col("effective").desc(), F.col("receive").desc(), F.col("seq").desc(), F.col("ordinal")]
    return rows.repartitionByRange("series", F.col("effective").desc()).sortWithinPartitions(*order)


def contiguous(frames: DataFrame, floor: int, cutoff: int) -> DataFrame:
    """One row: how many sequences of (floor, cutoff] are there, missing and repeated; no window over all frames."""
    inside = frames.where((F.col("seq") > floor) & (F.col("seq") <= cutoff)).groupBy("seq").agg(F.count("*").alias("n"))
    a = inside.agg(F.count("*").alias("present"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    return a.select("present", (F.lit(cutoff - floor) - F.col("present")).cast("long").alias("missing"), F.col("repeated").cast("long").alias("repeated"))


def recheck(entries: DataFrame, appends: DataFrame, fields: list[str]) -> DataFrame:
    """entries with `problem`: no append entry of their sequence, or one that differs in a field; null where all agree."""
    known = appends.select("seq", F.struct(*fields).alias("_append"))
    same = F.struct(*fields).eqNullSafe(F.col("_append"))
    problem = F.when(F.col("_append").isNull(), "MissingAppend").when(~same, "InconsistentSegment")
    return entries.join(known, "seq", "left").withColumn("problem", problem).drop("_append")


def audit(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows that only one of two directories has, counted; none if the index is sound."""
    a = stored.exceptAll(recomputed).withColumn("problem", F.lit("not in frames"))
    b = recomputed.exceptAll(stored).withColumn("problem", F.lit("not in index"))
    return a.unionByName(b)

"""Recovery: what a journal's tail beyond the committed cutoff means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_BYTES = 20


def committed(rows: DataFrame, cutoff: int) -> DataFrame:
    return rows.where(F.col("seq") <= cutoff)


def tail_class() -> Column:
    """Class of a tail (suffix_len, start_ok, sequence_ok, length_ok, frame_len, decode_ok), or why it is refused.

    start_ok: the bytes at hand begin a next frame; length_ok: the prefix states a legal length; decode_ok: the frame decodes."""
    s = F.col("suffix_len")
    return (
        F.when(s == 0, "Clean")
        .when(s < PREFIX_BYTES, F.when(F.col("start_ok"), "ShortFramePrefix").otherwise("refuse:InvalidLayout"))
        .when(~F.col("sequence_ok"), "refuse:SequenceMismatch")
        .when(~F.col("length_ok"), F.when(s == PREFIX_BYTES, "InvalidFramePrefix").otherwise("refuse:InvalidLayout"))
        .when(F.col("frame_len") > s, "TruncatedDeclaredFrame")
        .when(F.col("frame_len") < s, "refuse:InvalidLayout")
        .when(F.col("decode_ok"), "refuse:InvalidLayout")
        .otherwise("InvalidCompleteFrame")
    )


def current_manifest(slots: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The newer of two committed slots; refused if one is damaged or they aren't consecutive (one slot alone must be the first)."""
    a = slots.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.min("generation").alias("lo"), F.max("generation").alias("hi"), F.min(F.col("sound").cast("int")).alias("ok"), F.max_by("cutoff", "generation").alias("cutoff"))
    verdict = F.when(F.col("ok") == 0, "damaged").when((F.col("n") == 1) & (F.col("hi") != 1), "missing_slot").when((F.col("n") == 2) & (F.col("hi") != F.col("lo") + 1), "not_consecutive").otherwise("current")
    return a.select(*(keys or []), F.col("hi").alias("generation"), "cutoff", verdict.alias("verdict"))

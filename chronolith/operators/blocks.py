"""Blocks of Boolean values: runs, and the shortest of three layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = 16


def run_count(values: Column) -> Column:
    n = F.size(values)
    changes = F.zip_with(F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(values, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: (a != b).cast("int"))
    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(changes, F.lit(1), lambda a, x: a + x)).cast("long")


def layout(values: Column) -> tuple[Column, Column]:
    """(codec, bytes with the header): raw takes a byte a value, bits 1 + n / 8, runs 1 + 3 each."""
    n = F.size(values)
    raw, packed, runs = n + HEADER, F.ceil(n / 8).cast("int") + 1 + HEADER, run_count(values) * 3 + 1 + HEADER
    codec = F.when((packed < raw) & (packed <= runs), "bitpack").when((runs < raw) & (runs < packed), "rle").otherwise("raw")
    size = F.when(codec == "bitpack", packed).when(codec == "rle", runs).otherwise(raw)
    return codec, size.cast("long")


def choose(blocks: DataFrame) -> DataFrame:
    codec, size = layout(F.col("values"))
    return blocks.select("block", run_count(F.col("values")).alias("runs"), codec.alias("codec"), size.alias("bytes"))

"""Generations: where they begin and end, their catalog and its checks.

Boundaries by bytes and by demand are greedy: each depends on the one before. A store has one writer, so stores are the unit of
order; `ordered_fold` streams each store's rows in order through constant state, and stores spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .model import HEADER_BYTES


def ordered_fold(rows: DataFrame, key: str, order: str, inputs: list[str], column: str, start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, int | None]]) -> DataFrame:
    """rows with a long `column`: step(state, inputs) -> (state, value), along `order` inside each `key`.

    One shuffle by key and one sort; batches stream through, so a long key needs no memory."""
    schema = StructType([*rows.schema]).add(column, "long")
    at = [rows.columns.index(c) for c in (key, *inputs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for b in batches:
            values = []
            for k, *args in zip(*(b.column(i).to_pylist() for i in at)):
                if k != current:
                    current, state = k, start()
                state, v = step(state, tuple(args))
                values.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.int64())], schema.names)

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def rotate_by_count(frames: DataFrame, records: int) -> DataFrame:
    return frames.withColumn("generation", F.floor((F.col("seq") - 1) / records).cast("long") + 1)


def rotate_by_bytes(frames: DataFrame, most_bytes: int, most_records: int) -> DataFrame:
    """A frame joins while header, bytes so far and its own fit and there is room for a record.

    A frame that not even an empty generation holds is refused: its generation is null, and nothing rotates for it."""

    def step(s, args):
        (n,) = args
        gen, size, count = s
        if HEADER_BYTES + n > most_bytes:
            return s, None
        if count and (size + n > most_bytes or count >= most_records):
            gen, size, count = gen + 1, HEADER_BYTES, 0
        return (gen, size + n, count + 1), gen

    return ordered_fold(frames, "store", "store_seq", ["len"], "generation", lambda: (1, HEADER_BYTES, 0), step)


def rotate_by_age(frames: DataFrame, most_age: int) -> DataFrame:
    """A generation opens with its first frame and takes no frame whose clock `at` is most_age or more later; an empty one never rotates.

    A frame without a clock goes where its store stands."""

    def step(s, args):
        (at,) = args
        gen, opened = s
        if at is None:
            return s, gen
        if opened is not None and at - opened >= most_age:
            gen, opened = gen + 1, at
        return (gen, at if opened is None else opened), gen

    return ordered_fold(frames, "store", "store_seq", ["at"], "generation", lambda: (1, None), step)


def group_commits(frames: DataFrame, most_records: int, most_bytes: int, urgent: str = "1-URGENT") -> DataFrame:
    """A batch closes after the frame that fills it by count or bytes, or that is urgent."""

    def step(s, args):
        n, priority = args
        batch, size, count = s
        size, count = size + n, count + 1
        out = batch
        if count >= most_records or size >= most_bytes or priority == urgent:
            batch, size, count = batch + 1, 0, 0
        return (batch, size, count), out

    return ordered_fold(frames, "store", "store_seq", ["len", "priority"], "batch", lambda: (1, 0, 0), step)


def catalog(frames: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """A row for each generation: floor (exclusive), cutoff (inclusive), records, bytes, end offset."""
    return frames.groupBy(*keys, "generation").agg((F.min(seq) - 1).alias("floor"), F.max(seq).alias("cutoff"), F.count("*").alias("records"), (F.sum("len") + HEADER_BYTES).alias("bytes"))


def inventory(cat: DataFrame) -> DataFrame:
    return cat.agg(F.count("*").alias("sealed"), F.min_by("floor", "generation").alias("floor"), F.max_by("cutoff", "generation").alias("cutoff"), F.sum("bytes").alias("bytes"))


def chain_violations(cat: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a catalog that don't follow: generations by one, floors at the prior cutoff, the first (1, 0)."""
    w = W.partitionBy(*keys).orderBy("generation") if keys else W.orderBy("generation")
    g, c = F.lag("generation").over(w), F.lag("cutoff").over(w)
    reason = F.when(g.isNull() & ((F.col("generation") != 1) | (F.col("floor") != 0)), "bad_first").when(g.isNotNull() & (F.col("generation") != g + 1), "generation_gap").when(c.isNotNull() & (F.col("floor") != c), "range_gap").when(F.col("cutoff") <= F.col("floor"), "empty_range")
    return cat.withColumn("reason", reason).where("reason IS NOT NULL")


def strict_prefix(older: Column, newer: Column) -> Column:
    """Whether a catalog (array of generations) continues an older one that isn't empty: the same beginning, more entries, a later end."""
    n = F.size(older)
    same = F.slice(newer, F.lit(1), n) == older
    return F.coalesce((n > 0) & (n < F.size(newer)) & same & (F.element_at(older, -1) < F.element_at(newer, -1)), F.lit(False))


def audit_sealed(frames: DataFrame, cat: DataFrame) -> DataFrame:
    """(generation, problem): the first thing wrong with each generation, null if it is sound.

    frames: generation, seq, len, declared (boolean); cat: generation, floor, cutoff, bytes. Repeats are counted by sequence first, so no
    task sees a whole generation."""
    by_seq = frames.groupBy("generation", "seq").agg(F.count("*").alias("times"), F.sum("len").alias("len"), F.min("declared").alias("declared"))
    found = by_seq.groupBy("generation").agg(
        F.min("seq").alias("low"),
        F.max("seq").alias("high"),
        F.count("*").alias("present"),
        F.max("times").alias("times"),
        (F.sum("len") + HEADER_BYTES).alias("found_bytes"),
        F.min("declared").alias("declared"),
    )
    problem = F.coalesce(
        F.when(F.col("cutoff").isNull(), "Uncatalogued"),
        F.when(F.col("low").isNull(), "NoFrames"),
        F.when((F.col("low") <= F.col("floor")) | (F.col("high") > F.col("cutoff")), "OutsideRange"),
        F.when(F.col("times") > 1, "RepeatedSequence"),
        F.when(F.col("present") != F.col("cutoff") - F.col("floor"), "MissingSequence"),
        F.when(F.col("found_bytes") != F.col("bytes"), "ByteMismatch"),
        F.when(~F.col("declared"), "UndeclaredFrame"),
    )
    return cat.join(found, "generation", "full").select("generation", problem.alias("problem"))


def covers(commits: DataFrame, cat: DataFrame) -> DataFrame:
    """Commits with the sealed generation that holds them: inside its range of sequences, and of offsets."""
    hit = (F.col("seq") > F.col("floor")) & (F.col("seq") <= F.col("cutoff")) & (F.col("end_offset") > HEADER_BYTES) & (F.col("end_offset") <= F.col("bytes"))
    return commits.join(cat, (commits["claimed"] == cat["generation"]) & hit)


def file_name(generation: Column) -> Column:
    return F.concat(F.lit("generation-"), F.lpad(generation.cast("string"), 20, "0"), F.lit(".journal"))


def parse_name(name: Column) -> Column:
    """The generation of a file's name; null unless the name is exact."""
    return F.when(name.rlike("^generation-[0-9]{20}\\.journal\\z"), F.substring(name, 12, 20).cast("long"))


def progress(references: DataFrame, key: str) -> DataFrame:
    """How each generation of a key follows the one before: first, next or skipped."""
    before = F.lag("generation").over(W.partitionBy(key).orderBy("generation"))
    return references.withColumn("progress", F.when(before.isNull(), "first").when(F.col("generation") == before + 1, "next").otherwise("skipped"))

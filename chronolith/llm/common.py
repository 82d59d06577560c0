"""Small helpers that the operators of this package share."""

from __future__ import annotations

import math
import re
import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share.

    Where it is unset, a local session (tests, a laptop) takes a temporary folder; a cluster session gets an error."""
    there = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="chronolith-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold about 4 MB, so that an executor and its Python workers hold some texts and not a whole file's.

    A setting of the session, in force when rows are sent; where the session has a value of its own, it stays. Rows aren't cut."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns named by their place, which clash with no name that an operator uses; new names by the old ones."""
    names = {c: f"in{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def size_of(df: DataFrame) -> int:
    """Bytes of a table's values, counted in one pass: 8 a number, what texts and arrays hold."""

    def width(field: StructField) -> Column:
        if isinstance(field.dataType, (StringType, BinaryType)):
            return 16 + F.coalesce(F.octet_length(field.name), F.lit(0))
        if isinstance(field.dataType, ArrayType):
            return 16 + 8 * F.greatest(F.size(field.name), F.lit(0))
        return F.lit(8)

    return int(df.agg(F.coalesce(F.sum(sum((width(f) for f in df.schema.fields), F.lit(0)).cast("long")), F.lit(0)).alias("n")).first()["n"])


def broadcast_if_small(df: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """df with a broadcast hint if its values take `most_bytes` at most, else df as it is. df should be checkpointed: it is read twice."""
    return F.broadcast(df) if size_of(df) <= most_bytes else df


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id's decimal text modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % n


def blocks(items: Iterable[tuple[int, bytes | str | None]], limit: int) -> Iterator[list[tuple[int, bytes | str]]]:
    """Group (row, text) into lists of at most `limit` characters, so that numpy's scratch memory stays bounded.

    A longer text comes alone; nothing is cut."""
    held: list[tuple[int, bytes | str]] = []
    size = 0
    for row, text in items:
        text = text or type(text or "")()
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append((row, text))
        size += len(text)
    if held:
        yield held


def pieces(text: bytes, limit: int) -> Iterator[bytes]:
    """Cut at ASCII white space into pieces of about `limit` bytes; no word is split."""
    start, n = 0, len(text)
    while n - start > limit:
        end = start + limit
        while end < n and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def bounded_ids(df: DataFrame, strata: list[str], id_col: str, per_stratum: int, most: int, seed: int) -> DataFrame:
    """Ids of a bounded sample of labelled rows: for each stratum the `per_stratum` smallest by keyed hash, `most` in all.

    Ids are distinct within a stratum. A stratum's count sets the hash below which its ids are looked at, so what meets in one task
    follows `per_stratum`, not the number of rows, partitions or copies of an id."""
    known = df.where(F.col(id_col).isNotNull()).select(id_col, *strata).distinct()
    counts = checkpointed(known.groupBy(*strata).agg(F.count("*").alias("_n")))
    wanted = per_stratum + 10 * math.sqrt(per_stratum) + 20
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11)
    near = known.join(broadcast_if_small(counts), strata).withColumn("_h", place).where(F.col("_h") * 2.0**-53 * F.col("_n") <= wanted)
    w = W.partitionBy(*strata).orderBy("_h", id_col)
    return near.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_stratum).orderBy("_rn", "_h", id_col).limit(most).drop("_h", "_rn", "_n")


def sampled_rows(docs: DataFrame, ids: DataFrame, id_col: str, text: Column, by: list[str]) -> DataFrame:
    """(by, text) of the sampled ids, one row for each id and label: of repeated ids the text with the smallest hash."""
    rows = docs.select(id_col, text.alias("_text")).join(broadcast_if_small(checkpointed(ids)), id_col)
    return rows.groupBy(id_col, *by).agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))

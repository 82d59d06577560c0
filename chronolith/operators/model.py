"""The archive's views over the star-schema tables.

orders are frames: key + 1 is the append sequence, the customer is the series, the order date the effective time. lineitems are a
frame's observations, ordered inside it by all their columns. events are frames of one observation each. customers are declarations,
their nation is the store. A frame's stated length is 64 bytes and 96 for each observation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FRAME_BYTES, OBSERVATION_BYTES, HEADER_BYTES = 64, 96, 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, series, effective, receive, value, state; the receive time is the effective time."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("event_id") + 1).alias("seq"), F.col("user_id").alias("series"), F.col("ts").alias("effective"), F.col("ts").alias("receive"), "value", F.col("event_type").alias("state"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_orderkey") + 1).alias("seq"), F.col("o_custkey").alias("series"), F.col("o_orderdate").alias("effective"), F.col("o_orderpriority").alias("priority"))


def observations(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """seq, ordinal, receive, value, tag; ordinals count from 0 inside a frame. of: the frames (seq) that are wanted, all if None.

    Only the wanted frames' rows are numbered, and few keys reach the scan."""
    li = table(spark, sf_dir, "lineitem")
    if of is not None:
        li = li.join(of.select((F.col("seq") - 1).alias("l_orderkey")).distinct(), "l_orderkey", "left_semi").select(*li.columns)
    inside = W.partitionBy("l_orderkey").orderBy(*li.columns)
    return li.select((F.col("l_orderkey") + 1).alias("seq"), (F.row_number().over(inside) - 1).cast("long").alias("ordinal"), F.col("l_shipdate").alias("receive"), F.col("l_quantity").alias("value"), F.col("l_returnflag").alias("tag"))


def sized_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frames with n_obs and len; frames without observations stay."""
    n = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") + 1).alias("seq")).agg(F.count("*").alias("n_obs"))
    return frames(spark, sf_dir).join(n, "seq", "left").withColumn("n_obs", F.coalesce("n_obs", F.lit(0))).withColumn("len", F.lit(FRAME_BYTES) + F.col("n_obs") * OBSERVATION_BYTES)


def store_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sized frames with their store, numbered from 1 inside it."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("series"), F.col("c_nationkey").alias("store"))
    f = sized_frames(spark, sf_dir).join(c, "series")
    return f.withColumn("store_seq", F.row_number().over(W.partitionBy("store").orderBy("seq")).cast("long"))

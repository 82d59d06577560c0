"""Connected components by forests of the tasks' own edges, then alternating large-star and small-star as joins and aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


EDGES_A_TASK = 100_000


class Forest(dict):
    """Which trees names are in; a tree is known by its smallest name."""

    def find(self, c: int) -> int:
        while self.setdefault(c, c) != c:
            self[c] = self[self[c]]
            c = self[c]
        return c

    def join(self, a: int, b: int) -> bool:
        x, y = self.find(a), self.find(b)
        self[max(x, y)] = min(x, y)
        return x != y


def _own_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) for the nodes of one task's edges, by these alone."""
    forest = Forest()
    for t in batches:
        for a, b in zip(t.column(0).to_pylist(), t.column(1).to_pylist()):
            forest.join(a, b)
    nodes = list(forest)
    for at in range(0, len(nodes), 10_000):
        some = nodes[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([forest.find(n) for n in some], pa.int64())], ["node", "component"])


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (a, b) are stars: each a has one b, and no b is an a. As a > b, each star's centre is its smallest node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("b", F.lit(0), F.lit(1)))
    ends = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return ends.where("out > 1 OR (out = 1 AND in = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (a, b); component is the smallest node that links reach.

    Node ids are longs, null ends and loops are ignored, and edges may be repeated and in either direction. The edges
    are dealt by hash to tasks of about EDGES_A_TASK, and each task turns its own into stars; as many as one task takes
    need no more. Those of several tasks end as stars around each component's smallest node; every round is one
    checkpointed table of edges, so nothing but one answer a round reaches the driver. A hub's rows are aggregated before
    the shuffle and joined with one row, which Spark may split. The tasks of a round follow the number of edges."""
    e = checkpointed(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    tasks = e.count() // EDGES_A_TASK + 1
    dealt = e.coalesce(1) if tasks == 1 else e.repartition(tasks, "a", "b")
    stars = checkpointed(dealt.mapInArrow(_own_stars, "node long, component long"))
    if tasks == 1:
        return stars
    e = checkpointed(stars.where("node != component").toDF("a", "b").distinct().coalesce(tasks))
    while not _settled(e):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.coalesce(tasks).distinct().coalesce(tasks)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        star = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(down, "a").select(F.explode(star).alias("s")).select("s.*").where("a != b")
        e = checkpointed(small.coalesce(tasks).distinct().coalesce(tasks))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct().toDF("node", "component"))

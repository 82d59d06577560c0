"""Mixing against its definitions: water level, exact draws, quotas, gathered shards and reruns."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chronolith.llm import mixing
from chronolith.llm.common import checkpointed

SF = "/root/testdata/sf0.01"


def _what():
    return mixing.n_words(F.col("text")), F.xxhash64("text")


def _level(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by name, by bisection of the level at which the capped targets add up."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total = min(share, cap) * sum(sizes.values())
    low, high = 0.0, 1e12
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(cap * n, mid * w[s]) for s, n in sizes.items()) < total else (low, mid)
    return {s: min(cap * n, high * w[s]) for s, n in sizes.items()}


def test_targets_are_at_the_water_level(spark):
    rng = random.Random(3)
    cases = [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, None: 5}, {"x": 0, "y": 0}, {"only": 7}, {None: 3}, {"é": 5, "z": 5, "Z": 5, "": 4, "ﬀ": 9, "😀": 2}]
    cases += [{f"s{k}": int(rng.paretovariate(0.6)) for k in range(rng.randrange(2, 40))} for _ in range(6)]
    for sizes in cases:
        df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n long")
        got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
        want = _level(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want), sizes


def test_places_and_running_sums(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(50), rng.randrange(9)) for _ in range(500)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, k string, at long, v long")
    got = mixing.ordered(df, F.col("id").desc(), 5 * mixing.BUCKET).collect()
    assert all(r["idx"] == 499 - r["id"] for r in got)
    sums = mixing.running(df, ["k"], F.expr("at div 7"), ["at", "id"], {"before": "v"}).collect()
    for r in sums:
        assert r["before"] == sum(v for i, (k, at, v) in enumerate(rows) if k == r["k"] and (at, i) < (r["at"], r["id"]))


def test_hypergeometric_is_exact(spark):
    n = 20_000
    for total, marked, drawn in ((50, 20, 15), (9, 9, 4), (7, 0, 3), (2, 1, 1)):
        u = (F.col("id") + 0.5) / n
        found = spark.range(n).select(mixing.hypergeometric(F.lit(total), F.lit(marked), F.lit(drawn), u).alias("k")).groupBy("k").count()
        got = {r["k"]: r["count"] / n for r in found.collect()}
        for k in range(drawn + 1):
            p = math.comb(marked, k) * math.comb(total - marked, drawn - k) / math.comb(total, drawn) if k <= marked and drawn - k <= total - marked else 0
            assert abs(got.get(k, 0) - p) < 2 / n


@pytest.mark.parametrize("fan", [1000, 2])
def test_tree_splits_quotas_exactly(spark, fan):
    quotas = {0: 1000, 1: 37, 2: 5, 3: 0, 4: 211}
    q = spark.createDataFrame([(i, n) for i, n in quotas.items() if n], "idx long, n long")
    rows = mixing.split_quotas(q, 3, 1, 5, fan).collect()
    assert all(sum(r["n"] for r in rows if r["idx"] == i) == n for i, n in quotas.items())
    shards = [sum(r["n"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(shards) - min(shards) <= 1


@pytest.mark.parametrize("fan", [1000, 3])
def test_shares_of_the_halves_follow_the_distribution(spark, fan):
    left = []
    for seed in range(12):
        q = spark.createDataFrame([(i, 40) for i in range(20)], "idx long, n long")
        left += [r["n"] for r in mixing.split_quotas(q, 1, seed, 20, fan).where("shard = 0").collect()]
    mean = sum(left) / len(left)
    var = sum((x - mean) ** 2 for x in left) / len(left)
    assert abs(mean - 20) < 0.5 and 6 < var < 13  # of 40 among 800, 400 drawn: variance 9.5


def test_mix_targets_shards_and_reruns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 3)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = checkpointed(mixing.mix(docs, *_what(), shard_words=20_000, block_rows=20))
    assert all(abs(r["t"] - r["g"]) <= 0.5 for r in m.groupBy("source").agg(F.sum("_taken").alias("t"), F.first("_target").alias("g")).collect())
    assert m.where("_taken > 2 * _size").count() == 0
    again = mixing.mix(docs.repartition(7), *_what(), shard_words=20_000, block_rows=20)
    assert m.select("doc_id", "_taken", "_draws").exceptAll(again.select("doc_id", "_taken", "_draws")).count() == 0
    d = m.select("source", F.explode("_draws").alias("d")).select("source", "d.*")
    assert d.select("shard").distinct().count() == 32
    mixed = mixing.mixed_rows(docs, shard_words=20_000, block_rows=20)
    rows = mixed.withColumn("part", F.spark_partition_id()).select("part", "mix_shard", "mix_key", "mix_words", _what()[0].alias("n")).collect()
    assert mixed.rdd.getNumPartitions() == 32
    assert all(r["part"] == r["mix_shard"] for r in rows) and all(r["mix_words"] == r["n"] for r in rows)
    for part in range(32):
        keys = [r["mix_key"] for r in rows if r["part"] == part]
        assert keys == sorted(keys)


def test_null_and_repeated_ids_spread_over_blocks(spark):
    rows = [(None, f"text number {k} of many", "a") for k in range(3000)] + [(7, f"other text {k}", "a") for k in range(3000)] + [(8, "same", "b")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m, names, _ = mixing._mix(docs, *_what(), "doc_id", "source", 29, 100, 2_000_000, {})
    keys = m.groupBy("key").count()
    assert keys.count() == 6001 and names == docs.columns
    got = mixing.mix(docs, *_what(), block_rows=100).collect()
    assert len(got) == 6040
    taken = {s: sum(r["_taken"] for r in got if r["source"] == s) for s in "ab"}
    want = {r["source"]: r["_target"] for r in got}
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in "ab")

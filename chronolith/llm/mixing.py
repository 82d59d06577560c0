"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Targets: sources in order of their names weigh 5, 2, 1, repeating; together they get `share` of all words; a target stops at
`cap` times its source and the excess goes to the others by weight. That is the water level at which the capped targets add up, found in
a few rounds of sums: each takes the sources that the last level fills out of the others' share, until no more fill.

Draws: a keyed hash deals each source's documents into blocks of about `block_rows` rows. A source passes through all its
blocks as often as its quota asks, each pass in a permutation of its own; the last block of the last pass is cut to
the word, so quotas are exact. The tree starts with the number of blocks that each source gives, and splits a node's
counts between two halves: how many of a source's blocks go left is drawn from the multivariate hypergeometric
distribution (support cut 12 standard deviations from the mode), source by source; beyond `FAN` sources first by groups of sources, then
inside each group, so no array grows with their number. Leaves are output shards; each takes the next disjoint range of each source's
permuted blocks. `mixed_rows` gathers each shard in one partition and shuffles it there.

A block, not a source, is the unit of all row-level windows and joins, so a hot source spreads over its blocks; running sums over
blocks and shards are taken inside buckets and then over buckets. The driver sees a few sums, nothing else. All randomness is a hash
of ids, texts and `seed`: reruns agree.

Defined results: null and empty texts have size 0 and are never taken. The null source comes last. A source without words
has target 0; without any words all targets are 0; an empty table gives no row. Rows that agree in id, source and text are
interchangeable and share a block; each input row counts. Null and repeated ids are dealt by their texts. Extra columns are kept, but for
those named like a column that is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed, table

WORD = r"[^\x20\x09-\x0D]+"
#: Sources, or groups of sources, that one array of the tree holds at most; blocks or shards in a bucket of running sums, about.
FAN, BUCKET = 1_000, 20_000
#: Partitions into which the mix is gathered at most; beyond, neighbouring shards share one.
MOST_PARTITIONS = 65_536


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(*parts: Column) -> Column:
    """A keyed number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * (2.0**-53)


def ordered(df: DataFrame, by: Column, rows: int) -> DataFrame:
    """df with idx, each row's place in the order from 0 on, numbered inside ranges and then over ranges."""
    ranged = df.repartitionByRange(min(200, rows // BUCKET + 1), by).withColumn("part", F.spark_partition_id())
    ranged = checkpointed(ranged.withColumn("place", F.row_number().over(W.partitionBy("part").orderBy(by))))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n_part"))
    before = F.coalesce(F.sum("n_part").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # 200 rows at most
    offsets = counts.select("part", before.alias("before"))
    return ranged.join(F.broadcast(offsets), "part").withColumn("idx", (F.col("before") + F.col("place") - 1).cast("long")).drop("part", "place", "before")


def running(df: DataFrame, keys: list[str], bucket: Column, order: list[str], values: dict[str, str]) -> DataFrame:
    """df with the sums of values over earlier rows of the same keys: inside buckets, which follow the order, and over buckets before."""
    df = df.withColumn("bucket", bucket)
    sums = df.groupBy(*keys, "bucket").agg(*(F.sum(v).alias(f"{name}_0") for name, v in values.items()))
    over = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, "bucket", *(F.coalesce(F.sum(f"{name}_0").over(over), F.lit(0)).alias(f"{name}_0") for name in values))
    inside = W.partitionBy(*keys, "bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumns({f"{name}_1": F.coalesce(F.sum(v).over(inside), F.lit(0)) for name, v in values.items()})
    df = df.join(sums, [*keys, "bucket"])
    return df.withColumns({name: F.col(f"{name}_0") + F.col(f"{name}_1") for name in values}).drop("bucket", *(f"{name}_{k}" for name in values for k in (0, 1)))


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(idx, source, source_size, n, target) from rows of (source, source_size, n)."""
    sizes = checkpointed(sizes)
    whole = sizes.agg(F.count("*").alias("rows"), (F.coalesce(F.sum("source_size"), F.lit(0)) * F.lit(share)).alias("total")).first()
    total = whole["total"]
    w = ordered(sizes, F.col("source").asc_nulls_last(), whole["rows"])
    w = w.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("idx") % len(weights) + 1).cast("int")).cast("double"))
    w = checkpointed(w.withColumn("most", F.col("source_size") * F.lit(cap)))
    filled, left, others = -1, total, w.agg(F.sum("w")).first()[0]
    full = F.lit(True)
    for _ in range(whole["rows"] + 1):
        full = F.col("most") / F.col("w") <= F.lit(left / others if others else math.inf)
        row = w.agg(F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)).alias("most"), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0)).alias("w")).first()
        if row["n"] == filled:
            break
        filled, left, others = row["n"], total - row["most"], row["w"]
    target = F.when(full, F.col("most")).otherwise(F.lit(left) * F.col("w") / F.lit(others or 1.0))
    return w.select("idx", "source", "source_size", "n", target.alias("target"))


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _log_factorial(z: Column) -> Column:
    """Stirling's series, eight terms up."""
    y = z + 8
    near = (y + 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (y * 12) - 1 / (y * y * y * 360) + 1 / (y * y * y * y * y * 1260)
    return near - F.log((z + 1) * (z + 2) * (z + 3) * (z + 4)) - F.log((z + 5) * (z + 6) * (z + 7) * (z + 8))


def hypergeometric(n: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Marked items among `drawn` of `n`, of which `marked` are marked, by inversion of the uniform u.

    Values are tried from the mode upwards, then from the mode downwards, with the ratios of neighbouring probabilities."""
    given = F.struct(n.cast("double").alias("n"), marked.cast("double").alias("k"), drawn.cast("double").alias("m"), u.alias("u"))

    def limits(g: Column) -> Column:
        n, k, m = g["n"], g["k"], g["m"]
        low, high = F.greatest(F.lit(0.0), m + k - n), F.least(k, m)
        mode = F.least(high, F.greatest(low, F.floor((m + 1) * (k + 1) / (n + 2)).cast("double")))
        sd = F.sqrt(F.greatest(F.lit(0.0), m * k * (n - k) * (n - m) / (n * n * F.greatest(n - 1, F.lit(1.0)))))
        return F.struct(*(g[c].alias(c) for c in "nkmu"), low.alias("low"), high.alias("high"), mode.alias("mode"), F.ceil(sd * 12 + 20).cast("double").alias("reach"))

    def chance(g: Column) -> Column:
        n, k, m, x = g["n"], g["k"], g["m"], g["mode"]
        up = _log_factorial(k) + _log_factorial(n - k) + _log_factorial(m) + _log_factorial(n - m) - _log_factorial(n)
        down = _log_factorial(x) + _log_factorial(k - x) + _log_factorial(m - x) + _log_factorial(n - k - m + x)
        return F.struct(g.alias("g"), F.exp(up - down).alias("p"))

    def search(b: Column) -> Column:
        g, p = b["g"], b["p"]
        n, k, m, mode = g["n"], g["k"], g["m"], g["mode"].cast("long")
        rise = F.sequence(mode, F.least(g["high"], g["mode"] + g["reach"]).cast("long"))
        fall = F.sequence(mode, F.greatest(g["low"], g["mode"] - g["reach"]).cast("long"))
        tried = F.concat(F.slice(rise, F.lit(2), F.size(rise)), F.slice(fall, F.lit(2), F.size(fall)))

        def step(s: Column, x: Column) -> Column:
            w = F.when(x > mode, s["up"] * (k - x + 1) * (m - x + 1) / (x * (n - k - m + x))).otherwise(s["down"] * (x + 1) * (n - k - m + x + 1) / ((k - x) * (m - x)))
            return _bound(w, lambda w: F.struct(F.when(x > mode, w).otherwise(s["up"]).alias("up"), F.when(x > mode, s["down"]).otherwise(w).alias("down"), (s["c"] + w).alias("c"), F.when((s["x"] < 0) & (s["c"] + w > g["u"]), x).otherwise(s["x"]).alias("x")))

        init = F.struct(p.alias("up"), p.alias("down"), p.alias("c"), F.when(g["u"] < p, mode).otherwise(F.lit(-1)).cast("long").alias("x"))
        return F.aggregate(tried, init, step, lambda s: F.when(s["x"] < 0, mode).otherwise(s["x"]))

    return _bound(given, lambda g: _bound(limits(g), lambda g: _bound(chance(g), search)))


def _halves(packed: DataFrame, keys: list[str], seed: int, *salt: Column) -> DataFrame:
    """(keys, idx, l, r) from nodes with parts (idx, n), their total and the number of items that go left: one draw after another."""

    def step(s: Column, x: Column) -> Column:
        u = _uniform(F.lit(seed), *salt, x["idx"])

        def halves(k: Column) -> Column:
            out = F.array_append(s["out"], F.struct(x["idx"].alias("idx"), k.alias("l"), (x["n"] - k).alias("r")))
            return F.struct((s["total"] - x["n"]).alias("total"), (s["left"] - k).alias("left"), out.alias("out"))

        return _bound(hypergeometric(s["total"], x["n"], s["left"], u), halves)

    init = F.struct(F.col("total").alias("total"), F.col("left").alias("left"), F.expr("cast(array() as array<struct<idx:bigint,l:bigint,r:bigint>>)").alias("out"))
    return packed.select(*keys, F.explode(F.aggregate("parts", init, step)["out"]).alias("p")).select(*keys, "p.*")


def split_quotas(quotas: DataFrame, levels: int, seed: int, n_sources: int, fan: int = FAN) -> DataFrame:
    """(shard, idx, n) for the 2 ** levels leaves, from (idx, n) with idx below n_sources: the splitting tree."""
    depth = 0
    while n_sources > fan ** (depth + 1):
        depth += 1
    parts = F.sort_array(F.collect_list(F.struct("idx", "n"))).alias("parts")
    nodes = quotas.select(F.lit(0).cast("long").alias("node"), F.col("idx").cast("long").alias("idx"), F.col("n").cast("long").alias("n"))
    for level in range(levels):
        groups = [nodes]
        for _ in range(depth):
            groups.append(groups[-1].groupBy("node", F.expr(f"idx div {fan}").alias("idx")).agg(F.sum("n").alias("n")))
        packed = groups[-1].groupBy("node").agg(parts, F.sum("n").alias("total")).withColumn("left", F.expr("total div 2"))
        drawn = _halves(packed, ["node"], seed, F.lit(level), F.lit(depth), F.col("node"))
        for k in reversed(range(depth)):
            packed = groups[k].groupBy("node", F.expr(f"idx div {fan}").alias("up")).agg(parts, F.sum("n").alias("total"))
            packed = packed.join(drawn.select("node", F.col("idx").alias("up"), F.col("l").alias("left")), ["node", "up"])
            drawn = _halves(packed, ["node"], seed, F.lit(level), F.lit(k), F.col("node"))
        sides = F.array(F.struct((F.col("node") * 2).alias("node"), "idx", F.col("l").alias("n")), F.struct((F.col("node") * 2 + 1).alias("node"), "idx", F.col("r").alias("n")))
        nodes = drawn.select(F.explode(sides).alias("h")).select("h.*").where("n > 0")
        if level % 4 == 3 or depth:
            nodes = checkpointed(nodes)
    return nodes.withColumnRenamed("node", "shard")


def _block_draws(narrow: DataFrame, sources: DataFrame, levels: int, n_sources: int, seed: int) -> DataFrame:
    """(idx, block, draws) of the blocks that are drawn: epoch, shard and words up to which, for each time."""
    blocks = narrow.groupBy("idx", "block").agg(F.sum("size").alias("words")).where("words > 0")
    blocks = checkpointed(blocks.join(broadcast_if_small(sources.select("idx", "quota", "source_size", "n_blocks")), "idx").where("quota > 0"))
    full = blocks.groupBy("idx").agg(F.count("*").alias("in_pass"))
    passes = blocks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(quota - 1) div source_size"))).alias("epoch"))
    passes = passes.withColumn("place", _uniform(F.lit(seed), F.col("epoch"), F.col("idx"), F.col("block"))).withColumn("one", F.lit(1).cast("long"))
    bucket = F.floor(F.col("place") * F.ceil(F.col("n_blocks") / BUCKET))
    passes = running(passes, ["idx", "epoch"], bucket, ["place", "block"], {"before": "words", "place_no": "one"})
    upto = F.least(F.col("words"), F.col("quota") - F.col("epoch") * F.col("source_size") - F.col("before"))
    drawn = passes.withColumn("upto", upto).where("upto > 0").join(full, "idx")
    drawn = checkpointed(drawn.select("idx", "block", "epoch", "upto", (F.col("epoch") * F.col("in_pass") + F.col("place_no")).alias("seq")))
    leaves = checkpointed(split_quotas(drawn.groupBy("idx").agg(F.count("*").alias("n")), levels, seed, n_sources))
    leaves = running(leaves, ["idx"], F.expr(f"shard div {BUCKET}"), ["shard"], {"start": "n"})
    taken_by = leaves.select("idx", "shard", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("seq"))
    return drawn.join(taken_by, ["idx", "seq"]).groupBy("idx", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", "upto"))).alias("draws"))


ADDED = ("_size", "_source_size", "_target", "_taken", "_draws")


def _mix(docs: DataFrame, size: Column, content: Column, id_col: str, source_col: str, seed: int, block_rows: int, shard_words: int, weighting: dict) -> tuple[DataFrame, list[str], int]:
    """docs with columns in0, in1, ... and what the mix adds; the names of the former; the number of shards."""
    names = list(docs.columns)
    source = F.col(f"`{source_col}`").cast("string")
    skey = F.coalesce(F.concat(F.lit("="), source), F.lit(""))
    key = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), source, content)
    plain = docs.select(*(F.col(f"`{c}`").alias(f"in{k}") for k, c in enumerate(names)), size.cast("long").alias("size"), skey.alias("skey"), key.alias("key"))
    narrow = checkpointed(plain.select("skey", "key", "size"))
    sizes = narrow.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(sizes.select(F.expr("if(skey = '', null, substr(skey, 2))").alias("source"), "source_size", "n"), **weighting)
    quota, n_blocks = F.round("target").cast("long").alias("quota"), F.ceil(F.col("n") / block_rows).alias("n_blocks")
    sources = targets.select("idx", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("skey"), "source_size", "target", quota, n_blocks)
    sources = checkpointed(sources)
    figures = sources.agg(F.count("*").alias("n"), F.coalesce(F.sum("quota"), F.lit(0)).alias("words")).first()
    levels = max(0, math.ceil(math.log2(max(figures["words"], 1) / shard_words)))
    known = broadcast_if_small(sources)
    block = F.floor(_uniform(F.col("key"), F.lit(1)) * F.col("n_blocks")).alias("block")
    placed = narrow.join(known, "skey").select("idx", block, "size")
    draws = _block_draws(placed, sources, levels, figures["n"], seed)

    ins = [f"in{k}" for k in range(len(names))]
    rows = plain.join(known, "skey").select(*ins, "key", "size", "idx", "source_size", "target", block)
    inside = W.partitionBy("idx", "block").orderBy("key", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("start", F.sum("size").over(inside) - F.col("size")).join(draws, ["idx", "block"], "left")

    def words(d: Column) -> Column:
        return F.least(F.col("size"), F.greatest(F.lit(0), d["upto"] - F.col("start"))).cast("long")

    parts = F.transform("draws", lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"), words(d).alias("words")))
    rows = rows.withColumn("_draws", F.filter(parts, lambda d: d["words"] > 0))
    taken = F.coalesce(F.aggregate("_draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]), F.lit(0).cast("long"))
    added = [F.col("size").alias("_size"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), taken.alias("_taken"), "_draws"]
    return rows.select(*ins, "key", *added), names, 1 << levels


def mix(docs: DataFrame, size: Column, content: Column, *, id_col: str = "doc_id", source_col: str = "source", seed: int = 29, block_rows: int = 500, shard_words: int = 2_000_000, **weighting) -> DataFrame:
    """docs with _size, _source_size, _target, _taken and _draws: (epoch, shard, words) of each time the mix takes a row.

    size: words of a row, a long that isn't null. content: what tells rows with equal ids apart, such as a hash of the text."""
    rows, names, _ = _mix(docs.drop(*ADDED), size, content, id_col, source_col, seed, block_rows, shard_words, weighting)
    return rows.drop("key").toDF(*names, *ADDED)


MIX_COLUMNS = ("mix_shard", "mix_epoch", "mix_words", "mix_key")


def mixed_rows(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", seed: int = 29, block_rows: int = 500, shard_words: int = 2_000_000, **weighting) -> DataFrame:
    """The mix itself: a row for each time a document is taken, with shard, epoch and words; each shard in one partition, shuffled there.

    A document that ends a quota is cut to its first words, joined by single spaces."""
    docs = docs.drop(*MIX_COLUMNS)
    text = F.col(f"`{text_col}`").cast("string")
    rows, names, shards = _mix(docs, n_words(text), F.xxhash64(text), id_col, source_col, seed, block_rows, shard_words, weighting)
    each = rows.withColumn("d", F.explode("_draws"))
    own = F.col(f"in{names.index(text_col)}").cast("string")
    cut = F.array_join(F.slice(F.regexp_extract_all(own, F.lit(WORD), F.lit(0)), F.lit(1), F.col("d.words").cast("int")), " ")
    taken = F.when(F.col("d.words") < F.col("_size"), cut).otherwise(own)
    place = F.xxhash64(F.lit(seed), F.col("d.shard"), F.col("d.epoch"), F.col("key"))
    ins = [taken.alias(c) if names[k] == text_col else F.col(c) for k, c in enumerate(f"in{k}" for k in range(len(names)))]
    out = each.select(*ins, F.col("d.shard").alias("mix_shard"), F.col("d.epoch").alias("mix_epoch"), F.col("d.words").alias("mix_words"), place.alias("mix_key"))
    parts = min(shards, MOST_PARTITIONS)
    gathered = out.repartitionById(parts, F.expr(f"cast(mix_shard * {parts} div {shards} as int)"))
    return gathered.sortWithinPartitions("mix_shard", "mix_key").toDF(*names, *MIX_COLUMNS)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    docs = checkpointed(table(spark, sf_dir, "documents").select("doc_id", "source", n_words(text).alias("words"), F.xxhash64(text).alias("content")))
    m = mix(docs, F.col("words"), F.col("content"))
    return m.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))

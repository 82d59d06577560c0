"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, reranking with the vectors themselves.

A rotation of the principal axes is learned on a bounded sample of the vectors, so that their signs make balanced binary codes
(iterative quantisation); lengths too rare to learn from take a random rotation. The code is cut into substrings; each table files every
vector under its label and one substring. Two vectors meet in a table if their substrings differ in `radius` bits or fewer, so codes that
differ in up to tables * (radius + 1) - 1 bits always meet. Substrings have about log2 n bits for n vectors, or fewer where a table
would have more than 2,000 probes, and that guarantee covers 7 bits whatever n. What meets is reranked with the original vectors, in
double precision: links have no false member.

Equal vectors merge first. A table's entry is dealt into blocks of about `block` vectors, and pairs of blocks, not of vectors, are
joined: each is one small matrix product that returns a vector's count of links and its root inside the pair of blocks. No group is
ever whole in one task, and no table of vector pairs exists. Pairs that meet in several tables count in the first one.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label or null id, link
with nothing; their component is their own id. Vectors of different lengths never link. Rows that share an id share links. Extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table
from .graph import components


def fit_itq(x: np.ndarray, bits: int = 64, rounds: int = 30, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): signs of (v - mean) @ projection are the code's bits."""
    rng = np.random.default_rng(seed)
    mean = x.mean(axis=0)
    values, axes = np.linalg.eigh(np.cov((x - mean).T) + 1e-12 * np.eye(x.shape[1]))
    axes = axes[:, np.argsort(-values)[: min(bits, x.shape[1])]]
    v = (x - mean) @ axes
    r = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return mean, axes @ r


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for those that link with nothing."""
    out = []
    for v in column.to_pylist():
        a = None if not v or None in v else np.array(v, np.float64)
        norm = 0.0 if a is None or not np.isfinite(a).all() else float(np.linalg.norm(a / np.abs(a).max())) * float(np.abs(a).max()) if a.any() else 0.0
        out.append(a / norm if norm > 0 and math.isfinite(norm) else None)
    return out


def plan(n: int, bits: int, least: int = 7) -> tuple[int, int]:
    """Tables and radius for n vectors: tables * (radius + 1) - 1 >= least, with tables enough that each has 2,000 probes or fewer."""
    tables = max(1, min(bits, bits // max(1, math.ceil(math.log2(max(n, 2))))))
    while True:
        width = -(-bits // tables)
        radius = min(width, max(0, math.ceil((least + 1) / tables) - 1))
        if tables >= bits or sum(math.comb(width, k) for k in range(radius + 1)) <= 2_000:
            return tables, radius
        tables += 1


def random_projection(dim: int, bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) without learning, for lengths too rare to learn from: a random rotation's first axes."""
    rng = np.random.default_rng([seed, dim])
    return np.zeros(dim), np.linalg.qr(rng.normal(size=(dim, min(bits, dim))))[0]


def _learned(good: DataFrame, bits: int, sample: int, lengths: int, seed: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Quantisers of the commonest lengths (in bytes of the vectors), each fitted on a bounded sample."""
    common = good.groupBy(F.octet_length("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(lengths).collect()
    models = {}
    for d in (r["d"] for r in common):
        some = good.where(F.octet_length("v") == d).select("v", F.xxhash64(F.lit(seed), "id").alias("h")).orderBy("h", "v").limit(sample).toArrow()
        x = np.stack([np.frombuffer(v.as_py(), np.float64) for v in some["v"]])
        models[d] = fit_itq(x if len(x) > 1 else np.vstack([x, x]), bits)
    return models


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, bits: int = 64, sample: int = 8_000, lengths: int = 8, block: int = 256, planned_rows: int | None = None, seed: int = 1) -> DataFrame:
    """(id, n_links, component_id, kept) of each row.

    lengths: how many of the commonest lengths get a learned rotation. planned_rows: vectors that the tables are planned for, where not
    the number of different ones."""
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = zip(b.column(0).to_pylist(), b.column(2).to_pylist(), _vectors(b.column(1)))
            vs = [None if i is None or g is None or v is None else v.tobytes() for i, g, v in known]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(vs, pa.binary())], ["id", "label", "v"])

    rows = checkpointed(src.mapInArrow(normal, "id long, label string, v binary"))
    good = rows.where("v IS NOT NULL")
    longest = good.agg(F.max(F.octet_length("v")).alias("d")).first()["d"]
    if not longest:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    shared = spark.sparkContext.broadcast(_learned(good, bits, sample, lengths, seed))
    merged = good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = dict(shared.value)
        for b in batches:
            codes = []
            for v in b.column(1).to_pylist():
                if len(v) not in models:
                    models[len(v)] = random_projection(len(v) // 8, bits, seed)
                mean, axes = models[len(v)]
                on = (np.frombuffer(v, np.float64) - mean) @ axes >= 0
                codes.append(int(np.packbits(np.pad(on, (0, 64 - len(on))), bitorder="little").view(np.int64)[0]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.int64())], [*b.schema.names, "code"])

    coded = checkpointed(merged.mapInArrow(code, "label string, v binary, rep long, n long, code long"))
    width = min(bits, 64, longest // 8)
    n_tables, radius = plan(planned_rows or coded.count(), width)
    edges = [round(i * width / n_tables) for i in range(n_tables + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]

    subs = F.array(*(F.col("code").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks))
    kind = F.concat(F.octet_length("v"), F.lit(":"), "label").alias("label")  # vectors of different lengths never meet
    filed = coded.select(kind, "v", "rep", "n", "code", F.posexplode(subs).alias("t", "sub"))
    units = checkpointed(filed.groupBy("label", "t", "sub").agg(F.ceil(F.count("*") / block).alias("blocks")))
    deal = F.pmod(F.xxhash64(F.lit(seed), "rep", "code"), F.col("blocks")).cast("int").alias("b")
    blocks = filed.join(units, ["label", "t", "sub"]).groupBy("label", "t", "sub", deal)
    blocks = checkpointed(blocks.agg(F.collect_list(F.struct("rep", "n", "code", "v")).alias("m")))

    def flips(low: int, high: int) -> Column:
        return F.array(*(F.lit(_signed(sum(1 << b for b in c))).cast("long") for k in range(radius + 1) for c in combinations(range(low, high), k)))

    flip = F.element_at(F.array(*(flips(a, b) for a, b in zip(edges, edges[1:]))), F.col("t") + 1)
    probes = units.select("label", "t", F.col("sub").alias("sub1"), F.col("blocks").alias("blocks1"), F.explode(flip).alias("flip"))
    probes = probes.withColumn("sub", F.col("sub1").bitwiseXOR(F.col("flip"))).where("sub1 <= sub")

    def upto(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int")))

    met = probes.join(units, ["label", "t", "sub"]).select("label", "t", "sub1", F.col("sub").alias("sub2"), "blocks", upto("blocks1").alias("b1"))
    met = met.select("label", "t", "sub1", "sub2", "b1", upto("blocks").alias("b2")).where("sub1 < sub2 OR b1 <= b2")
    one = blocks.withColumnsRenamed({"sub": "sub1", "b": "b1", "m": "m1"})
    two = blocks.withColumnsRenamed({"sub": "sub2", "b": "b2", "m": "m2"})
    pairs = met.join(one, ["label", "t", "sub1", "b1"]).join(two, ["label", "t", "sub2", "b2"])
    pairs = pairs.withColumn("same", F.expr("sub1 = sub2 AND b1 = b2")).where("NOT same OR size(m1) > 1").select("t", "same", "m1", "m2")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for k in range(b.num_rows):
                t, same = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                sides = []
                for m in (b.column(2)[k].values, b.column(3)[k].values):
                    v = np.frombuffer(b"".join(m.field("v").to_pylist()), np.float64).reshape(len(m), -1)
                    sides.append((m.field("rep").to_numpy(), m.field("n").to_numpy(), m.field("code").to_numpy(), v))
                (r1, n1, c1, v1), (r2, n2, c2, v2) = sides
                linked = v1 @ v2.T >= least
                if same:
                    np.fill_diagonal(linked, False)
                x = c1[:, None] ^ c2[None, :]
                for mask in masks[:t]:
                    linked &= np.bitwise_count(x & np.int64(_signed(mask))) > radius
                if not linked.any():
                    continue
                root1, root2 = r1.copy(), r2.copy()
                big = np.iinfo(np.int64).max
                while True:
                    new2 = np.minimum(root2, np.where(linked, root1[:, None], big).min(axis=0))
                    new1 = np.minimum(root1, np.where(linked, new2[None, :], big).min(axis=1))
                    if same:
                        new1 = new2 = np.minimum(new1, new2)
                    if (new1 == root1).all() and (new2 == root2).all():
                        break
                    root1, root2 = new1, new2
                links = linked @ n2
                out += [(int(r), int(n), int(z)) for r, n, z in zip(r1, links, root1) if n]
                if not same:
                    links = n1 @ linked
                    out += [(int(r), int(n), int(z)) for r, n, z in zip(r2, links, root2) if n]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in range(3)], ["rep", "links", "root"])

    found = checkpointed(pairs.mapInArrow(rerank, "rep long, links long, root long"))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct()).withColumnRenamed("node", "rep")
    reps = coded.select("label", "v", "rep", "n").join(counts, "rep", "left").join(comps, "rep", "left")
    reps = reps.select("label", "v", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "rep").alias("component"))
    component = F.coalesce("component", "id")
    n_links = F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links")
    kept = F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    return rows.join(reps, ["label", "v"], "left").select(F.col("id").alias(id_col), n_links, component.alias("component_id"), kept)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))

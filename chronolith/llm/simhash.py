"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints: 64 bits; bit i is 1 if more than half of the text's shingle hashes have it. Equal fingerprints merge
first, so copies never make pairs. Then balls of half the radius meet:

- Two fingerprints within 2 bits share a variant of radius 1. All members of a variant's group are within 2 bits of
  each other and at most 65 fingerprints are within one bit of a variant, so a star around the smallest member links
  them with no pair to verify.
- A radius of 3 halves to one and a half. If three bits differ, leave out a 16-bit block that holds one of them: over
  the other 48 bits two differ at most, and balls of radius 1 meet there. Only variants that two components of the first
  pass share are looked at again; their pairs across components are verified on all 64 bits.

Defined results: a null or empty text has fingerprint zero and links like any other. Rows with a null id have a
fingerprint, link with nothing through the id and get the component of their fingerprint. Repeated rows and repeated
ids get one row each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, pieces, table
from .graph import components

SEED = 42
PIECE = 1 << 20


def shingle_hashes(text: bytes, n: int = 3) -> Iterator[np.ndarray]:
    """XXH64 of each run of n words, in arrays of bounded size; of the whole sequence if there are fewer words."""
    carry: list[bytes] = []
    some = False
    for piece in pieces(text, PIECE):
        words = carry + piece.lower().split()
        if len(words) >= n:
            flat = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            cut = [flat[a:b] for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())]
            yield np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64, len(cut))
            some = True
            carry = words[-(n - 1) :] if n > 1 else []
        else:
            carry = words
    if not some and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)


def fingerprint(text: bytes | None, n: int = 3) -> int:
    """The SimHash as a signed 64-bit number."""
    votes, total = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text or b"", n):
        for at in range(0, len(h), 1 << 14):
            part = h[at : at + (1 << 14)]
            votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(h)
    bits = np.packbits(votes * 2 > total, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) of each row, over whole texts, in one narrow pass."""
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("_text"))
    schema = src.select(id_col).schema.add("fp", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], [batch.schema.names[0], "fp"])

    return src.mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _ball(fp: Column, bits: list[int]) -> list[Column]:
    return [fp, *(fp.bitwiseXOR(F.lit(_signed(1 << b)).cast("long")) for b in bits)]


MASKS = tuple(_signed(~(0xFFFF << (16 * block)) & (1 << 64) - 1) for block in range(4))
SALTS = tuple(_signed(0x9E3779B97F4A7C15 * block & (1 << 64) - 1) for block in range(4))


def close_fingerprints(uniq: DataFrame) -> DataFrame:
    """(fp, component) for each distinct fingerprint `fp`; links join those that differ in 3 bits or fewer.

    Each fingerprint makes 261 rows in the two passes; they are dealt so that no task makes more than some millions."""
    fp = F.col("fp")
    tasks = uniq.count() // 20_000 + 1
    uniq = checkpointed(uniq.repartition(tasks, "fp"))
    near = (
        uniq.select(fp, F.explode(F.array(*_ball(fp, list(range(64))))).alias("key"))
        .groupBy("key")
        .agg(F.collect_list("fp").alias("m"))  # 65 at most
        .where(F.size("m") > 1)
        .select(F.explode("m").alias("a"), F.array_min("m").alias("b"))
        .where("a != b")
    )
    first = checkpointed(components(near))
    labelled = checkpointed(uniq.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("comp")).repartition(tasks, "fp"))

    # a key is the fingerprint without one block, with at most one more bit flipped, told apart by the block's salt
    inner = [[b for b in range(64) if b // 16 != block] for block in range(4)]
    cut = [fp.bitwiseAND(F.lit(mask).cast("long")) for mask in MASKS]
    keys = [k.bitwiseXOR(F.lit(SALTS[block]).cast("long")) for block in range(4) for k in _ball(cut[block], inner[block])]
    variants = labelled.select("comp", F.explode(F.array(*keys)).alias("key")).repartition("key")
    shared = checkpointed(variants.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"))
    # who made the shared keys: look the few keys' own balls up among the fingerprints without a block
    key, bare = F.col("key"), F.col("bare")
    asked = shared.select("key", F.explode(F.array(*(F.struct(F.lit(block).alias("block"), key.bitwiseXOR(F.lit(SALTS[block]).cast("long")).alias("bare")) for block in range(4)))).alias("s")).select("key", "s.*")
    asked = asked.where(F.element_at(F.array(*(bare.bitwiseAND(F.lit(_signed(~m)).cast("long")) for m in MASKS)), F.col("block") + 1) == 0)
    asked = asked.select("key", "block", F.explode(F.element_at(F.array(*(F.array(*_ball(bare, inner[block])) for block in range(4))), F.col("block") + 1)).alias("bare"))
    have = labelled.select("fp", "comp", F.posexplode(F.array(*cut)).alias("block", "bare"))
    members = checkpointed(asked.join(have, ["block", "bare"]).select("key", "fp", "comp"))
    x, y = members.alias("x"), members.alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") < F.col("y.comp")) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= 3))
    second = components(pairs.select(F.col("x.comp").alias("a"), F.col("y.comp").alias("b")).distinct())
    return labelled.join(second.withColumnRenamed("node", "comp"), "comp", "left").select("fp", F.coalesce("component", "comp").alias("component"))


def linked_ids(fps: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id, fp, component_id) from rows of (id, fp)."""
    uniq = checkpointed(fps.groupBy("fp").agg(F.min(id_col).alias("first_id")))
    linked = checkpointed(close_fingerprints(uniq.select("fp")))
    named = linked.join(linked.join(uniq, "fp").groupBy("component").agg(F.min("first_id").alias("component_id")), "component").select("fp", "component_id")
    return fps.join(named, "fp").select(id_col, "fp", "component_id")


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, component_id): the smallest id that links of fingerprints reach, for each row of docs."""
    return linked_ids(checkpointed(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle)), id_col=id_col)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

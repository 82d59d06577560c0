"""Near-duplicates of a stated similarity by ball hashing of SimHash tables.

A single 64-bit fingerprint with a radius of 3 finds few texts whose sets of five-word shingles agree by 0.8: their bits differ in some
15 places of 100. Here a text gets 448 SimHash bits or more, cut into tables of about log2 n + 8 bits, each a fingerprint of its own for
which the same half-radius balls meet: two texts whose bits of a table differ in 2 places or fewer share a variant. The number of
tables follows from the wanted recall at the wanted similarity, and the signature's width from the tables.

Hot groups make no quadratic tables of pairs, and no pair that shares a variant goes unseen:

1. Texts with the same set of shingles are one node; nodes with the same bits in a table are one class.
2. Each member is compared with its class's hub by all bits. Those that share far more bits than strangers do, be it by a template, make
   a region.
3. Classes, not members, emit their variants. A variant that several classes share is a bit mask of the flips that lead to them, so a
   variant's group is one row of two numbers however hot it is. A variant brings its class's region along, by a number that the
   largest ones get, and a variant whose classes are all of one region is settled there, before it makes a row for a pair. Hubs of
   classes that aren't of one region yet are compared, too.
4. The members of a region are compared whole, by blocks of signatures, but for those that links which the bits prove have made one
   component: large components take blocks of their own. So are the members of classes and pairs of classes that aren't of one region.
   What comes close returns as trees, at most one edge for each member of a block.
5. Trees with several components left are dealt into blocks again, and these are compared by the sets.

A link is a pair whose sets agree by `least`. It is proven by the sets themselves, but for pairs so close in all bits that a pair below
`least` would come that close once in a million (`SURE` standard deviations). Pairs that are `HOPELESS` standard deviations farther
than `least` (once in 30,000 at `least` itself), or hubs that differ in more than `FIRST_WORD` of their first 64 bits (as rare), aren't
looked at.

Defined results: null and empty texts have no shingles and count as copies of each other; texts of fewer than five words have one shingle.
Rows with a null id never become a group's representative while another id is there. Repeated rows get one row each. Extra columns are
ignored. Long texts are read whole; an empty table gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed, numbered, small_batches
from .graph import Forest, components
from .simhash import shingle_hashes

SURE, HOPELESS, FIRST_WORD = 4.5, 4.0, 22
#: Hubs and members that differ in fewer bits than this share make a region; strangers differ in half of them.
REGION = 0.33
#: Bits of the first word that may differ in it.
REGION_WORD = 26
#: Bits of a family's number at most; as many of the largest families as it can tell apart get one.
FAMILY_BITS = 16
#: Members and bytes of a block, about.
BLOCK, BLOCK_BYTES = 256, 8 << 20


def _shingles(text: bytes | None, n: int) -> np.ndarray:
    parts = list(shingle_hashes(text or b"", n))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def signature(shingles: np.ndarray, words: int = 7) -> np.ndarray:
    """SimHash bits of a set of shingles, 64 a word."""
    out = np.zeros(words, np.int64)
    for k in range(words):
        mult = (0x9E3779B97F4A7C15 * (2 * k + 1) | 1) & (1 << 64) - 1
        votes = np.zeros(64, np.int64)
        for at in range(0, len(shingles), 1 << 14):
            h = shingles[at : at + (1 << 14)] * np.uint64(mult)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
            votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(votes * 2 > len(shingles), bitorder="little").view(np.int64)[0]
    return out


def differing_share(similarity: float) -> float:
    """Share of SimHash bits that differ between sets of this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def distance_limits(similarity: float, n_bits: int) -> tuple[int, int]:
    """Distances up to the first prove the similarity, those beyond the second refute it."""
    p = differing_share(similarity)
    sd = math.sqrt(p * (1 - p) / n_bits)
    return max(0, math.floor((p - SURE * sd) * n_bits)), math.ceil((p + HOPELESS * sd) * n_bits)


def table_plan(n: int, similarity: float, recall: float) -> tuple[int, int]:
    """(tables, bits) for n texts, so that a pair of this similarity shares a variant with the wanted probability."""
    bits = min(max(math.ceil(math.log2(max(n, 2))) + 8, 16), 48)
    p = differing_share(similarity)
    hit = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    return math.ceil(math.log(1 - recall) / math.log(1 - hit)), bits


def signature_words(tables: int, bits: int) -> int:
    """Words of a signature: one that names no table, and what the tables need; 7 at least."""
    return max(7, 1 + -(-tables * bits // 64))


def family_bits(tables: int, bits: int) -> int:
    """Bits of a family's number: what a ball leaves beside key and flip, and what a mask of flips leaves for it and its complement."""
    return max(0, min(FAMILY_BITS, 57 - bits - (tables - 1).bit_length(), (62 - bits) // 2))


def text_hash(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def _table_keys(words: np.ndarray, tables: int, bits: int) -> list[int]:
    """The tables' bits with the table's number above them, from all words but the first."""
    whole = int.from_bytes(words[1:].tobytes(), "little")
    return [(whole >> (t * bits)) & (1 << bits) - 1 | t << bits for t in range(tables)]


def similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted sets agree by `least`; two empty ones do."""
    small, large = sorted((len(x), len(y)))
    if small < least * large:
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= least * (small + large - common)


def _close(groups: np.ndarray, sigs: np.ndarray, split: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of the rows of different groups that differ in `most` bits or fewer: those before `split` with those from it on
    (0: all with all)."""
    n = len(groups)
    d = np.zeros((n, n), np.int32)
    for word in sigs.T:
        d += np.bitwise_count(word[:, None] ^ word[None, :])
    found = np.triu((d <= most) & (groups[:, None] != groups[None, :]), 1)
    if split:
        found[:split, :split] = found[split:, split:] = False
    i, j = np.nonzero(found)
    return i, j, d[i, j]


def block_trees(nodes: np.ndarray, groups: np.ndarray, sigs: np.ndarray, split: int, most: int) -> list[tuple[int, int]]:
    """Pairs of nodes that are close and of different groups, as a forest over nodes."""
    forest = Forest()
    i, j, _ = _close(groups, sigs, split, most)
    return [(a, b) for a, b in zip(nodes[i].tolist(), nodes[j].tolist()) if forest.join(a, b)]


def block_merges(comps: np.ndarray, sigs: np.ndarray, sets: list[np.ndarray], split: int, sure: int, hopeless: int, least: float) -> list[tuple[int, int]]:
    """Pairs of components that links join, as a forest. Pairs are tried from the closest on, and only between different trees."""
    i, j, d = _close(comps, sigs, split, hopeless)
    order = np.argsort(d, kind="stable")
    forest, out = Forest(), []
    for a, b, x in zip(i[order].tolist(), j[order].tolist(), d[order].tolist()):
        p, q = forest.find(int(comps[a])), forest.find(int(comps[b]))
        if p != q and (x <= sure or similar(sets[a], sets[b], least)):
            forest.join(p, q)
            out.append((max(p, q), min(p, q)))
    return out


class _Search:
    """The steps of the module's text over one table of documents."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, shingle: int, least: float, recall: float, planned_rows: int | None, small_bytes: int):
        small_batches(docs.sparkSession)
        text = F.col(text_col).cast("string")
        own = F.struct(F.col(id_col).isNull().alias("nil"), F.col(id_col).alias("id"), text_hash(text).alias("th"))
        self.src = docs.select(own.alias("id"), text.cast("binary").alias("_text"))
        self.shingle, self.least, self.small_bytes = shingle, least, small_bytes
        self.tables, self.bits = table_plan(planned_rows or self.src.count(), least, recall)
        self.words = signature_words(self.tables, self.bits)
        self.sure, self.hopeless = distance_limits(least, 64 * self.words)
        self.loose = max(self.hopeless, math.floor(REGION * 64 * self.words))
        flips = [0] + [1 << b for b in range(self.bits)]
        self.flips = F.array(*(F.lit(f).cast("long") for f in flips))

    def sign(self) -> None:
        """signed: (id, node, sig) of each row; nodes: (node, w0, sig, keys) of each set of shingles."""
        shingle, words, tables, bits = self.shingle, self.words, self.tables, self.bits

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                names, sigs = [], []
                for t in b.column(1):
                    s = _shingles(t.as_py(), shingle)
                    names.append(xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63))
                    sigs.append(signature(s, words).astype("<i8").tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.int64()), pa.array(sigs, pa.binary())], ["id", "node", "sig"])

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                w = np.frombuffer(b"".join(b.column(1).to_pylist()), "<i8").reshape(-1, words)
                keys = [_table_keys(x, tables, bits) for x in w]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w[:, 0], pa.int64()), b.column(1), pa.array(keys, pa.list_(pa.int64()))], ["node", "w0", "sig", "keys"])

        schema = self.src.select("id").schema.add("node", "long").add("sig", "binary")
        self.signed = checkpointed(self.src.mapInArrow(sign, schema))
        found = checkpointed(self.signed.select("node", "sig").dropDuplicates(["node"]))
        self.tasks = found.count() // 10_000 + 1  # all that follows is some rows for each node, or a table's share of them
        unpacked = found.mapInArrow(unpack, "node long, w0 long, sig binary, keys array<long>")
        self.nodes = self.kept(unpacked.repartition(self.tasks, "node"))

    def kept(self, df: DataFrame) -> DataFrame:
        return checkpointed(df.coalesce(self.tasks))

    def classify(self) -> None:
        """classes: (key, hub, w0, n), w0 that of the hub; crowd: (key, hub, node) of the members of classes with several."""
        members = self.nodes.select("node", "w0", F.explode("keys").alias("key"))
        salted = F.col("node").bitwiseXOR(F.xxhash64("key"))  # another smallest member in each table
        classes = members.repartition(self.tasks, "key").groupBy("key").agg(F.min(salted).alias("hub"), F.min_by("w0", salted).alias("w0"), F.count("*").alias("n"))
        self.classes = self.kept(classes.select("key", F.col("hub").bitwiseXOR(F.xxhash64("key")).alias("hub"), "w0", "n"))
        several = self.kept(self.classes.where("n > 1").select("key", "hub"))
        self.members = members.select("key", "node")
        self.crowd = self.kept(self.members.join(self.small(several), "key"))

    def small(self, df: DataFrame) -> DataFrame:
        return broadcast_if_small(df, self.small_bytes)

    def spread(self, families: DataFrame) -> DataFrame:
        """(key, lo, hi): the smallest and largest family among the members of each class with several."""
        family = F.coalesce("component", "node")
        members = self.crowd.join(families, "node", "left").groupBy("key")
        return self.kept(members.agg(F.min(family).alias("lo"), F.max(family).alias("hi")))

    def state(self, classes: DataFrame, families: DataFrame, spread: DataFrame) -> DataFrame:
        """classes with lo and hi: the smallest and largest family of each."""
        own = classes.join(families.withColumnRenamed("node", "hub"), "hub", "left").join(self.small(spread), "key", "left")
        family = F.coalesce("component", "hub")
        return own.withColumns({"lo": F.coalesce("lo", family), "hi": F.coalesce("hi", family)}).drop("component")

    def numbered(self, families: DataFrame, spread: DataFrame, width: int) -> DataFrame:
        """(key, family) of all classes: one of the largest families, by its number from 1 to 2^width - 1, if all members are of it, else 0."""
        order = F.desc("count"), F.col("component")
        largest = families.groupBy("component").count().orderBy(*order).limit((1 << width) - 1)
        largest = self.kept(largest.select("component", F.row_number().over(W.orderBy(*order)).cast("long").alias("family")))
        nodes = self.small(self.kept(families.join(F.broadcast(largest), "component").select(F.col("node").alias("hub"), "family")))
        mixed = self.small(self.kept(spread.where("lo < hi").select("key", F.lit(True).alias("mixed"))))
        family = F.when(F.col("mixed").isNull(), F.col("family"))
        return self.classes.join(nodes, "hub", "left").join(mixed, "key", "left").select("key", F.coalesce(family, F.lit(0).cast("long")).alias("family"))

    def shared(self, families: DataFrame, spread: DataFrame) -> DataFrame:
        """(variant, mask) of the variants that several classes share, but for those whose classes are all of one numbered family.

        A ball is one number: the family, the variant, and which flip leads to the class. What a group has of the families' bits, and of
        their complements' bits, has nothing in common only where all are one family; without a number a class has all bits of both."""
        tables_bits = self.bits + (self.tables - 1).bit_length()
        width = family_bits(self.tables, self.bits)
        classes = self.numbered(families, spread, width) if width else self.classes.select("key", F.lit(0).cast("long").alias("family"))
        balls = classes.select("key", "family", F.posexplode(self.flips).alias("at", "flip"))
        balls = balls.select(F.expr(f"shiftleft(family, {6 + tables_bits}) | shiftleft(key ^ flip, 6) | at").alias("ball"))
        variant = F.shiftright("ball", 6).bitwiseAND(F.lit((1 << tables_bits) - 1).cast("long"))
        ones, flags = (1 << width) - 1, (1 << self.bits + 1) - 1
        family = f"shiftright(ball, {6 + tables_bits})"
        both = f"if({family} = 0, {ones << width | ones}L, {family} | shiftleft({family} ^ {ones}L, {width}))"
        found = F.bit_or(F.expr(f"shiftleft(1L, cast(ball & 63 as int)) | shiftleft({both}, {self.bits + 1})")).alias("found")
        groups = balls.repartition(variant).groupBy(variant.alias("variant")).agg(found)  # one number a row
        apart = f"shiftright(found, {self.bits + 1}) & shiftright(found, {self.bits + 1 + width}) & {ones}L" if width else "1"
        return self.kept(groups.where(f"bit_count(found & {flags}L) > 1 AND ({apart}) != 0").select("variant", F.expr(f"found & {flags}L").alias("mask")))

    def class_pairs(self, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(k1, k2) of classes that share a variant, and wide: (variant, keys) of the variants with more than four classes. There the
        first meets the others, and wide holds them all.

        Two classes share two variants, in one of which the later one, by flips, is above the variant: that one makes the pair, or, where
        it is wide, holds it. A class has at most bits + 1 variants, and a variant makes at most 1.5 rows for each of its classes."""
        # the flip of a mask's bit is half its value
        two = groups.where("bit_count(mask) = 2").selectExpr("variant ^ shiftright(mask & -mask, 1) AS k1", "variant ^ shiftright(mask ^ (mask & -mask), 1) AS k2", "variant")
        two = two.where("k2 > variant").drop("variant")
        bit_set = F.filter(F.sequence(F.lit(0), F.lit(self.bits)), lambda i: F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)
        keys = F.transform(bit_set, lambda i: F.col("variant").bitwiseXOR(F.element_at(self.flips, i + 1)))
        more = groups.where("bit_count(mask) > 2").select("variant", keys.alias("keys"))
        firsts = F.posexplode(F.expr("slice(keys, 1, if(size(keys) > 4, 1, size(keys)))")).alias("at", "k1")
        others = "filter(slice(keys, at + 2, size(keys)), k -> k > variant OR size(keys) > 4)"
        more_pairs = more.select("variant", "keys", firsts).select("k1", F.explode(F.expr(others)).alias("k2"))
        return two.union(more_pairs).select(F.least("k1", "k2").alias("k1"), F.greatest("k1", "k2").alias("k2")), more.where("size(keys) > 4")

    def meet(self, families: DataFrame) -> None:
        """met: (k1, k2, hub, node, n, near) of classes that share a variant and aren't of one family: their hubs, members in all, and
        whether the hubs may be alike. Pairs of single members that may not are settled and left out. wide: as class_pairs has it."""
        spread = self.spread(families)
        pairs, wide = self.class_pairs(self.shared(families, spread))
        state = self.state(self.classes, families, spread).select("key", "hub", "w0", "n", "lo", "hi")
        c1, c2 = (state.toDF(f"k{k}", f"h{k}", f"w{k}", f"n{k}", f"lo{k}", f"hi{k}") for k in (1, 2))
        near = F.bit_count(F.col("w1").bitwiseXOR(F.col("w2"))) <= FIRST_WORD
        open_pair = (F.col("k2") == F.col("c2")) & F.expr("least(lo1, lo2) < greatest(hi1, hi2)") & (near | (F.col("n1") + F.col("n2") > 2))
        met = pairs.distinct().join(c1, "k1").join(c2.withColumnRenamed("k2", "c2"), open_pair)
        met = met.select("k1", "k2", F.col("h1").alias("hub"), F.col("h2").alias("node"), (F.col("n1") + F.col("n2")).alias("n"), near.alias("near"))
        self.met = self.kept(met)
        self.wide = self.kept(wide)

    def measured(self, pairs: DataFrame) -> DataFrame:
        """(a, b, d) of those pairs (a, b) of nodes that are of one region."""
        words = self.words

        def distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                x, y = (np.frombuffer(b"".join(t.column(i).to_pylist()), "<u8").reshape(-1, words) for i in (2, 3))
                d = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(d)], ["a", "b", "d"])

        narrow, wide = self.nodes.select("node", "w0"), self.nodes.select("node", "sig")
        far = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) > REGION_WORD
        near = pairs.join(narrow.toDF("a", "x"), "a").join(narrow.toDF("b", "y"), "b").where(~far)
        both = near.select("a", "b").join(wide.toDF("a", "x"), "a").join(wide.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return self.kept(both.mapInArrow(distance, "a long, b long, d long").where(F.col("d") <= self.loose))

    def sets(self, asked: DataFrame) -> DataFrame:
        """(node, s) of the nodes asked for: their sorted shingles, from their texts."""
        shingle = self.shingle
        wanted = self.kept(self.signed.join(asked, "node").groupBy("node").agg(F.min("id.th").alias("th")))
        texts = self.src.select(F.col("id.th").alias("th"), "_text").join(self.small(wanted), "th").select("node", "_text").dropDuplicates(["node"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                s = [_shingles(x.as_py(), shingle).view(np.int64) for x in t.column(1)]
                yield pa.RecordBatch.from_arrays([t.column(0), pa.array(s, pa.list_(pa.int64()))], ["node", "s"])

        return texts.mapInArrow(cut, "node long, s array<long>")

    def leftovers(self, families: DataFrame) -> DataFrame | None:
        """(a, b): close nodes of different regions, inside classes and pairs of classes that aren't of one; None if all are."""
        spread = self.spread(families)
        of_class, of_node = spread, families

        def unsettled(pairs: DataFrame) -> DataFrame:
            """Those pairs (k1, k2, hub, node) of classes whose members are of several families."""
            ends = pairs.join(of_node.toDF("hub", "c1"), "hub", "left").join(of_node.toDF("node", "c2"), "node", "left")
            for k, own in ((1, "hub"), (2, "node")):
                ends = ends.join(of_class.toDF(f"k{k}", f"lo{k}", f"hi{k}"), f"k{k}", "left")
                for side in ("lo", "hi"):
                    ends = ends.withColumn(f"{side}{k}", F.coalesce(f"{side}{k}", f"c{k}", own))
            return ends.where("least(lo1, lo2) < greatest(hi1, hi2)").select("k1", "k2")

        split = spread.where("lo < hi").join(self.classes.where("n > 2").select("key"), "key", "left_semi")
        turns = split.select(F.col("key").alias("k1"), F.col("key").alias("k2")).union(unsettled(self.met.where("n > 2")))
        if not self.wide.isEmpty():
            each = self.wide.select("variant", F.explode("keys").alias("key")).join(self.classes, "key")
            each = self.state(each, families, spread)
            groups = each.groupBy("variant").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_list(F.struct("key", "lo", "hi"))).alias("m"))
            groups = groups.where("lo < hi").select("m", F.posexplode("m").alias("at", "x"))
            others = "filter(slice(m, at + 2, size(m)), y -> least(x.lo, y.lo) < greatest(x.hi, y.hi))"
            turns = turns.union(groups.select(F.col("x.key").alias("k1"), F.explode(F.expr(others)).alias("y")).select("k1", "y.key"))
        turns = self.kept(turns.distinct())
        if turns.isEmpty():
            return None
        keys = self.kept(turns.select("k1").union(turns.select("k2")).distinct().toDF("key"))
        inside = self.members.join(self.small(keys), "key").join(of_node, "node", "left")
        rows = inside.select("key", "node", F.coalesce("component", "node").alias("group"), F.lit(64).alias("bytes"))
        return self.compared(turns, self.kept(rows), None)

    def compared(self, turns: DataFrame, inside: DataFrame, sets: DataFrame | None) -> DataFrame:
        """(a, b) of what joins groups among (key, node, group, bytes), for each turn (k1, k2) of keys: close nodes of different groups,
        or, with sets (node, s), groups with a link that the sets prove.

        Members are dealt into blocks, those of a large group into blocks of its own, which aren't compared with one another."""
        parts = inside.groupBy("key", "group").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
        large = (F.col("n") >= BLOCK // 2) | (F.col("bytes") >= BLOCK_BYTES // 2)
        parts = parts.withColumn("own", F.when(large, F.col("group")))
        dealt = parts.groupBy("key", "own").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
        blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES))
        dealt = dealt.select(F.col("key").alias("k"), F.col("own").alias("o"), blocks.alias("blocks"))
        placed = parts.select("key", "group", "own").join(dealt, F.expr("key = k AND own <=> o")).select("key", "group", "own", "blocks")
        block = F.xxhash64("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
        rows = inside.join(placed, ["key", "group"]).select("key", "own", block.alias("block"), "node", "group")
        rows = rows.join(self.nodes.select("node", "sig"), "node")
        rows = rows.join(sets, "node") if sets is not None else rows.withColumn("s", F.lit(None).cast("array<long>"))
        whole = self.kept(rows.groupBy("key", "own", "block").agg(F.collect_list(F.struct("node", "group", "sig", "s")).alias("m")))
        one, two = (whole.withColumnsRenamed({"key": f"k{k}", "own": f"o{k}", "block": f"b{k}", "m": f"m{k}"}) for k in (1, 2))
        own = whole.where("own IS NULL").join(turns.where("k1 = k2").select(F.col("k1").alias("key")), "key", "left_semi")
        names = turns.join(one.drop("m1"), "k1").join(two.drop("m2"), "k2")
        names = names.where("(k1 < k2 OR b1 < b2) AND (o1 IS NULL OR o2 IS NULL OR o1 != o2)")
        pairs = names.join(one.drop("o1"), ["k1", "b1"]).join(two.drop("o2"), ["k2", "b2"]).select("m1", "m2")
        pairs = pairs.union(own.where("size(m) > 1").select(F.col("m").alias("m1"), F.lit(None).cast(whole.schema["m"].dataType).alias("m2")))
        sure, hopeless, least, words, by_sets = self.sure, self.hopeless, self.least, self.words, sets is not None

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                for k in range(t.num_rows):
                    sides = [c[k].values for c in t.columns if c[k].is_valid]
                    nodes, groups = (np.concatenate([m.field(c).to_numpy() for m in sides]) for c in ("node", "group"))
                    sigs = np.concatenate([np.frombuffer(b"".join(m.field("sig").to_pylist()), "<u8").reshape(-1, words) for m in sides])
                    split = len(sides[0]) if len(sides) == 2 else 0
                    if by_sets:
                        s = [np.sort(x.values.to_numpy().view(np.uint64)) for m in sides for x in m.field("s")]
                        found = block_merges(groups, sigs, s, split, sure, hopeless, least)
                    else:
                        found = block_trees(nodes, groups, sigs, split, hopeless)
                    yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        return self.kept(pairs.mapInArrow(compare, "a long, b long").distinct())

    def run(self) -> DataFrame:
        """(id, component) of each row."""
        self.sign()
        self.classify()

        def pairs(rows: DataFrame) -> DataFrame:
            return rows.where("node != hub").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()

        def joined(*edges: DataFrame) -> DataFrame:
            whole = edges[0].toDF("a", "b")
            for e in edges[1:]:
                whole = whole.union(e.toDF("a", "b"))
            return components(whole)

        def grouped(keys: DataFrame, comps: DataFrame) -> DataFrame | None:
            """(key, node, group) of the nodes of keys (node, component) with members of several components; None if there are none."""
            group = F.coalesce("component", "node").alias("group")
            members = keys.toDF("node", "key").join(comps, "node", "left").select("key", "node", group)
            several = members.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("key")
            members = self.kept(members.join(several, "key"))
            return None if members.isEmpty() else members

        def inside(members: DataFrame) -> DataFrame:
            return self.kept(members.select(F.col("key").alias("k1"), F.col("key").alias("k2")).distinct())

        stars = self.measured(pairs(self.crowd))
        regions = joined(stars.select("a", "b"))
        self.meet(self.small(regions))
        links = stars.union(self.measured(pairs(self.met.where("near"))))
        regions = self.small(joined(regions, links.select("a", "b")))
        comps = joined(links.where(F.col("d") <= self.sure).select("a", "b"))

        trees = [e for e in [self.leftovers(regions)] if e is not None]
        members = grouped(regions, comps)
        if members is not None:
            trees.append(self.compared(inside(members), self.kept(members.withColumn("bytes", F.lit(64))), None))
        members = grouped(joined(*trees), comps) if trees else None
        if members is not None:
            sets = checkpointed(self.sets(members.select("node")))
            sized = members.join(sets.select("node", (8 * F.size("s") + 64).alias("bytes")), "node").select("key", "node", "group", "bytes")
            comps = joined(comps, self.compared(inside(members), self.kept(sized), sets))
        return self.signed.select("id", "node").join(comps, "node", "left").select("id", F.coalesce("component", "node").alias("component"))


def near_duplicate_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, recall: float = 0.97, planned_rows: int | None = None, small_bytes: int = 32 << 20) -> DataFrame:
    """(id, text_hash, component_id, component_hash) of each row: the group's first row by id, null last, then by the text's hash.

    Rows are known by id and text, so null and repeated ids don't mix texts. planned_rows: rows that the tables are planned for, where
    not the number of docs' rows."""
    rows = checkpointed(_Search(docs, id_col, text_col, shingle, least, recall, planned_rows, small_bytes).run())
    first = rows.groupBy("component").agg(F.min("id").alias("c"))
    named = rows.join(first, "component")
    return named.select(F.col("id.id").alias(id_col), F.col("id.th").alias("text_hash"), F.col("c.id").alias("component_id"), F.col("c.th").alias("component_hash"))


def near_duplicate_groups(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """(id, component_id): the smallest id of each row's group of near-duplicates."""
    return near_duplicate_rows(docs, id_col=id_col, **options).select(id_col, "component_id")


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each group of near-duplicates.

    Rows are known by id and text. The smallest id stays, null only where the group has no other, then the smallest hash of the text; of
    rows that agree in both, the one with the smallest hash of all columns."""
    plain, names = numbered(docs)
    own_id, own_text = F.col(names[id_col]), text_hash(F.col(names[text_col]))
    groups = near_duplicate_rows(plain, id_col=names[id_col], text_col=names[text_col], **options)
    groups = checkpointed(groups.toDF("id", "th", "first", "first_th"))
    stays = F.expr("id <=> first AND th = first_th")
    gone = groups.where(~stays).select("id", "th").distinct()
    again = groups.where(stays).groupBy("id", "th").count().where("count > 1").select("id", "th")
    settled = gone.withColumn("gone", F.lit(True)).union(again.withColumn("gone", F.lit(False)))
    settled = broadcast_if_small(checkpointed(settled), options.get("small_bytes", 32 << 20))
    marked = plain.join(settled, own_id.eqNullSafe(F.col("id")) & (own_text == F.col("th")), "left")
    once = marked.where("gone IS NULL").select(*plain.columns)
    columns = F.struct(*plain.columns)
    one = F.min_by(columns, F.xxhash64(F.to_json(columns))).alias("r")
    repeated = marked.where("NOT gone").groupBy(own_id, own_text).agg(one).select("r.*")
    return once.union(repeated).toDF(*docs.columns)

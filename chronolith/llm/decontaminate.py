"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Texts become lower-case runs of letters and digits. Fixed masks pick a few tokens at each position and ignore the others; masked hashes
of benchmark items meet those of documents. A hit fixes an alignment; the item's tokens are then compared one by one along it, and a
document is contaminated if in some window of 13 tokens (the whole item if it is shorter) 80 % agree.

An item's length chooses its masks, so that they hit every placement of the wrong tokens that 80 % allow: two masks of five tokens for
windows of 13 (two wrong), two of four for 10 to 12 (two wrong), one of four for 8 and 9 (one wrong), two of three for 5 to 7 (one
wrong), and all tokens in a row below (none wrong). Documents are hashed by the masks that the benchmark needs, no others.

Scale: the benchmark's hashes are broadcast only while they are small, else both sides are shuffled by hash. Hits are rows of
(document, item, alignment), written once; only documents with a hit are tokenised again.

Defined results: null and empty texts and items without a token match nothing. A row is known by its id and a hash of its text, so
repeated rows and null ids get one result each; items with a null id count like others. An empty benchmark leaves all documents clean.
Ties for the best item go to the smaller id. Extra columns are ignored, or kept as they are by `decontaminate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed, numbered, table

#: Masks by the length of the windows that they serve, from the given length up to the next.
MASKS = {1: ((0,),), 2: ((0, 1),), 3: ((0, 1, 2),), 4: ((0, 1, 2, 3),), 5: ((0, 1, 2), (0, 1, 3)), 8: ((0, 1, 2, 3),), 10: ((0, 1, 2, 3), (0, 1, 2, 4)), 13: ((0, 1, 3, 7, 8), (0, 2, 4, 5, 6))}
#: Below this length no token may be wrong, and the first place of an item in a document speaks for all.
EXACT_BELOW = 5


def masks_for(length: int) -> tuple[tuple[int, ...], ...]:
    return MASKS[max(k for k in MASKS if k <= length)]


def token_hashes(text: Column) -> Column:
    """Hashes of the text's tokens, in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, keys: list[str], at: str, masks: list[tuple[int, ...]]) -> DataFrame:
    """(keys, at, seed) for each mask and position of the array column `w`."""
    offsets = sorted({o for m in masks for o in m})
    zipped = F.arrays_zip(*(F.slice("w", F.lit(o + 1), F.greatest(F.size("w") - o, F.lit(0))).alias(f"c{o}") for o in offsets))
    each = df.where(F.size("w") >= min(max(m) for m in masks) + 1).select(*keys, F.posexplode(zipped).alias(at, "s"))
    hashed = [F.when(F.col(f"s.c{m[-1]}").isNotNull(), F.xxhash64(F.lit(",".join(map(str, m))), *(F.col(f"s.c{o}") for o in m))) for m in masks]
    return each.select(*keys, at, F.explode(F.array(*hashed)).alias("seed")).where(F.col("seed").isNotNull())


def _best_overlap(doc: Column, item: Column, diagonal: Column, window: int) -> Column:
    """Largest share of equal tokens over windows of the item, laid on the document at `diagonal`."""
    same = F.transform(item, lambda x, j: F.when((j + diagonal >= 0) & (j + diagonal < F.size(doc)), (F.get(doc, j + diagonal) == x).cast("int")).otherwise(0))
    n = F.least(F.lit(window), F.size(item))
    sums = F.transform(F.sequence(F.lit(1), F.size(item) - n + 1), lambda s: F.aggregate(F.slice(same, s, n), F.lit(0), lambda a, x: a + x))
    return F.array_max(sums) / n


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, least: float = 0.8, small_bytes: int = 32 << 20) -> DataFrame:
    """(id, text_hash, n_items, best_item, best_overlap) of each distinct contaminated row."""
    if not 1 <= window <= 13 or least < 0.8:
        raise ValueError("the masks serve windows of 13 tokens or fewer and shares of 0.8 or more")
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_th"), text.alias("_text"))
    own = F.col(item_text_col).cast("string")
    items = benchmark.select(F.col(item_col).alias("_item"), F.xxhash64(F.col(item_col), own).alias("_key"), token_hashes(own).alias("w")).where(F.size("w") > 0).dropDuplicates(["_key"])
    length = F.least(F.size("w"), F.lit(window))
    serves = F.element_at(F.array(*(F.lit(max(k for k in MASKS if k <= n)) for n in range(1, 14))), length)
    items = checkpointed(items.withColumn("_serves", serves))
    used = sorted(r["_serves"] for r in items.select("_serves").distinct().collect()) or [13]
    seeds = None
    for k in used:
        some = _seeds(items.where(F.col("_serves") == k), ["_key", "_serves"], "_ipos", list(MASKS[k]))
        seeds = some if seeds is None else seeds.union(some)
    seeds = broadcast_if_small(checkpointed(seeds.distinct()), small_bytes)
    masks = sorted({m for k in used for m in MASKS[k]})
    hashed = _seeds(src.select("_id", "_th", token_hashes(F.col("_text")).alias("w")), ["_id", "_th"], "_pos", masks)
    hits = hashed.join(seeds, "seed").select("_id", "_th", "_key", "_serves", (F.col("_pos") - F.col("_ipos")).alias("_diag"))
    place = F.when(F.col("_serves") >= EXACT_BELOW, F.col("_diag")).alias("_place")
    hits = checkpointed(hits.groupBy("_id", "_th", "_key", place).agg(F.min("_diag").alias("_diag")).drop("_place"))
    suspects = broadcast_if_small(checkpointed(hits.select("_id", "_th").distinct()), small_bytes)
    again = src.alias("d").join(suspects.alias("s"), F.col("d._id").eqNullSafe(F.col("s._id")) & (F.col("d._th") == F.col("s._th")), "left_semi")
    again = again.dropDuplicates(["_id", "_th"]).select("_id", "_th", token_hashes(F.col("_text")).alias("_dw"))
    laid = hits.join(broadcast_if_small(items, small_bytes), "_key")
    pairs = laid.alias("h").join(again.alias("d"), (F.col("h._th") == F.col("d._th")) & F.col("h._id").eqNullSafe(F.col("d._id")))
    overlap = _best_overlap(F.col("_dw"), F.col("w"), F.col("_diag"), window).alias("_o")
    scored = pairs.select(F.col("h._id").alias("_id"), F.col("h._th").alias("_th"), "_item", "_key", overlap).where(F.col("_o") >= least)
    best = F.min_by("_item", F.struct(-F.col("_o"), F.col("_item"))).alias("best_item")
    found = scored.groupBy("_id", "_th").agg(F.countDistinct("_key").alias("n_items"), best, F.max("_o").alias("best_overlap"))
    return found.withColumnsRenamed({"_id": id_col, "_th": "text_hash"})


def _joined(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, how: str, options: dict) -> DataFrame:
    """docs, its columns renamed by their place, joined with what is contaminated."""
    plain, names = numbered(docs)
    found = contaminated(plain, benchmark, id_col=names[id_col], text_col=names[text_col], **options)
    found = broadcast_if_small(checkpointed(found.withColumnsRenamed({names[id_col]: "_id", "text_hash": "_th"})))
    return plain.join(found, plain[names[id_col]].eqNullSafe(F.col("_id")) & (F.xxhash64(plain[names[text_col]].cast("string")) == F.col("_th")), how)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns."""
    return _joined(docs, benchmark, id_col, text_col, "left_anti", options).toDF(*docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    every = _joined(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text", "left", {})
    n_items, overlap = F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("best_overlap", F.lit(0.0)).alias("best_overlap")
    return every.select(F.col("in0").alias("doc_id"), F.col("_th").isNotNull().alias("contaminated"), n_items, "best_item", overlap)


#: DuckDB compares every item with every alignment that two equal pairs of neighbours suggest (all of them, for shorter items), without
#: masks or hashes.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
k AS (SELECT item_id, len(w) AS n, least(13, len(w)) AS l, w FROM b WHERE len(w) >= 1),
bt AS (SELECT item_id, n, l, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM k),
dt AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
b2 AS (SELECT item_id, n, l, i, t, lead(t) OVER (PARTITION BY item_id ORDER BY i) AS u FROM bt),
d2 AS (SELECT doc_id, p, t, lead(t) OVER (PARTITION BY doc_id ORDER BY p) AS u FROM dt),
c AS (SELECT doc_id, item_id, n, l, p - i AS g FROM d2 JOIN b2 USING (t, u) GROUP BY ALL HAVING count(*) >= least(2, n - 1)
  UNION SELECT doc_id, item_id, n, l, p - i AS g FROM dt JOIN bt USING (t) WHERE n = 1),
e AS (SELECT c.doc_id, c.item_id, c.n, c.l, c.g, bt.i FROM c JOIN bt ON bt.item_id = c.item_id JOIN dt ON dt.doc_id = c.doc_id AND dt.p = bt.i + c.g AND dt.t = bt.t),
s AS (SELECT doc_id, item_id, g, l, i, count(*) OVER (PARTITION BY doc_id, item_id, g ORDER BY i RANGE BETWEEN l - 1 PRECEDING AND CURRENT ROW) AS m FROM e),
o AS (SELECT doc_id, item_id, max(m / l) AS o FROM s GROUP BY ALL HAVING max(m / l) >= 0.8),
f AS (SELECT doc_id, count(*) AS n_items, min_by(item_id, (-o, item_id)) AS best_item, max(o) AS best_overlap FROM o GROUP BY doc_id)
SELECT doc_id, f.n_items IS NOT NULL AS contaminated, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, best_item, coalesce(best_overlap, 0.0) AS best_overlap
FROM documents LEFT JOIN f USING (doc_id)
"""

"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams on a bounded sample of labelled documents (a parameter), as a Spark aggregation over
(language, bucket). The log-probability matrix, languages x buckets, is broadcast; its size depends on the number of
languages alone. Scoring walks whole texts in numpy, in blocks of bounded size, inside mapInArrow without any shuffle.

Defined results: a null text, an empty text and a text without a letter are `und` with score 0. Rows with a null id
are scored but never learned from. Without any labelled row everything is `und`. Ties between languages go to the
smaller code. Repeated rows are scored alike. Extra columns are ignored, but for those that `score_languages` is asked to keep; of these,
ones named lang_pred or score are replaced by what it adds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import blocks, bounded_ids, broadcast_if_small, checkpointed, crc_mod, small_batches, table

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
BLOCK = 1 << 19
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _buckets(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Start of each text, an array of bucket numbers for each n-gram order, and the letters in each text.

    Runs of other characters count as one space. An n-gram that would cross texts gets bucket BUCKETS."""
    codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    c = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    letter = _letters()[c]
    if len(c):
        keep = letter.copy()
        keep[0] = True
        keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
        c, owner, letter = np.where(letter, c, np.uint32(32))[keep], owner[keep], letter[keep]
    n_letters = np.bincount(owner, weights=letter, minlength=len(texts)).astype(np.int64)
    starts = np.searchsorted(owner, np.arange(len(texts)))
    out = []
    for n in ORDERS:
        h = np.full(max(len(c) - n + 1, 0), 0x811C9DC5 + n, np.uint32)
        for k in range(n):
            h *= np.uint32(0x01000193)
            h ^= c[k : len(c) - n + 1 + k]
            h ^= h >> np.uint32(13)
        h *= np.uint32(0x2C1B3C6D)
        b = np.full(len(c), BUCKETS, np.int32)
        b[: len(h)] = (h >> np.uint32(7)) & np.uint32(BUCKETS - 1)
        if n > 1:
            b[: len(h)][owner[: len(h)] != owner[n - 1 :]] = BUCKETS
        out.append(b)
    return starts, out, n_letters


def _slices(text: str, limit: int = BLOCK) -> list[str]:
    """A very long text as slices that overlap by the longest n-gram less one."""
    if len(text) <= limit:
        return [text]
    step = limit - (max(ORDERS) - 1)
    return [text[i : i + limit] for i in range(0, max(1, len(text) - max(ORDERS) + 1), step)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for block in blocks(enumerate(t.as_py() for t in batch.column(1)), BLOCK):
            for row, text in block:
                own = counts.setdefault(langs[row], np.zeros(BUCKETS + 1, np.int64))
                for part in _slices(text):
                    for b in _buckets([part])[1]:
                        own += np.bincount(b, minlength=BUCKETS + 1)
    for lang, c in counts.items():
        at = np.flatnonzero(c[:BUCKETS])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])


class LanguageModel:
    """Languages, and log probabilities as (BUCKETS + 1) x languages with a last row of zeros."""

    def __init__(self, langs: list[str], weights: np.ndarray):
        self.langs, self.weights = langs, weights

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        sums = np.zeros((len(texts), len(self.langs)))
        letters = np.zeros(len(texts), np.int64)
        cut = [_slices(t) for t in texts]
        for k in range(max(map(len, cut), default=0)):
            rows = [i for i, s in enumerate(cut) if k < len(s)]
            starts, orders, n = _buckets([cut[i][k] for i in rows])
            letters[rows] += n
            size = len(orders[0])
            full = np.diff(np.append(starts, size)) > 0
            at = np.array(rows)[full]
            if size:
                for b in orders:
                    sums[at] += np.add.reduceat(self.weights[b], starts[full], axis=0)
        best = sums.argmax(axis=1)
        p = np.exp(sums - sums[np.arange(len(texts)), best][:, None])
        p = 1 / p.sum(axis=1)
        return [(self.langs[b], float(s)) if n else (UNKNOWN, 0.0) for b, s, n in zip(best, p, letters)]


def fit_languages(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 600, most: int = 20_000, alpha: float = 0.05, seed: int = 11) -> LanguageModel:
    """Fit on at most `per_language` documents of each language and `most` in all; of repeated ids one text; prior: uniform."""
    small_batches(docs.sparkSession)
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    known = docs.where(lang.isNotNull() & text.isNotNull()).select(F.col(id_col).alias("id"), lang.alias("lang"), text.alias("text"))
    ids = bounded_ids(known, ["lang"], "id", per_language, most, seed)
    rows = known.join(broadcast_if_small(checkpointed(ids)), ["id", "lang"])
    sample = rows.groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("lang", "text")
    counted = sample.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(counted["lang"].to_pylist(), object)
    langs = sorted(set(names.tolist()))
    c = np.zeros((BUCKETS + 1, len(langs)))
    if langs:
        c[counted["bucket"].to_numpy(), np.searchsorted(langs, names.astype(str))] = counted["n"].to_numpy()
        c[:BUCKETS] = np.log((c[:BUCKETS] + alpha) / (c[:BUCKETS].sum(axis=0) + alpha * BUCKETS))
    return LanguageModel(langs, c.astype(np.float32))


def score_languages(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """`id_col`, the columns in `keep`, lang_pred and score for each row of docs, in one narrow pass.

    A text that is kept is sent to Python once."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((model.langs, model.weights))
    held = [c for c in dict.fromkeys([id_col, *keep]) if c not in ("lang_pred", "score")]
    own_text = [] if text_col in held and docs.schema[text_col].dataType == StringType() else [F.col(text_col).cast("string").alias("_text")]
    at = len(held) if own_text else held.index(text_col)
    src = docs.select(*(F.col(c).alias(f"in{k}") for k, c in enumerate(held)), *own_text)
    schema = src.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    width = len(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*shared.value)
        for batch in batches:
            found: list[tuple[str, float]] = []
            for block in blocks(enumerate(t.as_py() for t in batch.column(at)), BLOCK):
                found += own.predict([t for _, t in block])
            cols = [*batch.columns[:width], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:width], "lang_pred", "score"])

    return src.mapInArrow(run, schema).toDF(*held, "lang_pred", "score")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(crc_mod("doc_id", 5) != 0))
    return score_languages(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")

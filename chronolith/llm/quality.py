"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of 512 bytes that cover all of it. Each byte becomes a learned vector of 8 numbers, and one more
channel says how much of its neighbourhood repeats at some short lag, which no filter of 8 bytes can see by itself. Learned filters of
8 bytes slide over a chunk in steps of 4; their rectified outputs are max-pooled over each chunk and then over all chunks of the text, and
a logistic layer combines the maxima into a probability. Training (Adam, on the driver) sees all chunks of a bounded sample of
labelled rows, in blocks; scoring reads all chunks of all rows, in one narrow pass.

Defined results: a null or empty text has no chunk, so its maxima are 0 and its score is the network's bias alone, which such rows of the
sample train too. Labels are joined by id; a document with two labels counts with each, and of repeated ids one text is learned from. Rows
with a null id or label are never learned from. Without rows of both labels each score is the share of label 1, or 0.5 without any label.
Repeated rows are scored alike; extra columns are ignored. A text's zero bytes count as padding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_ids, crc_mod, sampled_rows, sigmoid, table

CHUNK, OVERLAP, STEP = 512, 32, 4
CELL, LAGS = 16, range(2, 17)
FILTERS, EMBED = 32, 8
CHANNELS = EMBED + 1
SPAN = 2 * STEP


def chunks(text: bytes) -> np.ndarray:
    """All chunks of a text, padded with zeros; none for the empty text."""
    step = CHUNK - OVERLAP
    n = 0 if not text else 1 + max(0, -(-(len(text) - CHUNK) // step))
    out = np.zeros((n, CHUNK), np.uint8)
    data = np.frombuffer(text, np.uint8)
    for k in range(n):
        part = data[k * step : k * step + CHUNK]
        out[k, : len(part)] = part
    return out


def repetition(x: np.ndarray) -> np.ndarray:
    """(chunks, CHUNK / CELL): the largest share of a cell's bytes that equal the byte some lag before."""
    best = np.zeros((len(x), CHUNK // CELL), np.float32)
    filled = x > 0
    for lag in LAGS:
        same = np.zeros((len(x), CHUNK), bool)
        same[:, lag:] = (x[:, lag:] == x[:, :-lag]) & filled[:, lag:]
        np.maximum(best, same.reshape(len(x), CHUNK // CELL, CELL).sum(axis=2, dtype=np.uint8), out=best)
    return best / CELL


@dataclass
class QualityModel:
    vectors: np.ndarray  # 256, EMBED; those of byte 0 are 0
    filters: np.ndarray  # SPAN * CHANNELS, FILTERS
    offsets: np.ndarray
    weights: np.ndarray
    bias: float

    def responses(self, x: np.ndarray, rep: np.ndarray) -> np.ndarray:
        """(chunks, places, FILTERS) rectified outputs."""
        a = np.empty((len(x), CHUNK, CHANNELS), np.float32)
        a[:, :, :-1] = self.vectors[x]
        a[:, :, -1] = np.repeat(rep, CELL, axis=1)
        a = a.reshape(len(x), CHUNK // STEP, STEP * CHANNELS)
        half = STEP * CHANNELS
        r = a[:, :-1] @ self.filters[:half] + a[:, 1:] @ self.filters[half:]
        r += self.offsets
        return np.maximum(r, 0, out=r)

    def scores(self, texts: list[bytes | None], at_once: int = 256) -> list[float]:
        """Probability of each text; memory holds `at_once` chunks' channels at a time."""
        top = np.zeros((len(texts), len(self.weights)), np.float32)
        held: list[np.ndarray] = []
        owner: list[np.ndarray] = []

        def flush() -> None:
            x, own = np.concatenate(held), np.concatenate(owner)
            for k in range(0, len(x), at_once):
                part, o = x[k : k + at_once], own[k : k + at_once]
                best = self.responses(part, repetition(part)).max(axis=1)
                first = np.flatnonzero(np.diff(o, prepend=-1))
                top[o[first]] = np.maximum(top[o[first]], np.maximum.reduceat(best, first))
            held.clear()
            owner.clear()

        size = 0
        for i, text in enumerate(texts):
            data = text or b""
            for at in range(0, max(len(data), 1), (CHUNK - OVERLAP) * 2000):
                if at and len(data) - at <= OVERLAP:
                    break
                c = chunks(data[at : at + (CHUNK - OVERLAP) * 2000 + OVERLAP])
                held.append(c)
                owner.append(np.full(len(c), i))
                size += len(c)
                if size >= 2000:
                    flush()
                    size = 0
        if held:
            flush()
        return [sigmoid(float(v)) for v in top @ self.weights + self.bias]


def constant_model(share: float) -> QualityModel:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return QualityModel(np.zeros((256, EMBED), np.float32), np.zeros((SPAN * CHANNELS, 1), np.float32), np.zeros(1, np.float32), np.zeros(1), float(np.log(share / (1 - share))))


def gradients(p: dict[str, np.ndarray], docs: list[np.ndarray], reps: list[np.ndarray], y: np.ndarray, penalty: float = 1e-4) -> dict[str, np.ndarray]:
    """Derivatives of the mean logistic loss by each parameter. Max-pooling passes them to one place for each text and filter."""
    model = QualityModel(p["e"], p["f"], p["o"], p["w"], float(p["b"][0]))
    n, m = len(docs), len(p["o"])
    owner = np.repeat(np.arange(n), [len(d) for d in docs])
    x, rep = np.concatenate(docs), np.concatenate(reps)
    best, place = np.zeros((len(x), m), np.float32), np.zeros((len(x), m), np.int64)
    for k in range(0, len(x), 256):
        r = model.responses(x[k : k + 256], rep[k : k + 256])
        best[k : k + 256], place[k : k + 256] = r.max(axis=1), r.argmax(axis=1)
    top, source = np.zeros((n, m), np.float32), np.zeros((n, m), np.int64)
    np.maximum.at(top, owner, best)
    c, f = np.nonzero(best == top[owner])
    source[owner[c[::-1]], f[::-1]] = c[::-1]
    prob = 1 / (1 + np.exp(-np.clip(top @ p["w"] + p["b"], -30, 30)))
    d = (prob - y) / n
    g = {"w": top.T @ d + penalty * p["w"], "b": np.array([d.sum()])}
    row, f = np.nonzero(top > 0)
    dx = (d[row] * p["w"][f]).astype(np.float32)
    chunk = source[row, f]
    at = place[chunk, f][:, None] * STEP + np.arange(SPAN)
    seen = x[chunk[:, None], at]
    window = np.concatenate([p["e"][seen], rep[chunk[:, None], at // CELL][:, :, None]], axis=2)
    onto = np.zeros((len(row), m), np.float32)
    onto[np.arange(len(row)), f] = dx
    g["f"] = window.reshape(len(row), SPAN * CHANNELS).T @ onto
    g["o"] = onto.sum(axis=0)
    g["e"] = np.zeros_like(p["e"])
    back = (p["f"].T[f] * dx[:, None]).reshape(len(row), SPAN, CHANNELS)[:, :, :-1]
    np.add.at(g["e"], seen, back)
    g["e"][0] = 0
    return g


def train(docs: list[np.ndarray], y: np.ndarray, *, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 3) -> QualityModel:
    """Adam on the logistic loss; a text without chunks counts too."""
    rng = np.random.default_rng(seed)
    p = {"e": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), "f": rng.normal(0, 0.25, (SPAN * CHANNELS, FILTERS)).astype(np.float32), "o": np.zeros(FILTERS, np.float32), "w": rng.normal(0, 0.1, FILTERS), "b": np.zeros(1)}
    p["e"][0] = 0
    reps = [repetition(d) for d in docs]
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    t, steps = 0, epochs * -(-len(docs) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            g = gradients(p, [docs[i] for i in rows], [reps[i] for i in rows], y[rows])
            t += 1
            lr = rate * (1 - t / (steps + 1))
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                p[k] = (p[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(p[k].dtype)
    return QualityModel(p["e"], p["f"], p["o"], p["w"], float(p["b"][0]))


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = 3_000, most_bytes: int = 128 << 20, seed: int = 17) -> QualityModel:
    """Fit on whole texts of at most `most` labelled documents, half of each label where there are as many, and of those the first in
    hash order that hold `most_bytes` together; the bias is then set back to the labels' shares in all labelled rows."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("y"))
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ids = bounded_ids(known, ["y"], "id", most // 2, most, seed)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    src = sampled_rows(texts, ids, "id", F.col("t"), ["y"])
    src = src.withColumn("h", F.xxhash64(F.lit(seed), "id"))
    order = W.orderBy("h", "id", "y").rowsBetween(W.unboundedPreceding, W.currentRow)  # over the sample, `most` rows
    upto = F.sum(F.coalesce(F.octet_length("_text"), F.lit(0))).over(order)
    got = src.withColumn("upto", upto).where(F.col("upto") <= most_bytes).orderBy("h", "id", "y").select("y", "_text").toArrow()
    y = np.array(got["y"].to_pylist(), np.float64)
    if len(set(y.tolist())) < 2:
        return constant_model(shares.get(1, 0) / max(sum(shares.values()), 1) if shares else 0.5)
    model = train([chunks(t.as_py() or b"") for t in got["_text"]], y)
    model.bias += float(np.log(shares[1] / shares[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def score_quality(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(id_col, F.col(text_col).cast("string").cast("binary").alias("_text"))
    schema = src.select(id_col).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1).to_pylist()), pa.float64())], schema.names)

    return src.mapInArrow(run, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.where(crc_mod("doc_id", 3) != 1))
    return score_quality(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

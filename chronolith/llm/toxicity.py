"""Toxicity by maximum-scoring segments of token log-odds.

Token scores are log-odds between toxic and other labelled documents under an informative Dirichlet prior, which is the
features' own frequency in all of them. A token's features are the word and its prefixes, counted once a document, so that
one text's refrain counts once and inflected or compounded words share what is known of their stem; a token takes the
score of its longest feature in the lexicon. Features with a small z-score are left out. Neutral tokens cost a constant drift,
chosen so that the expected score of clean text is negative. A linear scan (Ruzzo and Tompa's) finds every maximal
passage with a positive sum. Extreme-value calibration turns a passage's score S in a text of n tokens into
lambda * S - ln(K n), whose exponential bounds the number of such passages by chance; lambda solves the
usual equation sum p exp(lambda s) = 1 over clean text and K comes from the clean documents' best passages. All significant
passages of a text are summed up in logarithms, and a logistic curve with two parameters fits that to the labels.

Defined results: a null, empty or word-free text has no passage and gets the score of "nothing found". Labels are joined by
id; a document with two labels counts with each, and of repeated ids one text is learned from. Rows with a null id or null label are
never learned from. Without toxic or without clean labelled rows every score is 1 or 0, the share of toxic labels (0 if there is no label
at all). If no word tells the labels apart, every score is the share of toxic labels. Texts are read whole. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_ids, crc_mod, sampled_rows, sigmoid, table

TOKEN = re.compile(r"[^\W\d_]+")
PREFIX = (3, 7)


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def features(word: str) -> list[str]:
    """The word with an end mark, then its prefixes, longest first."""
    return [word + "$", *(word[:k] for k in range(min(len(word), PREFIX[1]), PREFIX[0] - 1, -1))]


class _Scores(dict):
    """Scores of words, None for neutral ones; looked up by feature once for each word while there is room."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float | None:
        score = next((self.lexicon[f] for f in features(word) if f in self.lexicon), None)
        if len(self) < 200_000:
            self[word] = score
        return score


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a sequence whose other tokens score `drift` each.

    hits: positions and scores of the tokens that aren't neutral, in order. Linear in their number: each stack entry
    has the sums left and right of it, and an entry that merges is never looked at again."""
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, nearest entry below with a smaller sum before
    total, at = 0.0, -1
    for pos, score in hits:
        total += (pos - at - 1) * drift
        at = pos
        before, total = total, total + score
        if score <= 0:
            continue
        first, left, right = pos, before, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((first, pos, left, right, j))
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - l) for a, b, l, r, _ in stack]


@dataclass
class ToxicityModel:
    lexicon: dict[str, float] = field(default_factory=dict)
    drift: float = -0.1
    lam: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    bias: float = -30.0
    significant: float = 0.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_scores"}

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        scores = self.__dict__.setdefault("_scores", _Scores(self.lexicon))
        return [(i, s) for i, s in enumerate(map(scores.__getitem__, words)) if s is not None]

    def passages(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """Passages with calibrated scores above `significant`, by token positions; the number of tokens."""
        words = tokens(text)
        hits = self.hits(words)
        if not hits:
            return [], len(words)
        base = self.log_k + math.log(max(len(words), 1))
        found = [(a, b, self.lam * s - base) for a, b, s in segments(hits, self.drift)]
        return [x for x in found if x[2] > self.significant], len(words)

    @staticmethod
    def evidence(found: list[tuple[int, int, float]]) -> float:
        """Sum of the passages' scores, dampened: 0 if there is none."""
        return math.log1p(sum(x[2] for x in found))

    def score(self, text: str | None) -> tuple[float, int, int, int]:
        """Probability; passages; first and last token of the best passage or -1."""
        found, _ = self.passages(text)
        best = max(found, key=lambda x: (x[2], -x[0]), default=(-1, -1, 0.0))
        return sigmoid(self.bias + self.slope * self.evidence(found)), len(found), best[0], best[1]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, in toxic, in other) for each batch: Spark adds them up."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for w in {f for w in set(tokens(text)) for f in features(w)}:
                counts.setdefault(w, [0, 0])[0 if toxic else 1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (0, 1))], ["word", "a", "b"])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias by Newton steps on a slightly penalised likelihood."""
    w = np.zeros(2)
    x1 = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        g = x1.T @ (p - y) + np.array([1e-2, 1e-3]) * w
        h = (x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag([1e-2, 1e-3])
        step = np.linalg.solve(h, g)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 8_000, prior: float = 0.02, z_least: float = 3.0, seed: int = 5) -> ToxicityModel:
    """Fit on at most `most` labelled documents, half of them toxic where there are as many; the bias is then set back to
    the labels' shares in all labelled rows. The lexicon holds every feature of the sample with a |z| of `z_least` or more; the
    prior weighs `prior` of all counts."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("toxic"))
    shares = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ids = bounded_ids(known, ["toxic"], "id", most // 2, most, seed)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    sample = sampled_rows(texts, ids, "id", F.col("t"), ["toxic"]).select("toxic", "_text").persist()
    try:
        n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if not n.get(0) or not n.get(1):
            share = n.get(1, 0) / max(sum(n.values()), 1)
            return ToxicityModel(bias=30.0 if share == 1 else -30.0)
        natural = math.log(shares[1] / shares[0])
        back = natural - math.log(n[1] / n[0])
        counts = sample.mapInArrow(_count, "word string, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        na, nb = (float(x or 0) for x in counts.agg(F.sum("a"), F.sum("b")).first())
        tot = F.col("a") + F.col("b")
        own, prior = F.lit(prior) * tot, prior * (na + nb)
        ya, yb = F.col("a") + own, F.col("b") + own
        odds = F.log(ya / (na + prior - ya)) - F.log(yb / (nb + prior - yb))
        scored = counts.select("word", "a", "b", odds.alias("s"), (odds / F.sqrt(1 / ya + 1 / yb)).alias("z"))
        lex = scored.where(F.abs("z") >= z_least).orderBy("word").toArrow()
        words, s, b = lex["word"].to_pylist(), lex["s"].to_numpy().astype(float), lex["b"].to_numpy() / max(nb, 1.0)
        model = ToxicityModel(dict(zip(words, s.tolist())))
        if not (s > 0).any():
            return ToxicityModel(bias=natural)
        # the drift makes clean text lose twice what its positive tokens win, and a little in any case
        model.drift = -max(0.05, 2 * float((b * np.maximum(s, 0)).sum()))
        rest = max(1 - float(b.sum()), 0.0)
        low, high = 1e-6, 50.0
        for _ in range(100):
            lam = (low + high) / 2
            low, high = (lam, high) if float((b * np.exp(np.minimum(lam * s, 500))).sum()) + rest * math.exp(lam * model.drift) < 1 else (low, lam)
        model.lam = low

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for text in batch.column(1).to_pylist():
                    ws = tokens(text)
                    rows.append((max((x[2] for x in segments(model.hits(ws), model.drift)), default=0.0), len(ws)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.int64())], ["toxic", "best", "n"])

        top = sample.mapInArrow(best, "toxic int, best double, n long").toArrow()
        y, sc, nt = (top[c].to_numpy().astype(float) for c in ("toxic", "best", "n"))
        clean = y == 0
        # K: as many clean documents beat their own threshold as chance allows, over all scores that occur
        excess = np.sort(model.lam * sc[clean] - np.log(np.maximum(nt[clean], 1)))[::-1]
        expected = np.log((np.arange(len(excess)) + 1) / len(excess))
        model.log_k = float(np.median((excess + expected)[: max(1, len(excess) // 20)]))
        model.significant = 0.0

        def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.evidence(model.passages(t)[0]) for t in batch.column(1).to_pylist()], pa.float64())], ["toxic", "x"])

        ev = sample.mapInArrow(evidence, "toxic int, x double").toArrow()
        model.slope, model.bias = _logistic(ev["x"].to_numpy().astype(float), ev["toxic"].to_numpy().astype(float))
        model.bias += back
        return model
    finally:
        sample.unpersist()


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_passages, best_first, best_last) of each row; passages by token positions."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(id_col, F.col(text_col).cast("string").alias("_text"))
    schema = src.select(id_col).schema.add("score", "double").add("n_passages", "integer").add("best_first", "long").add("best_last", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = [own.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.float64(), pa.int32(), pa.int64(), pa.int64())))], schema.names)

    return src.mapInArrow(run, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(crc_mod("doc_id", 5) != 0))
    return score_toxicity(docs, model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "best_first", "best_last")

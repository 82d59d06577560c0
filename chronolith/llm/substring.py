"""Substring deduplication with a log-structured fingerprint index.

A table's documents are dealt into runs by a hash of their ids and texts. A run's windows (of 13 words) become one sorted immutable array of
fingerprints, each with the smallest document that has it, cut into shards of the fingerprint space. Within a shard the runs are
merge-joined with one another and with the stored history: a fingerprint that a document with a smaller id has, in another run, is a hit.
The holder's run cuts the passages that its hits cover out of its texts and sends them to the run that asked; that run verifies every hit
on the words themselves, settles repeats inside the run the same way, and drops the words they cover. A fingerprint asks its nearest
predecessor by id only, so a hot passage is passed on from run to run and no run is asked by all others.

`SubstringIndex` keeps batches: each is compared with the history, then written as a new sorted run of shards; runs of similar size are
compacted into one, as a log-structured merge tree does. The index holds the batches' texts, too, which verification needs.

Work for a run and for a shard is bounded by `run_bytes` and `shard_windows`, whatever the corpus. Up to `1 << STEP_BITS` runs meet in
as many shards; beyond, groups of runs are folded first, so that no exchange makes more than that many pieces of a run.

Defined results: a null or empty text has no words and keeps nothing (the digest of the empty text). A window repeats
only from a smaller id: rows with a null id and rows that share an id never remove each other's words, and a null id
neither gives nor loses words. Repeated rows are settled alike; every input row gets one row. Extra columns are ignored. An empty table
gives no row. Two windows with different words and the same 64-bit fingerprint never remove words; they could hide a third document's
repeat from the second, once in some 1e19 pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed, table

WINDOW = 13
STEP_BITS = 12
BLOB = "prefix long, data binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class _Numbers(dict):
    """A number for each word, in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in self), np.uint64, len(self))


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def window_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """A fingerprint of each window over word hashes: sums of hashes times powers, from running sums modulo 2 ** 64."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    powers, back = (np.full(len(words), x, np.uint64) for x in (base, pow(base, -1, 1 << 64)))
    powers[0] = back[0] = 1
    np.cumprod(powers, out=powers)
    np.cumprod(back, out=back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers, dtype=np.uint64)])
    return _mixed((sums[window:] - sums[:n]) * back[:n])


def _planes(a: np.ndarray) -> bytes:
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def _unplanes(raw: bytes, dtype: type, n: int, at: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(raw, np.uint8, size * n, at).reshape(size, n).T.copy().view(dtype).ravel()


@dataclass
class Entries:
    """Sorted fingerprints, each with a row of owners: (run, place in the run, document id)."""

    fp: np.ndarray
    who: np.ndarray
    owners: np.ndarray

    def pack(self) -> bytes:
        """Byte planes of differences, compressed."""
        head = np.array([len(self.fp), len(self.owners)], np.int64).tobytes()
        owners = np.diff(self.owners, axis=0, prepend=np.zeros((1, 3), np.int64)).T.ravel()
        return zstandard.compress(head + _planes(np.diff(self.fp, prepend=np.uint64(0))) + _planes(self.who.astype(np.uint32)) + _planes(owners), 1)

    @staticmethod
    def unpack(data: bytes) -> Entries:
        raw = zstandard.decompress(data)
        n, m = np.frombuffer(raw, np.int64, 2).tolist()
        owners = _unplanes(raw, np.int64, 3 * m, 16 + 12 * n).reshape(3, m).T
        return Entries(np.cumsum(_unplanes(raw, np.uint64, n, 16), dtype=np.uint64), _unplanes(raw, np.uint32, n, 16 + 8 * n).astype(np.int64), np.cumsum(owners, axis=0))

    def cut(self, bits: int) -> Iterator[tuple[int, Entries]]:
        """Pieces by the fingerprints' first bits, with their owners only."""
        prefix = (self.fp >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(self.fp), np.int64)
        starts = np.flatnonzero(np.diff(prefix, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(prefix)]):
            used, who = np.unique(self.who[a:b], return_inverse=True)
            yield int(prefix[a]), Entries(self.fp[a:b], who, self.owners[used])

    @staticmethod
    def merged(parts: list[Entries]) -> Entries:
        """All entries in order of fingerprint, then document id."""
        shift = np.cumsum([0, *(len(p.owners) for p in parts[:-1])])
        fp, who, owners = np.concatenate([p.fp for p in parts]), np.concatenate([p.who + s for p, s in zip(parts, shift)]), np.concatenate([p.owners for p in parts])
        order = np.argsort(fp, kind="stable")
        fp, who = fp[order], who[order]
        same = np.zeros(len(fp), bool)
        same[1:] = fp[1:] == fp[:-1]
        tied = np.flatnonzero(same | np.append(same[1:], False))
        who[tied] = who[tied][np.lexsort((owners[who[tied], 2], fp[tied]))]
        return Entries(fp, who, owners)

    def firsts(self) -> Entries:
        """Of each fingerprint the entry with the smallest document id."""
        first = np.ones(len(self.fp), bool)
        first[1:] = self.fp[1:] != self.fp[:-1]
        used, who = np.unique(self.who[first], return_inverse=True)
        return Entries(self.fp[first], who, self.owners[used])

    def hits(self, from_run: int) -> tuple[np.ndarray, np.ndarray]:
        """(asking, asked) entries: those of runs from from_run on, and their nearest predecessor with a smaller document id."""
        at, ids = np.arange(len(self.fp)), self.owners[self.who, 2]
        new = np.ones(len(self.fp), bool)
        new[1:] = (self.fp[1:] != self.fp[:-1]) | (ids[1:] != ids[:-1])
        before = np.maximum.accumulate(np.where(new, at, 0)) - 1
        ok = (before >= 0) & (self.owners[self.who, 0] >= from_run)
        ok[ok] &= self.fp[before[ok]] == self.fp[ok]
        return at[ok], before[ok]


class _Run:
    """The documents of one run, in order of id and text: their words as numbers, and all windows."""

    def __init__(self, ids: list[int], texts: list[bytes | None], window: int):
        self.window = window
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i] or b""))
        self.ids = np.array([ids[i] for i in self.order], np.int64)
        self.texts = [texts[i] or b"" for i in self.order]

    def read(self, places: list[int] | None = None, passages: list[bytes] = ()) -> None:
        """Number the words of the documents at these places (all), and of passages after them."""
        self.places = list(range(len(self.ids))) if places is None else places
        numbers = _Numbers()
        parts = [numbers.of(t.split()) for t in [*(self.texts[p] for p in self.places), *passages]]
        self.words = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        self.starts = np.concatenate([[0], ends])[:-1].astype(np.int64)
        self.ends = ends
        of_text = np.repeat(np.arange(len(parts)), np.diff(ends, prepend=0))
        n = max(len(self.words) - self.window + 1, 0)
        self.at = np.flatnonzero(of_text[:n] == of_text[self.window - 1 :][:n])
        hashed = numbers.hashes()
        self.h = window_hashes(hashed[self.words], self.window)[self.at] if n else np.zeros(0, np.uint64)
        self.text_of = of_text[self.at]

    def entries(self, run: int) -> Entries:
        fp, first = np.unique(self.h, return_index=True)  # the first window has the smallest id
        used, who = np.unique(self.text_of[first], return_inverse=True)
        places = np.array(self.places, np.int64)[used]
        return Entries(fp, who, np.stack([np.full(len(used), run), places, self.ids[places]], axis=1).astype(np.int64))

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the windows that start at the words a and b have the same words."""
        ok = np.ones(len(a), bool)
        for k in range(self.window):
            ok &= self.words[a + k] == self.words[b + k]
        return ok

    def repeated(self) -> np.ndarray:
        """Windows of documents whose words are in a passage, or start in a document of the run with a smaller id."""
        own = self.text_of < len(self.places)
        known = np.sort(self.h[~own])
        out = np.zeros(len(self.h), bool)
        if len(known):
            other = np.flatnonzero(~own)
            other = other[np.argsort(self.h[other], kind="stable")]
            j = np.minimum(np.searchsorted(known, self.h), len(known) - 1)
            out = own & (known[j] == self.h)
            out[out] = self.same(self.at[out], self.at[other[j[out]]])
        h, first, back = np.unique(self.h[own], return_index=True, return_inverse=True)
        mine = np.flatnonzero(own)
        j = mine[first][back]
        inside = np.zeros(len(self.h), bool)
        inside[mine] = self.ids[self.text_of[mine]] > self.ids[self.text_of[j]]
        earlier = np.zeros(len(self.h), np.int64)
        earlier[mine] = j
        inside[inside] = self.same(self.at[inside], self.at[earlier[inside]])
        return out | inside

    def kept(self, repeated: np.ndarray) -> Iterator[tuple[int, int, int, str]]:
        """Id, words, words removed and digest of the words kept, of each document."""
        change = np.zeros(len(self.words) + 1, np.int32)
        np.add.at(change, self.at[repeated], 1)
        np.add.at(change, self.at[repeated] + self.window, -1)
        gone = np.cumsum(change[:-1]) > 0
        touched = np.add.reduceat(np.append(gone, False), np.minimum(self.starts, len(gone))) if len(self.starts) else []
        for k in range(len(self.places)):
            a, b = int(self.starts[k]), int(self.ends[k])
            words, n = self.texts[k].split(), 0
            if b > a and touched[k]:
                stays = ~gone[a:b]
                n = b - a - int(stays.sum())
                words = [w for w, s in zip(words, stays.tolist()) if s]
            yield int(self.ids[k]), b - a, n, hashlib.sha256(b" ".join(words)).hexdigest()

    def passages(self, place: np.ndarray, run: np.ndarray, fp: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(run, passages) for what runs asked: fingerprints of windows of the documents at these places."""
        self.read(np.unique(place).tolist())
        of_place = {p: k for k, p in enumerate(self.places)}
        asked = np.array([of_place[p] for p in place.tolist()], np.int64)
        order = np.lexsort((fp, asked))
        asked, run, fp = asked[order], run[order], fp[order]
        found: dict[int, list[bytes]] = {}
        bounds = np.searchsorted(asked, np.arange(len(self.places) + 1))
        windows = np.searchsorted(self.text_of, np.arange(len(self.places) + 1))
        for k in range(len(self.places)):
            f, r = fp[bounds[k] : bounds[k + 1]], run[bounds[k] : bounds[k + 1]]
            h, at = self.h[windows[k] : windows[k + 1]], self.at[windows[k] : windows[k + 1]] - self.starts[k]
            words = self.texts[self.places[k]].split()
            for one in np.unique(r).tolist():
                wanted = f[r == one]
                j = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                starts = at[wanted[j] == h]
                cuts = np.flatnonzero(np.diff(starts) > self.window)
                for a, b in zip(starts[np.concatenate([[0], cuts + 1])].tolist(), starts[np.concatenate([cuts, [len(starts) - 1]])].tolist()) if len(starts) else ():
                    found.setdefault(one, []).append(b" ".join(words[a : b + self.window]))
        yield from ((r, b"\n".join(p)) for r, p in found.items())


def _emit(window: int, bits: int):
    def emit(key: tuple, t: pa.Table) -> pa.Table:
        run = _Run(t["doc_id"].to_pylist(), t["text"].to_pylist(), window)
        run.read()
        some = [(prefix, e.pack()) for prefix, e in run.entries(key[0].as_py()).cut(bits)]
        return pa.table({"prefix": pa.array([p for p, _ in some], pa.int64()), "run": pa.array([key[0].as_py()] * len(some), pa.int64()), "data": pa.array([d for _, d in some], pa.binary())})

    return emit


def _fold(bits: int, firsts: bool):
    """Merge a group's blobs into one sorted run, cut by more bits; of each fingerprint only the smallest document if firsts."""

    def fold(t: pa.Table) -> pa.Table:
        whole = Entries.merged([Entries.unpack(d.as_py()) for d in t["data"]])
        some = [(prefix, e.pack()) for prefix, e in (whole.firsts() if firsts else whole).cut(bits)]
        return pa.table({"prefix": pa.array([p for p, _ in some], pa.int64()), "data": pa.array([d for _, d in some], pa.binary())})

    return fold


def _ask(from_run: int):
    """Merge-join a shard's runs: rows (run, data) to the holders of hits, data with places, asking runs and fingerprints."""

    def ask(t: pa.Table) -> pa.Table:
        e = Entries.merged([Entries.unpack(d.as_py()) for d in t["data"]])
        asking, asked = e.hits(from_run)
        holder, place, run = e.owners[e.who[asked], 0], e.owners[e.who[asked], 1], e.owners[e.who[asking], 0]
        order = np.lexsort((e.fp[asking], place, holder))
        holder, rows = holder[order], np.stack([place[order], run[order], e.fp[asking][order].view(np.int64)])
        starts = np.flatnonzero(np.diff(holder, prepend=-1))
        some = [(int(holder[a]), zstandard.compress(_planes(np.diff(rows[:, a:b], axis=1, prepend=0).ravel()), 1)) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(holder)])]
        return pa.table({"run": pa.array([r for r, _ in some], pa.int64()), "data": pa.array([d for _, d in some], pa.binary())})

    return ask


def _asked(data: pa.ChunkedArray) -> np.ndarray:
    parts = []
    for d in data:
        raw = zstandard.decompress(d.as_py())
        parts.append(np.cumsum(_unplanes(raw, np.int64, len(raw) // 8, 0).reshape(3, -1), axis=1))
    return np.concatenate(parts, axis=1)


def _answer(window: int):
    """The holder cuts the passages that runs ask for out of its texts."""

    def answer(own: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[tuple[int, bytes]] = []
        if own.num_rows and asks.num_rows:
            place, run, fp = _asked(asks["data"])
            out = list(_Run(own["doc_id"].to_pylist(), own["text"].to_pylist(), window).passages(place, run, fp.view(np.uint64)))
        return pa.table({"run": pa.array([r for r, _ in out], pa.int64()), "data": pa.array([zstandard.compress(d, 1) for _, d in out], pa.binary())})

    return answer


def _settle(window: int):
    """Verify a run's hits on the words of the passages, and drop what repeats."""

    def settle(own: pa.Table, answers: pa.Table) -> pa.Table:
        run = _Run(own["doc_id"].to_pylist(), own["text"].to_pylist(), window)
        run.read(passages=[p for d in answers["data"] for p in zstandard.decompress(d.as_py()).split(b"\n")])
        rows = list(run.kept(run.repeated()))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return settle


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without an id stay out of the runs, however many they are: nothing is removed from them."""
    for b in batches:
        words = [(t.as_py() or b"").split() for t in b.column(1)]
        counts, digests = pa.array([len(w) for w in words], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), counts, pa.array([0] * len(words), pa.int64()), digests], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))


@dataclass
class _Plan:
    """How a batch is dealt: runs from `first` on, and the bits of the shards."""

    first: int
    runs: int
    bits: int
    window: int

    def dealt(self, docs: DataFrame) -> DataFrame:
        """Rows with an id in their runs; copies of a row from different partitions of the input go apart."""
        run = F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.spark_partition_id()), F.lit(self.runs)) + self.first
        return docs.where("doc_id IS NOT NULL").withColumn("run", run.cast("long")).repartition(min(self.runs, 100_000), "run")

    def blobs(self, dealt: DataFrame) -> DataFrame:
        """(prefix, data): sorted fingerprints of the runs, by shard."""
        bits = min(self.bits, STEP_BITS)
        sent = dealt.groupBy("run").applyInArrow(_emit(self.window, bits), "prefix long, run long, data binary")
        if bits == self.bits:
            return sent.drop("run")
        group: Column = F.expr(f"run div {1 << STEP_BITS}").alias("group")
        return sent.groupBy(group, "prefix").applyInArrow(_fold(self.bits, False), BLOB)

    def settled(self, dealt: DataFrame, holders: DataFrame, blobs: DataFrame) -> DataFrame:
        """The result rows of the dealt documents; holders: (run, doc_id, text) of all runs that blobs know."""
        asks = blobs.groupBy("prefix").applyInArrow(_ask(self.first), "run long, data binary")
        answers = holders.groupBy("run").cogroup(asks.groupBy("run")).applyInArrow(_answer(self.window), "run long, data binary")
        return dealt.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(_settle(self.window), RESULT)


def _planned(docs: DataFrame, first: int, more_windows: int, run_bytes: int, shard_windows: int, least_bits: int, window: int) -> _Plan:
    total = docs.where("doc_id IS NOT NULL").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    shards = max((total // 6 + more_windows) / shard_windows, min(parts, total >> 20), 1)
    return _Plan(first, total // run_bytes + 1, max(least_bits, math.ceil(math.log2(shards))), window)


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, run_bytes: int = 12 << 20, shard_windows: int = 2 << 20) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of each row, as the module says: one batch, with an index that isn't kept."""
    every = _plain(docs, id_col, text_col)
    plan = _planned(every, 0, 0, run_bytes, shard_windows, 0, window)
    dealt = plan.dealt(every)
    settled = plan.settled(dealt, dealt, plan.blobs(dealt))
    return settled.unionByName(every.where("doc_id IS NULL").mapInArrow(_whole, RESULT)).withColumnRenamed("doc_id", id_col)


class SubstringIndex:
    """An index in a folder that driver and executors share.

    log holds a row for each sorted run that is whole: the first and last batch it covers, its windows, bits and the next free run
    number. A run that covers others replaces them; files never change. texts holds the batches' documents by run."""

    LOG = "first long, last long, windows long, bits int, next_run long"

    def __init__(self, spark: SparkSession, folder: str, window: int = WINDOW):
        self.spark, self.folder, self.window = spark, folder.rstrip("/"), window

    def create(self) -> SubstringIndex:
        """Write the empty log of a new index."""
        self.spark.createDataFrame([], self.LOG).write.parquet(f"{self.folder}/log")
        return self

    def live(self) -> list[tuple[int, int, int, int, int]]:
        """Rows of the log that no wider one covers, in order of batches: a handful, since sizes fall by half from one to the next."""
        rows = sorted({tuple(r) for r in self.spark.read.schema(self.LOG).parquet(f"{self.folder}/log").collect()}, key=lambda r: (r[0], -r[1]))
        return [r for r in rows if not any(s != r and s[0] <= r[0] and s[1] >= r[1] for s in rows)]

    def _blobs(self, runs: list[tuple[int, int, int, int, int]], bits: int) -> DataFrame:
        """(prefix, data) of stored runs, cut to this many bits."""

        def recut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for d in b.column(0):
                    some = [(prefix, e.pack()) for prefix, e in Entries.unpack(d.as_py()).cut(bits)]
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in some], pa.int64()), pa.array([d for _, d in some], pa.binary())], ["prefix", "data"])

        out = self.spark.createDataFrame([], BLOB)
        for first, last, _, own, _ in runs:
            stored = self.spark.read.schema(BLOB).parquet(f"{self.folder}/runs/{first}-{last}")
            out = out.union(stored if own == bits else stored.select("data").mapInArrow(recut, BLOB))
        return out

    def _write(self, first: int, last: int, blobs: DataFrame, bits: int, next_run: int) -> None:
        """Merge blobs into one sorted run of each fingerprint's smallest document, then enter it into the log."""
        path = f"{self.folder}/runs/{first}-{last}"
        blobs.groupBy("prefix").applyInArrow(_fold(bits, True), BLOB).write.mode("overwrite").parquet(path)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([len(Entries.unpack(d.as_py()).fp) for d in b.column(0)], pa.int64())], ["n"])

        windows = self.spark.read.schema(BLOB).parquet(path).select("data").mapInArrow(count, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.spark.createDataFrame([(first, last, windows, bits, next_run)], self.LOG).coalesce(1).write.mode("append").parquet(f"{self.folder}/log")

    def add_batch(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", run_bytes: int = 12 << 20, shard_windows: int = 2 << 20) -> DataFrame:
        """(id, n_words, n_removed, kept_sha256) of the batch's rows against the history and one another; the batch joins the index.

        Rows of earlier batches keep the results they had; if ids grow from batch to batch, all are those of one table. The result is a
        table of the index, written before the batch enters the log."""
        runs = self.live()
        number, first_run = (runs[-1][1] + 1, max(r[4] for r in runs)) if runs else (0, 0)
        every = _plain(docs, id_col, text_col)
        plan = _planned(every, first_run, sum(r[2] for r in runs), run_bytes, shard_windows, max((r[3] for r in runs), default=0), self.window)
        plan.dealt(every).write.mode("overwrite").parquet(f"{self.folder}/texts/{number}")
        texts = self.spark.read.parquet(f"{self.folder}/texts/{number}")
        blobs = checkpointed(plan.blobs(texts))
        holders = texts
        for k in range(number):
            holders = holders.union(self.spark.read.parquet(f"{self.folder}/texts/{k}"))
        every_blob = blobs.union(self._blobs(runs, plan.bits))
        asks = checkpointed(every_blob.groupBy("prefix").applyInArrow(_ask(first_run), "run long, data binary"))
        asked = holders.join(broadcast_if_small(checkpointed(asks.select("run").distinct())), "run", "left_semi")
        answers = asked.groupBy("run").cogroup(asks.groupBy("run")).applyInArrow(_answer(self.window), "run long, data binary")
        settled = texts.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(_settle(self.window), RESULT)
        settled = settled.unionByName(every.where("doc_id IS NULL").mapInArrow(_whole, RESULT)).withColumnRenamed("doc_id", id_col)
        settled.write.mode("overwrite").parquet(f"{self.folder}/results/{number}")
        self._write(number, number, blobs, plan.bits, first_run + plan.runs)
        self.compact()
        return self.spark.read.parquet(f"{self.folder}/results/{number}")

    def compact(self) -> None:
        """Merge the last two runs while the older has less than twice the windows of the younger."""
        runs = self.live()
        while len(runs) > 1 and runs[-2][2] < 2 * runs[-1][2]:
            a, b = runs[-2:]
            bits = max(a[3], b[3])
            self._write(a[0], b[1], self._blobs([a, b], bits), bits, b[4])
            runs = self.live()


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, list_aggregate(w[i:i + 12], 'string_agg', ' ') AS t FROM p),
f AS (SELECT t, min(doc_id) AS first FROM g GROUP BY t HAVING min(doc_id) < max(doc_id)),
s AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM g JOIN f USING (t) WHERE first < doc_id),
r AS (SELECT doc_id, count(*) AS n, list(k) AS gone FROM s GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(gone, j)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))

"""Length-prefixed, checksummed frames as binary columns: encode, scan and check them.

A frame is a 20-byte prefix (magic, version, kind, flags, sequence, payload length; big-endian), the payload and a CRC-32C of both. Files
of frames are read with Spark's binaryFile source or any binary column; `scan` lists the frames of each file in one pass and stops at
the first byte that is no frame, which it reports as the tail for the recovery rules.
"""

from __future__ import annotations

import functools
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAGIC, VERSION, KIND = b"CHRF", 1, 1
PREFIX = struct.Struct(">4sHBBQI")


def _table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


CRC_TABLE = _table()


def crc32c(data: bytes) -> int:
    """Castagnoli's checksum."""
    c = 0xFFFFFFFF
    for b in data:
        c = CRC_TABLE[(c ^ b) & 255] ^ c >> 8
    return c ^ 0xFFFFFFFF


#: Bytes of a piece: pieces of all frames of a batch are summed side by side, a byte of each at a time.
PIECE = 1024
#: Bytes of files that are decoded together, about; a larger one takes as many as it has.
TOGETHER = 8 << 20
_STEP = np.array(CRC_TABLE, np.uint32)


def _registers(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The checksum's register after each span of data, from `first` on."""
    order = np.argsort(-lengths, kind="stable")
    at, c, shorter = starts[order], first[order], -lengths[order]
    for i in range(-int(shorter[0]) if len(shorter) else 0):
        k = np.searchsorted(shorter, -i)  # spans that have a byte i
        c[:k] = _STEP[(c[:k] ^ data[at[:k] + i]) & 255] ^ c[:k] >> 8
    out = np.empty_like(c)
    out[order] = c
    return out


@functools.cache
def _past(piece: int) -> np.ndarray:
    """For each byte of a register and each of its values, what it is after a piece of zeros."""
    values = (np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]).ravel()
    none = np.zeros(len(values), np.int64)
    return _registers(np.zeros(piece, np.uint8), none, none + piece, values).reshape(4, 256)


def crc32c_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32c of spans of data (bytes). All pieces of a span but the first are whole; the register is linear, so pieces are summed apart."""
    starts, lengths = np.asarray(starts, np.int64), np.asarray(lengths, np.int64)
    n = np.maximum(1, -(-lengths // PIECE))
    head = lengths - (n - 1) * PIECE
    own = np.cumsum(n) - n  # place of a span's first piece
    k = np.arange(n.sum()) - np.repeat(own, n)
    at = np.repeat(starts + head, n) + (k - 1) * PIECE
    at[own] = starts
    size = np.full(len(k), PIECE)
    size[own] = head
    parts = _registers(data, at, size, np.where(k == 0, 0xFFFFFFFF, 0).astype(np.uint32))
    c = parts[own]
    for j in range(1, int(n.max(initial=1))):
        of = np.flatnonzero(n > j)
        x = c[of]
        for b in range(4):
            c[of] = (c[of] if b else parts[own[of] + j]) ^ _past(PIECE)[b][x >> 8 * b & 255]
    return c ^ np.uint32(0xFFFFFFFF)


def encode(seq: int, payload: bytes) -> bytes:
    body = PREFIX.pack(MAGIC, VERSION, KIND, 0, seq, len(payload)) + payload
    return body + struct.pack(">I", crc32c(body))


def frame_length(payload: str):
    """Bytes of the frame of a binary or text column, without building it."""
    return F.octet_length(payload) + PREFIX.size + 4


def _spans(data, at: int, stop: int, most_payload: int) -> Iterator[tuple[int, int, int]]:
    """(offset, end, sequence) of the leading frames of data[at:stop] by their prefixes, each the successor of the one before."""
    seq = None
    while stop - at >= PREFIX.size:
        magic, version, kind, flags, s, n = PREFIX.unpack_from(data, at)
        end = at + PREFIX.size + n + 4
        if (magic, version, kind, flags) != (MAGIC, VERSION, KIND, 0) or n > most_payload or end > stop or (seq is not None and s != seq + 1) or s == 0:
            break
        yield at, end, s
        at, seq = end, s


def decode_all(data, bounds: list[int], most_payload: int = 8 << 20) -> list[tuple[list[tuple[int, int, bytes]], int]]:
    """What `decode` says of each of the files that lie in data one after another, cut at bounds."""
    files = [list(_spans(data, a, b, most_payload)) for a, b in zip(bounds, bounds[1:])]
    spans = np.array([x[:2] for f in files for x in f], np.int64).reshape(-1, 2)
    whole = np.frombuffer(data, np.uint8)
    sums = crc32c_spans(whole, spans[:, 0], spans[:, 1] - spans[:, 0] - 4)
    stored = whole[spans[:, 1:] - 4 + np.arange(4)].reshape(-1, 4).copy().view(">u4").ravel()
    sound = iter((sums == stored).tolist())
    view, out = memoryview(data), []
    for base, f in zip(bounds, files):
        good = list(itertools.takewhile(lambda x: x[1], zip(f, [next(sound) for _ in f])))
        frames = [(a - base, s, bytes(view[a + PREFIX.size : b - 4])) for (a, b, s), _ in good]
        out.append((frames, good[-1][0][1] - base if good else 0))
    return out


def decode(data: bytes, most_payload: int = 8 << 20) -> tuple[list[tuple[int, int, bytes]], int]:
    """(offset, sequence, payload) of the leading sound frames, each the successor of the one before; and where they end."""
    return decode_all(data, [0, len(data)], most_payload)[0]


def encode_all(seqs: list[int], payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The frames of `encode`, one after another, and their bounds."""
    data = np.frombuffer(b"".join(x for s, p in zip(seqs, payloads) for x in (PREFIX.pack(MAGIC, VERSION, KIND, 0, s, len(p)), p, bytes(4))), np.uint8).copy()
    bounds = np.cumsum([0, *(len(p) + PREFIX.size + 4 for p in payloads)])
    sums = crc32c_spans(data, bounds[:-1], np.diff(bounds) - 4)
    data[bounds[1:, None] - 4 + np.arange(4)] = sums.astype(">u4").view(np.uint8).reshape(-1, 4)
    return data, bounds


def encode_frames(rows: DataFrame) -> DataFrame:
    """rows (seq, payload binary) with `frame`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = encode_all(b.column(0).to_pylist(), b.column(1).to_pylist())
            f = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*b.columns, f.cast(pa.binary())], ["seq", "payload", "frame"])

    return rows.select(F.col("seq").cast("long"), F.col("payload").cast("binary").alias("payload")).mapInArrow(run, "seq long, payload binary, frame binary")


def scan(files: DataFrame) -> DataFrame:
    """From (path, content): path, offset, seq, payload of each frame; and one row with seq null whose offset is where the tail starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(pc.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(ends // TOGETHER)) + 1).tolist(), b.num_rows]
            for part in (b.slice(i, j - i) for i, j in zip(cuts, cuts[1:])):
                contents = [x or b"" for x in part.column(1).to_pylist()]
                found = decode_all(b"".join(contents), np.cumsum([0, *map(len, contents)]).tolist())
                rows = [r for path, (frames, end) in zip(part.column(0).to_pylist(), found) for r in (*((path, *f) for f in frames), (path, end, None, None))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["path", "offset", "seq", "payload"])

    return files.select("path", "content").mapInArrow(run, "path string, offset long, seq long, payload binary")


@F.pandas_udf(T.LongType())
def crc32c_column(data: pd.Series) -> pd.Series:
    known = [bytes(x) for x in data if x is not None]
    bounds = np.cumsum([0, *map(len, known)])
    sums = iter(crc32c_spans(np.frombuffer(b"".join(known), np.uint8), bounds[:-1], np.diff(bounds)).tolist())
    return data.map(lambda x: None if x is None else next(sums))


def real_bits(values: np.ndarray) -> np.ndarray:
    """Bit patterns of doubles as longs, payloads of NaN kept."""
    return np.ascontiguousarray(values, np.float64).view(np.int64)

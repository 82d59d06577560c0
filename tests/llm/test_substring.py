"""Repeated passages against brute force over windows of words, and the stored index against one table."""

import hashlib
import random

import numpy as np
import pytest

from chronolith.llm import substring
from chronolith.llm.substring import Entries


def _docs(rng, ids):
    shared = " ".join(f"s{k}" for k in range(60))
    out = []
    for k in ids:
        own = " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(300)))
        out.append((k, own + (f" {shared} " if k % 3 == 0 else "\t") + f"tail{k} " + shared[:40]))
    return out


def _want(rows):
    first, out = {}, []
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    for i, t in rows:
        w = (t or "").split()
        gone = {k + j for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("run_bytes, shard_windows, step", [(20_000, 500, 12), (8_000, 500, 2), (1 << 30, 1 << 20, 12)])
def test_substrings_by_any_number_of_runs(spark, monkeypatch, run_bytes, shard_windows, step):
    monkeypatch.setattr(substring, "STEP_BITS", step)
    rng = random.Random(3)
    rows = _docs(rng, range(120))
    rows += [(7, rows[9][1]), (7, rows[7][1]), (7, rows[7][1]), (200, rows[3][1]), (-5, rows[30][1]), (None, rows[3][1]), (None, None), (300, None), (301, " \n"), (302, "ä " * 40), (303, "x " * 13 + "ä " * 13)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert _rows(substring.dedup_substrings(df, run_bytes=run_bytes, shard_windows=shard_windows)) == _want(rows)


def test_batches_equal_one_table(spark, tmp_path):
    rng = random.Random(4)
    rows = _docs(rng, range(100)) + [(500, None)]
    rows += [(100 + k, rows[k][1]) for k in range(0, 60, 7)] + [(None, rows[0][1])]
    index = substring.SubstringIndex(spark, f"file://{tmp_path}/index").create()
    got, sizes = [], []
    for a, b in ((0, 40), (40, 55), (55, 60), (60, 62), (62, 62), (62, len(rows))):
        batch = spark.createDataFrame(rows[a:b], "doc_id long, text string")
        got += [tuple(r) for r in index.add_batch(batch, run_bytes=20_000, shard_windows=700).collect()]
        live = index.live()
        sizes.append([r[2] for r in live])
        assert live[0][0] == 0 and all(x[1] + 1 == y[0] for x, y in zip(live, live[1:]))
        assert all(x >= 2 * y for x, y in zip(sizes[-1], sizes[-1][1:]))
    assert sorted(got, key=str) == _want(rows)
    assert max(map(len, sizes)) > 1 and len(sizes[-1]) < 6  # some runs were kept apart, some compacted


def test_entries_pack_cut_merge_and_hit():
    rng = np.random.default_rng(1)
    parts = []
    for run in range(6):
        fp = np.unique(rng.integers(0, 200, 90, dtype=np.uint64) << np.uint64(56))
        owners = np.stack([np.full(9, run), np.arange(9), np.sort(rng.integers(0, 40, 9))], axis=1).astype(np.int64)
        e = Entries(fp, rng.integers(0, 9, len(fp)), owners)
        back = Entries.unpack(e.pack())
        assert (back.fp == fp).all() and (back.owners[back.who] == owners[e.who]).all()
        pieces = list(e.cut(3))
        assert np.concatenate([p.fp for _, p in pieces]).tolist() == fp.tolist() and all((p.fp >> np.uint64(61) == k).all() for k, p in pieces)
        assert np.concatenate([p.owners[p.who] for _, p in pieces]).tolist() == owners[e.who].tolist()
        parts.append(e)
    rows = sorted((int(f), *map(int, reversed(e.owners[w]))) for e in parts for f, w in zip(e.fp, e.who))
    m = Entries.merged(parts)
    assert [(int(f), int(m.owners[w, 2])) for f, w in zip(m.fp, m.who)] == [r[:2] for r in rows]
    first = m.firsts()
    assert [(int(f), int(first.owners[w, 2])) for f, w in zip(first.fp, first.who)] == [(f, min(r[1] for r in rows if r[0] == f)) for f in sorted({r[0] for r in rows})]
    asking, asked = m.hits(2)
    got = {(int(m.fp[a]), int(m.owners[m.who[a], 0])): (int(m.fp[b]), int(m.owners[m.who[b], 2])) for a, b in zip(asking, asked)}
    for f, i, _, run in rows:
        smaller = [r[1] for r in rows if r[0] == f and r[1] < i]
        assert got.get((f, run)) == ((f, max(smaller)) if smaller and run >= 2 else None)


def test_a_false_hit_removes_nothing(monkeypatch):
    monkeypatch.setattr(substring, "window_hashes", lambda words, window: np.zeros(max(len(words) - window + 1, 0), np.uint64))
    run = substring._Run([1, 2, 3], [b"a " * 14, b"b " * 14, b"a " * 13], 13)
    run.read(passages=[b"c " * 13])
    assert [r[2] for r in run.kept(run.repeated())] == [0, 0, 13]


def test_fingerprints_are_the_windows_own():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    h = substring.window_hashes(words, 13)
    assert len(h) == 488 and len(set(h.tolist())) == 488
    for k in (0, 7, 487):
        assert substring.window_hashes(words[k : k + 13], 13).tolist() == [h[k]]
    assert len(substring.window_hashes(words[:12], 13)) == 0

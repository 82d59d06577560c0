"""Near-duplicates of a stated similarity against brute force over sets of shingles."""

import itertools
import random

import numpy as np
import pytest

from chronolith.llm import neardup


def _sets(rows):
    return {i: frozenset(" ".join(w[k : k + 5]) for k in range(len(w) - 4)) for i, t in rows for w in [t.split()]}


def _alike(x, y):
    return len(x & y) / len(x | y)


def _components(sets, least=0.8):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(sets), 2):
        if find(i) != find(j) and _alike(sets[i], sets[j]) >= least:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def _found(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in neardup.near_duplicate_groups(docs, **options).collect()}


def _changed(rng, words, changes, mark):
    w = list(words)
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"{mark}{rng.randrange(10**9)}"
    return w


@pytest.mark.parametrize("boilerplate", [0, 240])
def test_pairs_with_and_without_boilerplate(spark, boilerplate):
    rng = random.Random(5)
    common = [f"b{k}" for k in range(boilerplate)]
    rows, pairs = [], []
    for k in range(300):
        base = common + [f"w{rng.randrange(10**6)}" for _ in range(300 - boilerplate if boilerplate else rng.randrange(80, 300))]
        other = _changed(rng, base, rng.randrange(0, 1 + len(base) // 70), "x")
        rows += [(k, " ".join(base)), (1000 + k, " ".join(other))]
    sets = _sets(rows)
    pairs = [k for k in range(300) if 0.8 <= _alike(sets[k], sets[1000 + k]) < 1]
    got = _found(spark, rows)
    assert len(pairs) > 150 and sum(got[1000 + k] == got[k] for k in pairs) >= 0.97 * len(pairs)
    members = {}
    for i, c in got.items():
        members.setdefault(c, []).append(i)
    for m in members.values():  # every member has a proven neighbour
        assert len(m) == 1 or all(max(_alike(sets[i], sets[j]) for j in m if j != i) >= 0.8 for i in m)


@pytest.mark.parametrize("planned", [None, 10**8])
def test_template_clusters_against_all_pairs(spark, planned):
    rng = random.Random(11)
    rows = []
    for c, most in enumerate((3, 7, 12)):  # from a tight cluster to one that falls apart
        base = [f"t{c}x{k}" for k in range(200)]
        rows += [(1000 * c + k, " ".join(_changed(rng, base, rng.randrange(1, most), "y"))) for k in range(120)]
    rng.shuffle(rows)
    sets = _sets(rows)
    want, got = _components(sets), _found(spark, rows, planned_rows=planned)
    linked = [i for i in want if want[i] != i]
    assert len(linked) > 150 and sum(got[i] != i for i in linked) >= 0.97 * len(linked)
    assert all(want[got[i]] == want[i] for i in got)  # no link that the sets don't prove
    assert sum(got[i] == want[i] for i in got) >= 0.95 * len(got)


def test_blocks_and_split_groups_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"t{k}" for k in range(150)]
    rows = [(k, " ".join(_changed(rng, base, rng.randrange(3, 9), "y"))) for k in range(90)]
    want = _components(_sets(rows))
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "BLOCK_BYTES", 8_000)
    got = _found(spark, rows, small_bytes=0)
    assert all(want[got[i]] == want[i] for i in got)
    assert sum(got[i] == want[i] for i in got) >= 0.95 * len(got)


def test_block_merges_join_what_all_pairs_join():
    rng = random.Random(2)
    base = [f"t{k}" for k in range(200)]
    texts = [" ".join(_changed(rng, base, rng.randrange(4, 12), "y")).encode() for _ in range(120)]
    sets = [neardup._shingles(t, 5) for t in texts]
    sigs = np.stack([neardup.signature(s).view("<u8") for s in sets])
    names = np.arange(120, dtype=np.int64)
    alike = {(i, j) for i, j in itertools.combinations(range(120), 2) if neardup.similar(sets[i], sets[j], 0.8)}

    def find(i, root):
        while root[i] != i:
            i = root[i]
        return i

    def joined(links):
        root = list(range(120))
        for a, b in links:
            a, b = find(a, root), find(b, root)
            root[max(a, b)] = min(a, b)
        return [find(i, root) for i in range(120)]

    sure, hopeless = neardup.distance_limits(0.8, 448)
    whole = neardup.block_merges(names, sigs, sets, 0, sure, hopeless, 0.8)
    assert joined(whole) == joined(alike) and len(whole) < 120
    parts = [neardup.block_merges(names[a:b], sigs[a:b], sets[a:b], s, sure, hopeless, 0.8) for a, b, s in ((0, 50, 0), (50, 120, 0), (0, 120, 50))]
    assert joined(x for p in parts for x in p) == joined(alike)
    assert neardup.block_merges(names * 0, sigs, sets, 0, sure, hopeless, 0.8) == []
    d = np.bitwise_count(sigs[:, None] ^ sigs[None]).sum(axis=2)
    close = [(i, j) for i, j in itertools.combinations(range(120), 2) if d[i, j] <= 60]
    stars = [neardup.block_trees(names[a:b], names[a:b], sigs[a:b], s, 60) for a, b, s in ((0, 50, 0), (50, 120, 0), (0, 120, 50))]
    assert joined(x for p in stars for x in p) == joined(close) and len(stars[0]) < 50


@pytest.mark.parametrize("n", [2, 10**3, 10**4, 10**5, 10**6, 6 * 10**6, 3 * 10**7, 10**8, 10**10])
def test_tables_keep_the_recall_as_rows_grow(n):
    p = neardup.differing_share(0.8)
    tables, bits = neardup.table_plan(n, 0.8, 0.97)
    hit = sum(neardup.math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    assert 1 - (1 - hit) ** tables >= 0.97
    words = neardup.signature_words(tables, bits)
    assert 64 * (words - 1) >= tables * bits
    keys = neardup._table_keys(np.full(words, -1), tables, bits)
    assert keys == [(1 << bits) - 1 | t << bits for t in range(tables)] and max(keys) < 1 << 63 and bits < 64


def test_long_equal_and_short_texts(spark):
    long = "der die das und " * 100_000
    rows = [(5, long), (3, long + " "), (None, long), (1, None), (2, ""), (4, " \n"), (6, "one two"), (7, "one two"), (7, "one two"), (8, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicate_groups(docs).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got) == [(0, 3), (1, 1), (2, 1), (3, 3), (4, 1), (5, 3), (6, 6), (7, 6), (7, 6), (8, 8)]
    assert neardup.near_duplicate_groups(docs.limit(0)).count() == 0


def _classes_that_meet(keys, bits):
    """All pairs of keys of one table that share a variant, and how many classes each variant has."""
    variants = {}
    for k in keys:
        for v in (k, *(k ^ 1 << b for b in range(bits))):
            variants.setdefault(v, []).append(k)
    pairs = {p for m in variants.values() for p in itertools.combinations(sorted(m), 2)}
    return pairs, [len(m) for m in variants.values()]


@pytest.mark.parametrize("width", [neardup.FAMILY_BITS, 1, 0])
def test_a_hot_region_is_settled_before_its_classes_make_pairs(spark, monkeypatch, width):
    monkeypatch.setattr(neardup, "FAMILY_BITS", width)
    rng = random.Random(7)
    base = [f"t{k}" for k in range(200)]
    rows = [(k, " ".join(_changed(rng, base, rng.randrange(1, 9), "y"))) for k in range(300)]
    rows += [(1000 + k, " ".join(_changed(rng, [f"u{c}" for c in range(60)], 4, "z"))) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    s = neardup._Search(docs, "doc_id", "text", 5, 0.8, 0.97, None, 32 << 20)
    s.sign()
    s.classify()
    member = {r["id"]["id"]: r["node"] for r in s.signed.collect()}
    component = {member[k]: min(member[j] for j in range(300) if j % 40) for k in range(300) if k % 40}  # all but some of the hot ones
    component |= {member[1000 + k]: min(member[1000 + j] for j in range(10)) for k in range(10)}
    families = spark.createDataFrame(list(component.items()), "node long, component long")
    spread = s.spread(families)
    pairs, wide = s.class_pairs(s.shared(families, spread))
    made, wide = [(r["k1"], r["k2"]) for r in pairs.collect()], [r["keys"] for r in wide.collect()]

    groups = {}
    for r in s.members.collect():
        groups.setdefault(r["key"], set()).add(component.get(r["node"], r["node"]))
    want, sizes = _classes_that_meet(groups, s.bits)
    held = {p for m in wide for p in itertools.combinations(sorted(m), 2)}
    assert set(made) <= want and held <= want
    assert {(a, b) for a, b in want if len(groups[a] | groups[b]) > 1} <= set(made) | held  # none is lost
    once = [p for p in made if p not in held]
    assert len(once) == len(set(once))
    before = sum(n * (n - 1) // 2 if n <= 4 else n - 1 for n in sizes)
    assert len(made) < (0.5 if width else 0.9) * before and len(made) <= 1.5 * sum(n for n in sizes if n > 1)


@pytest.mark.parametrize("n", [2, 10**5, 10**8, 10**10, 10**13])
def test_family_numbers_fit_beside_variants_and_masks(n):
    tables, bits = neardup.table_plan(n, 0.8, 0.97)
    width = neardup.family_bits(tables, bits)
    assert width >= 0 and (width == 0 or 6 + bits + (tables - 1).bit_length() + width <= 63) and bits + 1 + 2 * width <= 63

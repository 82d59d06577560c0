"""Operators against brute force, exact round trips and held-out accuracy."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import decontaminate, embeddings, graph, langid, licences, quality, simhash, toxicity
from chronolith.llm.common import checkpointed, pieces

SF = "/root/testdata/sf0.01"


def _components(ids, links):
    parent = {i: i for i in ids}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(4)
    links = {"path": [(k, k + 1) for k in range(60)], "star": [(500, k) for k in range(100)], "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]}[shape]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {x for a, b in links for x in (a, b) if a != b}
    assert got == _components(ids, [x for x in links if x[0] != x[1]])


@pytest.mark.parametrize("shape", ["path", "hub", "random"])
def test_components_over_several_tasks(spark, monkeypatch, shape):
    rng = random.Random(5)
    links = {"path": [(k + 1, k) for k in range(40)], "hub": [(0, k) for k in range(1, 60)] + [(-7, 59)], "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(110)]}[shape]
    monkeypatch.setattr(graph, "EDGES_A_TASK", 8)
    rows = [tuple(r) for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()]
    ids = {x for a, b in links for x in (a, b) if a != b}
    assert len(rows) == len(ids) and dict(rows) == _components(ids, links)


def test_components_of_one_task_take_no_rounds(spark):
    edges = checkpointed(spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long"))
    sc = spark.sparkContext
    sc.setJobGroup("one-task", "components")
    graph.components(edges)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(sc.statusTracker().getJobIdsForGroup("one-task")) <= 6


def test_close_fingerprints_against_all_pairs(spark):
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in fps[:40]:
        for d in (1, 2, 3, 3, 3, 4, 4):
            fps.append(f ^ sum(1 << b for b in rng.sample(range(64), d)))
    fps += [fps[0] ^ (7 << 20), fps[1] ^ (7 << 61), fps[2] ^ 1 ^ (1 << 16) ^ (1 << 48)]
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    got = {r["fp"]: r["component"] for r in simhash.close_fingerprints(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    links = [(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    want = _components(fps, links)
    same = lambda m: {frozenset(k for k in m if m[k] == c) for c in m.values()}
    assert same(got) == same(want)


def test_simhash_pieces_change_nothing(monkeypatch):
    text = ("Lorem ipsum  dolor\tsit amet\nconsectetur " * 40).encode()
    assert b"".join(pieces(text, 50)) == text
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "PIECE", 37)
    assert simhash.fingerprint(text) == whole
    assert simhash.fingerprint(b"") == simhash.fingerprint(None) == 0


@pytest.mark.parametrize("n", range(1, 16))
def test_masks_hit_every_pattern_that_is_let_pass(n):
    masks = decontaminate.masks_for(min(n, 13))
    window = min(n, 13)
    wrong = max(k for k in range(window + 1) if (window - k) / window >= 0.8)
    for start in range(n - window + 1):
        for p in itertools.combinations(range(start, start + window), wrong):
            assert any(all(o + k not in p for k in m) for m in masks for o in range(start, start + window - max(m)))
    if n == 15:
        for p in itertools.combinations(range(n), 3):
            assert any(all(o + k not in p for k in m) for m in masks for o in range(n - max(m)))


def test_leaks_of_items_of_every_length(spark):
    rng = random.Random(6)
    items, docs, want = [(0, ""), (99, None)], [], set()
    for n in range(1, 16):
        words = [f"i{n}x{k}" for k in range(n)]
        items.append((n, " ".join(words)))
        for k, wrong in enumerate([0, 1, 2, 3]):
            if wrong > n:
                continue
            part = list(words)
            for at in rng.sample(range(n), wrong):
                part[at] = "zzz"
            doc = 100 * n + k
            docs.append((doc, " ".join([f"d{rng.randrange(99)}" for _ in range(20)] + part + ["end"])))
            sums = [sum(x != "zzz" for x in part[a : a + 13]) / min(n, 13) for a in range(max(1, n - 12))]
            if max(sums) >= 0.8:
                want.add((doc, n))
    docs += [(None, items[7][1]), (5000, None), (5001, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    for small in (32 << 20, 0):
        got = {(r["doc_id"], r["best_item"]) for r in decontaminate.contaminated(docs, bench, small_bytes=small).collect()}
        assert got == want | {(None, 6)}
    with pytest.raises(ValueError):
        decontaminate.contaminated(docs, bench, least=0.7)


def test_leaks_with_substitutions(spark):
    rng = random.Random(2)
    items = [(k, " ".join(f"b{rng.randrange(400)}" for _ in range(30))) for k in range(20)]
    docs, want = [], set()
    for k in range(60):
        w = [f"d{rng.randrange(400)}" for _ in range(200)]
        part = items[k % 20][1].split()[5:20]
        for at in rng.sample(range(15), (0, 2, 3, 9)[k % 4]):
            part[at] = "zzz"
        docs.append((k, " ".join(w[:100] + part + w[100:])))
        sums = [sum(x != "zzz" for x in part[a : a + 13]) for a in range(3)]
        if max(sums) / 13 >= 0.8:
            want.add(k)
    got = {r["doc_id"] for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want
    assert 30 <= len(want) < 60


@pytest.mark.parametrize("planned", [None, 2**23, 2**32])
def test_embedding_recall_against_brute_force(spark, planned):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 64))
    near = [base[:30] + rng.normal(scale=s, size=(30, 64)) for s in (0.05, 0.1, 0.15, 0.19)]
    hot = base[50] + rng.normal(scale=0.1, size=(150, 64))  # one bucket of several blocks
    v = np.concatenate([base, *near, hot])
    rows = [(int(k), [float(x) for x in a], 0 if k >= 180 else int(k % 30 % 3)) for k, a in enumerate(v)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embeddings.near_vectors(docs, block=8, planned_rows=planned).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    link = (u @ u.T >= 0.98) & (lab[:, None] == lab)
    np.fill_diagonal(link, False)
    assert all(got[k]["n_links"] <= n for k, n in enumerate(link.sum(axis=1)))
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * link.sum() > 0


def test_vectors_of_many_lengths(spark):
    rng = np.random.default_rng(3)
    rows = []
    for d in range(1, 25):
        a = rng.normal(size=d)
        rows += [(10 * d, a.tolist(), 1), (10 * d + 1, (a * 3 + 1e-9).tolist(), 1), (10 * d + 2, (-a).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df, lengths=3).collect()}
    for d in range(1, 25):
        assert got[10 * d] == got[10 * d + 1] == (1, 10 * d) and got[10 * d + 2] == (0, 10 * d + 2)


def test_segments_against_definition():
    def brute(x, at=0):
        best = max(((round(sum(x[i : j + 1]), 9), -(j - i), i, j) for i in range(len(x)) for j in range(i, len(x))), default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        i, j = best[2:]
        return brute(x[:i], at) + [(at + i, at + j)] + brute(x[j + 1 :], at + j + 1)

    rng = random.Random(1)
    for _ in range(200):
        x = [rng.choice([-1.03, -2.11, 3.07, 1.53, -0.57, 2.19]) for _ in range(11)]
        assert sorted((a, b) for a, b, _ in toxicity.segments(list(enumerate(x)), -1)) == sorted(brute(x))
        sparse = [(k, v) for k, v in enumerate(x) if v > 0]
        y = [v if v > 0 else -0.7 for v in x]
        assert sorted((a, b) for a, b, _ in toxicity.segments(sparse, -0.7)) == sorted(brute(y))


def _network(rng):
    e = rng.normal(size=(256, quality.EMBED)).astype(np.float32)
    e[0] = 0
    f = rng.normal(size=(quality.SPAN * quality.CHANNELS, 5)).astype(np.float32)
    return {"e": e, "f": f, "o": rng.normal(size=5).astype(np.float32), "w": rng.normal(size=5), "b": np.array([0.3])}


def test_convolution_covers_every_byte():
    for n in (0, 1, 511, 512, 513, 992, 993, 5000):
        text = bytes(1 + k % 200 for k in range(n))
        c = quality.chunks(text)
        step = quality.CHUNK - quality.OVERLAP
        assert all(text[k] == c[min(k // step, len(c) - 1)][k - min(k // step, len(c) - 1) * step] for k in range(n))


def test_network_against_loops():
    p = _network(np.random.default_rng(0))
    m = quality.QualityModel(p["e"], p["f"], p["o"], p["w"], 0.3)
    texts = [b"abc " * 10, b"", b"x" * 3000, "Grüße, 12!\n".encode() * 120]

    def by_hand(text):
        top = [0.0] * 5
        for c in quality.chunks(text).tolist():
            cells = []
            for cell in range(quality.CHUNK // quality.CELL):
                places = range(cell * quality.CELL, (cell + 1) * quality.CELL)
                cells.append(max(sum(j >= lag and c[j] > 0 and c[j] == c[j - lag] for j in places) for lag in quality.LAGS) / quality.CELL)
            for at in range(0, quality.CHUNK - quality.SPAN + 1, quality.STEP):
                x = [v for j in range(at, at + quality.SPAN) for v in [*p["e"][c[j]].tolist(), cells[j // quality.CELL]]]
                for k in range(5):
                    top[k] = max(top[k], sum(a * b for a, b in zip(x, p["f"][:, k].tolist())) + float(p["o"][k]))
        return 1 / (1 + math.exp(-sum(t * w for t, w in zip(top, p["w"])) - 0.3))

    assert np.allclose(m.scores(texts), [by_hand(t) for t in texts], atol=1e-3)
    assert np.allclose(m.scores(texts), [m.scores([t], 3)[0] for t in texts], atol=1e-5)


def test_gradients_against_differences():
    rng = np.random.default_rng(4)
    p = {k: v.astype(np.float64) for k, v in _network(rng).items()}
    docs = [quality.chunks(t) for t in (b"some words, and more " * 60, b"", b"Zz9" * 50)]
    reps, y = [quality.repetition(d) for d in docs], np.array([1.0, 0.0, 0.0])

    def loss(q):
        m = quality.QualityModel(q["e"], q["f"], q["o"], q["w"], float(q["b"][0]))
        z = [max(0.0, 0.0) + float(np.max([m.responses(d, r).max(axis=(0, 1)) if len(d) else np.zeros(5)], axis=0) @ q["w"] + q["b"][0]) for d, r in zip(docs, reps)]
        return float(np.mean([math.log1p(math.exp(-v)) if t else math.log1p(math.exp(v)) for v, t in zip(z, y)]))

    g = quality.gradients(p, docs, reps, y, penalty=0.0)
    for k, at in [("b", (0,)), *(("w", (j,)) for j in range(5)), ("o", (2,)), *(("f", (j, 1)) for j in (0, 8, 17, 40, 71)), *(("e", (c, 3)) for c in b"sowZz9 ")]:
        change = np.zeros_like(p[k])
        change[at] = 1e-3
        slope = (loss(p | {k: p[k] + change}) - loss(p | {k: p[k] - change})) / 2e-3
        assert abs(slope - g[k][at]) < 2e-3 * max(1, abs(slope)), (k, at)
    assert (g["e"][0] == 0).all()


def test_bayes_against_a_dictionary(spark):
    rng = random.Random(9)
    parts = {"xx": ["ab", "ba", "ak"], "yy": ["ab", "öb", "ük"], "zz": ["кот", "он"]}
    rows = [(k, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(12)) + " 12!", lang) for k in range(30) for lang in [rng.choice(list(parts))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.score_languages(df, langid.fit_languages(df)).collect()}

    def grams(text):
        out, word = [], ""
        for c in text.lower():  # runs of other characters are one space; a text doesn't start or end with one of its own
            word += c if c.isalpha() else ("" if word.endswith(" ") else " ")
        for n in langid.ORDERS:
            for i in range(len(word) - n + 1):
                h = 0x811C9DC5 + n
                for c in word[i : i + n]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ ord(c)
                    h ^= h >> 13
                out.append((h * 0x2C1B3C6D & 0xFFFFFFFF) >> 7 & langid.BUCKETS - 1)
        return out

    counts = {lang: {} for lang in parts}
    for _, t, lang in rows:
        for b in grams(t):
            counts[lang][b] = counts[lang].get(b, 0) + 1
    for i, t, _ in rows:
        logs = {lang: sum(math.log((c.get(b, 0) + 0.05) / (sum(c.values()) + 0.05 * langid.BUCKETS)) for b in grams(t)) for lang, c in counts.items()}
        best = max(logs, key=logs.get)
        p = 1 / sum(math.exp(v - logs[best]) for v in logs.values())
        assert got[i][0] == best and abs(got[i][1] - p) < 1e-3


def test_sample_of_ids_is_exact_and_even(spark):
    from chronolith.llm.common import bounded_ids

    rows = [(k % 5000, "hot" if k % 10 else "rare") for k in range(20_000)] + [(1, "hot")] * 500 + [(None, "hot")] * 50
    df = spark.createDataFrame(rows, "id long, s string")
    got = bounded_ids(df, ["s"], "id", 100, 10_000, 3).collect()
    hashes = {r["id"]: r["h"] for r in df.where("id IS NOT NULL").select("id", F.shiftrightunsigned(F.xxhash64(F.lit(3), "id"), 11).alias("h")).distinct().collect()}
    for s in ("hot", "rare"):
        ids = {i for i, t in rows if t == s and i is not None}
        assert {r["id"] for r in got if r["s"] == s} == set(sorted(ids, key=lambda i: (hashes[i], i))[:100])
    assert bounded_ids(df, ["s"], "id", 100, 7, 3).count() == 7


def test_fingerprints_from_text_to_component(spark):
    assert simhash.xxhash.xxh64_intdigest(b"") == 0xEF46DB3751D8E999 and simhash.xxhash.xxh64_intdigest(b"abc") == 0x44BC2CF5AD770999
    of_spark = spark.sql("SELECT xxhash64('the quick fox') AS h").first()["h"] & (1 << 64) - 1  # Spark's own XXH64 has seed 42
    assert list(simhash.shingle_hashes(b"The QUICK\tfox"))[0].tolist() == [of_spark]
    rng = random.Random(12)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 30, 300]))) for _ in range(60)]
    for t in texts[:40]:
        w = t.split()
        w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += ["", None, " \n ", texts[0].upper(), "Ä x y", "ä x y"]
    ids = rng.sample(range(1000), len(texts))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def fp(text):
        w = (text or "").translate(lower).split()
        grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [simhash.xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {i: fp(t) for i, t in zip(ids, texts)}
    want = _components(ids, [(i, j) for i, j in itertools.combinations(ids, 2) if (fps[i] ^ fps[j]).bit_count() <= 3])
    got = {r["doc_id"]: r for r in simhash.simhash_components(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()}
    assert {i: r["fp"] & (1 << 64) - 1 for i, r in got.items()} == fps
    assert {i: r["component_id"] for i, r in got.items()} == want and len(set(want.values())) < len(ids) - 5


def test_toxicity_from_text_to_score(spark):
    rng = random.Random(21)
    rows = []
    for k in range(400):
        w = [f"w{chr(97 + rng.randrange(20))}x" for _ in range(rng.randrange(5, 40))]
        if k % 4 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "vileness", "foul"]))
        rows.append((k, " ".join(w), int(k % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.fit_toxicity(df.drop("toxic"), df.select("doc_id", "toxic"))
    # lexicon: log-odds under the prior, by hand
    counts = {}
    for _, t, y in rows:
        for f in {f for w in set(t.split()) for f in [w + "$", *(w[:n] for n in range(3, min(len(w), 7) + 1))]}:
            counts.setdefault(f, [0, 0])[0 if y else 1] += 1
    na, nb = sum(a for a, _ in counts.values()), sum(b for _, b in counts.values())
    want = {}
    for f, (a, b) in counts.items():
        own, prior = 0.02 * (a + b), 0.02 * (na + nb)
        s = math.log((a + own) / (na + prior - a - own)) - math.log((b + own) / (nb + prior - b - own))
        if abs(s / math.sqrt(1 / (a + own) + 1 / (b + own))) >= 3:
            want[f] = s
    assert m.lexicon.keys() == want.keys() and all(abs(m.lexicon[f] - s) < 1e-9 for f, s in want.items()) and "vil" in want
    clean = {f: counts[f][1] / nb for f in want}
    assert abs(m.drift + max(0.05, 2 * sum(clean[f] * max(s, 0) for f, s in want.items()))) < 1e-9
    assert abs(sum(clean[f] * math.exp(m.lam * s) for f, s in want.items()) + max(0, 1 - sum(clean.values())) * math.exp(m.lam * m.drift) - 1) < 1e-3 or m.lam > 49
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(df, m).collect()}
    for k, t, _ in rows[:60]:
        x = []
        for w in t.split():
            x.append(next((want[f] for f in [w + "$", *(w[:n] for n in range(min(len(w), 7), 2, -1))] if f in want), m.drift))
        found = []

        def split(lo, hi):  # maximal segments, by the definition
            best = max(((sum(x[i : j + 1]), i - j, i, j) for i in range(lo, hi) for j in range(i, hi)), default=(0, 0, 0, 0))
            if best[0] > 1e-12:
                found.append(best[0])
                split(lo, best[2])
                split(best[3] + 1, hi)

        split(0, len(x))
        marked = any(v != m.drift for v in x)
        over = [m.lam * s - m.log_k - math.log(len(x)) for s in found] if marked else []
        z = m.bias + m.slope * math.log1p(sum(v for v in over if v > 0))
        assert abs(got[k] - 1 / (1 + math.exp(-z))) < 1e-6


def test_licence_spellings(spark):
    shout = "COPYRIGHT (C) 2020 Someone\n" + licences.MIT.upper().replace(", ", " ,  ")
    rows = [(1, shout), (2, "Released under the MIT Licence!"), (3, "x Released under the MIT License."), (4, "some text\nLicensed under CC BY-NC 4.0")]
    got = {r["doc_id"]: (r["licences"], r["whole"]) for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), licences.known_digests(spark)).collect()}
    assert got == {1: (["MIT"], True), 2: (["MIT"], True), 4: (["CC-BY-NC-4.0"], False)}


def test_held_out_accuracy(spark):
    docs, labels = (checkpointed(spark.read.parquet(f"{SF}/{t}.parquet")) for t in ("documents", "labels"))
    lang = langid.op1_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (lang.lang == lang.lang_pred).mean() > 0.97
    q = quality.op3_quality(spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    assert (q.predicted == q.quality).mean() > 0.93
    t = toxicity.op9_toxicity(spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    assert (t.predicted == t.toxic).mean() > 0.9


@pytest.mark.parametrize("bits", [1, 2, 3, 7, 8, 12, 16, 24, 32, 48, 63, 64])
def test_embedding_tables_keep_seven_bits(bits):
    for n in [0, 1, 2, 100, 10**4, 65_537, 10**6, 2**21 + 1, 10**7, 10**8, 2**32]:
        tables, radius = embeddings.plan(n, bits)
        width = -(-bits // tables)
        assert radius >= width or tables * (radius + 1) - 1 >= min(7, bits)
        assert sum(embeddings.math.comb(width, k) for k in range(radius + 1)) <= 2_000


def test_toxicity_keeps_its_meaning_under_a_bound(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(6000):
        toxic = k % 10 == 0
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 80))]
        for _ in range(rng.randrange(4) if toxic else rng.random() < 0.2):
            words.insert(rng.randrange(len(words)), f"bad{rng.randrange(5)}")
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    score = [{r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, most=most)).collect()} for most in (20_000, 1_200)]
    mean = [sum(x.values()) / len(x) for x in score]
    assert sum((score[0][k] >= 0.5) != (score[1][k] >= 0.5) for k in score[0]) <= 0.02 * len(score[0])
    assert all(abs(m - 0.1) < 0.03 for m in mean)

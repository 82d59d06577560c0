"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from chronolith.llm import decontaminate, embeddings, langid, licences, mixing, neardup, pii, quality, simhash, substring, toxicity
from chronolith.llm.common import checkpointed

LONG = "der die das und " * 200_000
SCHEMA = "doc_id long, text string, lang string, source string, component string, key string, size long, score double, label int, block int, w string, seed int, rep long, n int, fp long"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [
        (1, "The cat sat on the mat and the dog ran away from the house today", "en", "a"),
        (1, "The cat sat on the mat and the dog ran away from the house today", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "b"),
        (4, "  \n\t ", "en", None),
        (5, "12345 !!! ???", "en", "a"),
        (None, "Der Hund lief aus dem Haus und die Katze saß auf der Matte", "de", "b"),
        (None, None, None, None),
        (6, LONG, "de", "hot"),
        (7, "The cat sat on the mat and the dog ran away from the house today", None, "a"),
        (8, "word", "fr", ""),
    ]
    return checkpointed(spark.createDataFrame([(*t, *[None] * 11) for t in texts], SCHEMA))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language(odd, none):
    m = langid.fit_languages(odd)
    got = langid.score_languages(odd, m, keep=("text",)).collect()
    assert len(got) == 11
    for r in got:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
        assert 0 <= r["score"] <= 1
    assert next(r["lang_pred"] for r in got if r["text"] == LONG) == "de"
    assert langid.score_languages(none, langid.fit_languages(none)).count() == 0
    assert {r["lang_pred"] for r in langid.score_languages(odd, langid.fit_languages(none)).collect()} == {"und"}


def test_language_of_slices_is_that_of_the_whole():
    import numpy as np

    a = sum(np.bincount(langid._buckets([p])[1][2], minlength=langid.BUCKETS + 1)[: langid.BUCKETS] for p in langid._slices("abc déf ghi " * 50, 101))
    b = np.bincount(langid._buckets(["abc déf ghi " * 50])[1][2], minlength=langid.BUCKETS + 1)[: langid.BUCKETS]
    assert abs(a.sum() - b.sum()) <= 12


def test_substrings(odd, none):
    got = substring.dedup_substrings(odd).collect()
    assert len(got) == 11
    removed = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got if r["doc_id"] in (1, 7))
    assert removed == [(1, 15, 0), (1, 15, 0), (7, 15, 15)]
    assert next(r["n_removed"] for r in got if r["doc_id"] == 6) == 0
    assert substring.dedup_substrings(none).count() == 0


def test_simhash(odd, none):
    got = {(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.simhash_components(odd).collect()}
    assert simhash.simhash_components(odd).count() == 11
    assert {c for i, f, c in got if i in (1, 7)} == {1}
    assert {f for i, f, c in got if i in (2, 3, 4)} == {0}
    assert {c for i, f, c in got if i in (2, 3, 4)} == {2}
    assert simhash.simhash_components(none).count() == 0


def test_near_duplicates(odd, none):
    got = neardup.near_duplicate_groups(odd)
    assert got.count() == 11
    assert {r["component_id"] for r in got.where("doc_id IN (1, 7)").collect()} == {1}
    assert neardup.near_duplicate_groups(none).count() == 0


def test_decontamination(spark, odd, none):
    bench = spark.createDataFrame([(1, "the cat sat on the mat and the dog ran far from the house"), (2, None), (3, ""), (4, "too short"), (None, "der die der das")], "item_id long, text string")
    found = decontaminate.contaminated(odd, bench).collect()
    assert {r["doc_id"] for r in found} == {1, 7}
    assert all(r["best_item"] == 1 and 0.8 <= r["best_overlap"] < 1 for r in found)
    assert decontaminate.decontaminate(odd, bench).count() == 8
    assert decontaminate.decontaminate(odd, bench).columns == odd.columns
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0
    both = decontaminate.contaminated(odd, bench, small_bytes=0).collect()
    assert {(r["doc_id"], r["best_overlap"]) for r in both} == {(r["doc_id"], r["best_overlap"]) for r in found}


def test_mixing(odd, none):
    size, content = mixing.n_words(F.col("text")), F.xxhash64("text")
    odd = odd.withColumns({"_size": F.lit("x"), "skey": F.lit("y"), "mix_shard": F.lit("z"), "words": F.lit(1), "idx": F.lit(2), "d": F.lit(3)})
    m = mixing.mix(odd, size, content)
    got = m.collect()
    assert len(got) == 11 and m.columns == [*(c for c in odd.columns if c != "_size"), *mixing.ADDED]
    assert all(0 <= r["_taken"] <= 2 * r["_size"] for r in got)
    by = {r["source"]: r["_target"] for r in got}
    for s, t in by.items():
        assert abs(sum(r["_taken"] for r in got if r["source"] == s) - t) <= 1
    assert mixing.mix(none, size, content).count() == 0 and mixing.mixed_rows(none).count() == 0
    mixed = mixing.mixed_rows(odd)
    assert mixed.agg(F.sum("mix_words")).first()[0] == sum(r["_taken"] for r in got)
    assert mixed.columns == [*(c for c in odd.columns if c != "mix_shard"), *mixing.MIX_COLUMNS]
    assert mixing.mix(odd.where("size(split(coalesce(text, ''), ' ')) = 1 AND coalesce(trim(text), '') = ''"), size, content).agg(F.sum("_target")).first()[0] == 0


def test_pii(odd, none):
    key = b"k"
    odd = odd.withColumns({"_n_entities": F.lit(7), "th": F.lit("x"), "again": F.lit("y"), "kind": F.lit("z")})
    got = pii.replace_entities(odd, key=key)
    kept = [c for c in odd.columns if c != "_n_entities"]
    assert got.count() == 11
    assert got.columns == [*kept, "_n_entities"]
    assert got.where("_n_entities != 0").count() == 0
    assert got.select(kept).exceptAll(odd.select(kept)).count() == 0
    assert odd.select(kept).exceptAll(got.select(kept)).count() == 0
    assert pii.replace_entities(none, key=key).count() == 0
    assert pii.replace_entities(odd, key=key, count_col="m").columns == [*odd.columns, "m"]


def test_licences(odd, none, spark):
    k = licences.known_digests(spark)
    assert licences.scan_licences(odd, k).count() == 0
    assert licences.scan_licences(none, k).count() == 0
    notice = "Released under the MIT License."
    rows = [(1, notice), (1, notice), (1, "x\n" + notice + "\n" + notice), (None, notice), (None, notice), (2, "Licensed under CC BY 4.0.\n" + notice), (3, LONG + "\n" + notice), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_id", F.lit(1)).withColumn("digest", F.lit("x"))
    for most in (100_000, 0):
        got = [(r["doc_id"], r["licences"], r["whole"]) for r in licences.scan_licences(docs, k, most_lengths=most).collect()]
        assert sorted(got, key=str) == [(1, ["MIT"], False), (1, ["MIT"], True), (2, ["CC-BY-4.0", "MIT"], False), (3, ["MIT"], False), (None, ["MIT"], True)]
    assert licences.scan_licences(docs, k.limit(0)).count() == 0


def test_classifiers(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (3, 0, 1), (6, 0, None), (None, 1, 1), (99, None, 0)], "doc_id long, quality int, toxic int")
    for fit, score in ((toxicity.fit_toxicity, toxicity.score_toxicity), (quality.fit_quality, quality.score_quality)):
        for docs, lab in ((odd, labels), (odd, labels.limit(0)), (none, labels), (odd, labels.where("doc_id = 3"))):
            got = score(docs, fit(docs, lab)).collect()
            assert len(got) == docs.count()
            assert all(0 <= r["score"] <= 1 for r in got)
            texts = {r["doc_id"]: r["score"] for r in got if r["doc_id"] in (2, 3)}
            assert len(set(texts.values())) <= 1  # a null text and an empty one score alike
    one = spark.createDataFrame([(3, 1, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    for lab, share in ((one, 1.0), (one.limit(0), 0.0), (one.selectExpr("doc_id", "0 AS quality", "0 AS toxic"), 0.0)):
        assert {round(r["score"], 6) for r in toxicity.score_toxicity(odd, toxicity.fit_toxicity(odd, lab)).collect()} == {share}
        got = {round(r["score"], 5) for r in quality.score_quality(odd, quality.fit_quality(odd, lab)).collect()}
        assert got == {share if lab.count() else 0.5}


def test_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    v = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, None], 1), (10, [2.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [], 1), (None, [1.0, 0.0], 1), (13, [1.0, 0.0], 1), (14, [0.0, 1.0], 1)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df).collect()}
    assert len(got) == len(v)
    for i in (1, 2, 10, 13):
        assert got[i][:2] == (3, 1)
    for i in (3, 4, 5, 6, 7, 8, 9, 11, 12, 14):
        assert got[i] == (0, i, True)
    assert embeddings.near_vectors(df.limit(0)).count() == 0
    assert embeddings.near_vectors(df.where("vec_id = 5")).count() == 1

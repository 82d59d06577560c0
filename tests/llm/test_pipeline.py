"""The pipeline's stages against what their operators must keep."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as cp
from chronolith.llm.langid import BUCKETS, LanguageModel, score_languages


def test_stages(spark):
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank in the morning sun", "en", "a", 1),
        (2, "The quick brown fox jumps over the lazy dog near the river bank in the morning sun", "en", "b", 1),
        (3, "12345 !!!", "en", "a", 1),
        (4, None, None, None, None),
        (5, "Call +1 (017) 555-7713 or write to me.you@mail1.example.com about the house with the garden", "en", "a", 1),
        (6, "Der schnelle braune Fuchs springt über den faulen Hund am Ufer des Flusses in der Sonne", "de", "c", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.language(spark, docs, "")
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 5, 6} and kept.columns == docs.columns
    once = cp.near_duplicates(spark, kept, "")
    assert {r["doc_id"] for r in once.collect()} == {1, 5, 6} and once.columns == docs.columns
    safe = cp.personal_data(spark, once, "")
    assert safe.columns == docs.columns
    text = {r["doc_id"]: r["text"] for r in safe.collect()}
    assert text[1] == rows[0][1] and "555-7713" not in text[5] and "me.you" not in text[5]
    mixed = cp.mixture(spark, safe, "")
    assert mixed.groupBy("doc_id").agg(F.sum("mix_words").alias("n")).count() == 3


def test_near_duplicates_with_null_and_repeated_ids(spark):
    near = " ".join(f"n{k}" for k in range(150))
    nulls, clean, other = (" ".join(f"{c}{k}" for k in range(60)) for c in "abc")
    rows = [
        (1, near, "a"),
        (None, near + " end", "a"),  # near-copy of a row with an id: goes
        (None, clean, "a"),  # clean, with a null id: stays
        (None, nulls, "a"),
        (None, nulls, "b"),  # null-id copies of each other: one stays
        (7, near + " tail", "a"),  # a repeated id whose other text is clean
        (7, other, "a"),
        (8, "one two three four five six", "a"),
        (8, "one two three four five six", "a"),  # a repeated row
        (9, "one two three four five six", "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = cp.near_duplicates(spark, docs, "")
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == docs.columns and len(got) == 5
    assert set(got) == {(1, near), (None, clean), (None, nulls), (7, other), (8, "one two three four five six")}


CLASHING = ["score", "lang_pred", "_id", "_th", "_gone", "id", "th", "first", "n", "node", "component", "_n_entities", "kind", "key", "size", "idx", "block", "a.b"]
LONG = "der die das und ein langer Text von Haus und Hof " * 20_000


def _odd(spark):
    leak = "the cat sat on the mat and the dog ran far from the house today with friends"
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank in the morning sun", "en", "a"),
        (1, "The quick brown fox jumps over the lazy dog near the river bank in the morning sun", "en", "a"),  # a repeated row
        (1, "Another text under the same number that has nothing to do with any fox or dog", "en", "b"),
        (None, "A text without a number that nobody else in this little table has written", "en", None),
        (None, "A second text without a number, which is quite unlike the first one here", "en", None),
        (None, "A second text without a number, which is quite unlike the first one here", "en", None),
        (2, None, None, None),
        (3, "", "en", "a"),
        (4, "12345 !!!", "en", "a"),
        (5, LONG, "de", "hot"),
        (6, "Call +1 (017) 555-7713 or write to me.you@mail1.example.com about the house with the garden", "en", "a"),
        (7, leak, "en", "a"),
        (None, leak + " again", "en", "a"),
    ]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(f"kept {c}") for c in CLASHING}).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))


def test_stages_on_odd_rows_and_clashing_columns(spark, tmp_path):
    docs = _odd(spark)
    bench = "the cat sat on the mat and the dog ran far from the house today with friends"
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    counts = {}
    for name, stage in cp.STAGES:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0
        out = stage(spark, docs, f"file://{tmp_path}")
        rows = out.collect()
        counts[name] = len(rows)
        if name != "mixture":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert all(r[c] == f"kept {c}" for r in rows for c in CLASHING)
        if name == "near_duplicates":
            kept = sorted((r["doc_id"] or 0, (r["text"] or "")[:9]) for r in rows)
            assert kept == [(0, "A second "), (0, "A text wi"), (1, "Another t"), (1, "The quick"), (2, ""), (4, "12345 !!!"), (5, "der die d"), (6, "Call +1 ("), (7, "the cat s")]
        if name == "personal_data":
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
        if name == "mixture":
            assert out.columns == [*docs.columns, "mix_shard", "mix_epoch", "mix_words", "mix_key"]
    assert counts["language"] == 10 and counts["benchmark_leaks"] == 11 and counts["personal_data"] == 13


def test_run_on_tables(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100
    assert set(out.columns) >= {"doc_id", "text", "lang", "source", "n_chars", "mix_shard", "mix_epoch", "mix_words"}
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    from chronolith.llm.decontaminate import contaminated

    assert contaminated(out.select("doc_id", "text"), bench).count() == 0


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from chronolith.llm.common import shared_folder

    def session(master, there):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: there))

    assert shared_folder(session("spark://host:7077", "hdfs:///x")) == "hdfs:///x"
    assert shared_folder(session("local[4]", None))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            shared_folder(session(master, None))


def test_batches_of_texts_are_small_and_hold_a_text_once(spark):
    """A task's texts as one batch, and twice in the first stage, took an executor over 3000 MB."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    text = F.concat(F.lit("Write to "), F.col("id").cast("string"), F.lit("@example.org. "), F.expr("repeat('the cat sat on the mat ', 250)"))
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"))
    mine = spark.conf.get(setting, None)
    try:
        for stage in (cp.language, cp.near_duplicates, cp.personal_data):
            spark.conf.unset(setting)
            out = stage(spark, docs, "")
            seen = docs.mapInArrow(sizes, "rows long, bytes long").collect()
            assert sum(r["rows"] for r in seen) == 3000 and max(r["bytes"] for r in seen) < 5 << 20, stage
            if stage is not cp.near_duplicates:
                assert out.count() == 3000
            if stage is cp.language:
                sent = spark.range(1).select(F.lit("x").alias("text"), F.lit(1).alias("doc_id"))
                model = LanguageModel(["en"], np.zeros((BUCKETS + 1, 1), np.float32))
                kept = score_languages(sent, model, keep=("text",))
                assert "_text" not in kept._jdf.queryExecution().optimizedPlan().toString()
                assert [tuple(r) for r in kept.collect()] == [tuple(r) for r in score_languages(sent.select("doc_id", F.col("text").cast("binary").alias("text")), model).select("doc_id", F.lit("x"), "lang_pred", "score").collect()]
        spark.conf.set(setting, "8m")
        cp.personal_data(spark, docs.limit(10), "")
        assert spark.conf.get(setting) == "8m"
    finally:
        spark.conf.unset(setting) if mine is None else spark.conf.set(setting, mine)

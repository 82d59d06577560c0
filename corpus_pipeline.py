"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage works on all rows that its predecessor kept. The first four return the columns of documents; the last returns the mix,
a row for each time a document is taken, with the columns of documents and where it goes.

In every stage columns beyond doc_id, text, lang, source and n_chars are kept as they are, whatever their names, but for those that the
last one adds; an empty table gives an empty one; long texts are read whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import numbered, shared_folder
from chronolith.llm.decontaminate import decontaminate
from chronolith.llm.langid import UNKNOWN, fit_languages, score_languages
from chronolith.llm.mixing import mixed_rows
from chronolith.llm.neardup import without_near_duplicates
from chronolith.llm.pii import configured_key, replace_entities

#: A document whose best language is less likely than this is rejected, as is one without a letter.
LEAST_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the labelled rows teach.

    Null and empty texts and texts without a letter go. Null ids and repeated rows are judged like any other, by their texts alone."""
    plain, names = numbered(docs)
    model = fit_languages(plain, text_col=names["text"], lang_col=names["lang"], id_col=names["doc_id"])
    scored = score_languages(plain, model, id_col=names["doc_id"], text_col=names["text"], keep=tuple(plain.columns))
    kept = scored.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*plain.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates: SimHash balls over sets of five-word shingles, 0.8 alike.

    Rows are known by id and text. The smallest id stays, null only where the group has no other, then the smallest hash of the text;
    of rows that agree in both, the one with the smallest hash of all columns. Null and empty texts are copies of one another."""
    return without_near_duplicates(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark.

    Null and empty texts hold none and stay. Rows with null or repeated ids are judged by their own text, repeated rows alike."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and secrets by surrogates; n_chars follows the text. All rows stay.

    The key is the session's spark.chronolith.pii.key, else a new one each run. Null and empty texts stay as they are; null and repeated
    ids don't matter; equal texts change alike."""
    plain, names = numbered(docs)
    out = replace_entities(plain, key=configured_key(spark), text_col=names["text"]).select(*plain.columns)
    if "n_chars" in names:
        out = out.withColumn(names["n_chars"], F.length(names["text"]).cast(docs.schema["n_chars"].dataType))
    return out.toDF(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights, each shard in one partition and shuffled there.

    Null and empty texts are never taken. The null source counts as the last. Null and repeated ids are dealt by their texts, and each of
    several equal rows counts. mix_shard, mix_epoch, mix_words and mix_key are added, in place of columns of these names."""
    return mixed_rows(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each one's result is a table in the shared folder of spark.checkpoint.dir."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs


#: SQL expresses neither the classifier nor XXH64, so the stages are tested against brute force.
ORACLE_SQL = None

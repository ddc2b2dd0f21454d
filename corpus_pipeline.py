"""From raw documents to packed token sequences.

Each stage works on all rows that the stage before has kept. Its result is written as
Parquet to the session's shared folder and read again, which also cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import decontamination, language, packing, sentence_spans, simhash
from lodeworks.llm.common import drop_stored, read, stored_alone, unused
from lodeworks.llm.queries import tokenizer_path, training_rows


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows.

    Those without a letter go, and those of whose n-grams the model knows less than half as large a share as of
    any text it has learnt from. Columns keep their values, whatever their names.
    """
    model = language.fit(docs, training_rows(), per_language=1000, landmarks=64)
    names = tuple(unused(docs, "lang_pred", "score", "known"))
    known = (F.col(names[0]) != "und") & (F.col(names[2]) >= model.floor)
    return language.predicted(docs, model, names=names).where(known).drop(*names)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that of the smallest id."""
    return simhash.deduplicated(docs, radius=4, shingle=4)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without sentences of repeated spans."""
    cut = sentence_spans.dedup(docs, min_words=30)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*[f"`{c}`" for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    (at,) = unused(docs, "leaking")
    found = decontamination.leaks(docs, read(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(at)).distinct()
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(at)), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: Kernels, fingerprints and byte-pair tokens have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        drop_stored(before)
    return STAGES[-1][1](spark, docs, sf_dir)

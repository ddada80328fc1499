"""A corpus pipeline of five stages, each one operator over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adlayer.llm import decontaminate, langid, mixing, pii, simhash
from adlayer.llm.common import stage, text_key

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null texts, those without letters, those that no language fits better than others."""
    return langid.keep_identified(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that SimHash links (generalised pigeonhole join) at a similarity of 0.8 or more over five-word shingles, in any number of steps, the first stays."""
    return simhash.keep_first(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities get surrogates; n_chars follows the new text, null for a null one."""
    return pii.pseudonymise(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: the columns of documents, and copy (from 1).

    Rows of one id, source and text share what the mix takes of them evenly.
    """
    names = [c for c in docs.columns if c != "copy"]
    taken = mixing.mix(docs).groupBy("doc_id", "source", "text_key").agg(F.sum("repeats").alias("_al_total"), F.count("*").alias("_al_rows")).where("_al_total > 0")
    taken = taken.withColumnsRenamed({"doc_id": "_al_id", "source": "_al_source", "text_key": "_al_key"})
    same = docs["doc_id"].eqNullSafe(F.col("_al_id")) & docs["source"].eqNullSafe(F.col("_al_source")) & (text_key(docs["text"]) == F.col("_al_key"))
    rows = docs.join(taken, same)
    alike = Window.partitionBy("_al_id", "_al_source", "_al_key").orderBy("lang", "n_chars")
    several = rows.where("_al_rows > 1").withColumn("_al_times", F.floor(F.col("_al_total") / F.col("_al_rows")) + (F.row_number().over(alike) <= F.col("_al_total") % F.col("_al_rows")).cast("int"))
    each = rows.where("_al_rows = 1").withColumn("_al_times", F.col("_al_total")).unionByName(several).where("_al_times > 0")
    return each.select(*names, F.explode(F.sequence(F.lit(1), F.col("_al_times").cast("int"))).alias("copy"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_copies),
    ("pii", replace_personal_data),
    ("mix", mix_sources),
]

#: Language models, similarities and alignments aren't in SQL; tests/llm/test_pipeline.py holds each stage against plain code.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs

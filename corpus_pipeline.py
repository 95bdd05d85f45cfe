"""The corpus pipeline: stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.llm import queries
from spectrail.llm.bpe import bpe
from spectrail.llm.decontamination import contained_items
from spectrail.llm.line_dedup import line_dedup
from spectrail.llm.ngram_join import ngram_components
from spectrail.llm.quality_classifier import quality_classifier
from spectrail.llm.tables import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality_classifier(docs).where("kept").select(*COLUMNS)


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates but each template's first, so that copied texts aren't lost; one that loses every line goes."""
    left = line_dedup(docs, keep_first=True).where("n_dropped = 0 or trim(text) <> ''")
    return left.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group that links of 5-word shingles, 80 % Jaccard, connect; documents without words all stay."""
    found = ngram_components(docs, n=5, percent=80).where("component_id < doc_id").select(F.col("doc_id").alias("_copy"))
    return docs.join(found, docs.doc_id == found._copy, "left_anti").select(*COLUMNS)


def without_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contained_items(docs, items).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(found, docs.doc_id == found._leak, "left_anti").select(*COLUMNS)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of them and of the text they decode to."""
    coded = bpe(docs, queries.TOKENIZER)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", without_recurring_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark_items),
    ("bpe", as_tokens),
]

#: The first and the last stage have no form in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs

"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe
from .decontamination import contained_items
from .html_extraction import extract
from .language_id import language_id
from .lexical_search import lexical_search
from .line_dedup import line_dedup
from .merkle_manifest import merkle_manifest
from .ngram_join import ngram_components
from .quality_classifier import quality_classifier
from .quality_rules import quality_rules
from .secret_scan import secret_scan
from .substring_dedup import substring_dedup
from .toxicity import toxicity

try:
    import public_tokenizers

    #: The vocabulary of the registered query; operators take a path.
    TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
except ImportError:  # the files lie in the folder that the package links to
    TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _listed(spans) -> object:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(_table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "novel")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe(_table(spark, sf_dir, "documents"), TOKENIZER)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(_table(spark, sf_dir, "documents")).select("doc_id", "quality_score", "kept")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(_table(spark, sf_dir, "documents"), window=20)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), most=50)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle_manifest(_table(spark, sf_dir, "documents"), now={"text": tampered})


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_decontamination, op3_secret_scan, op4_html_extraction, op5_bpe, op6_quality_classifier, op7_ngram_join, op8_toxicity, op9_substring_dedup, op10_line_dedup,
        op11_lexical_search, op12_merkle_manifest, op13_language_id,
    )
}

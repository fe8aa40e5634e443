"""The registered queries of this subpackage and, where SQL can express them, the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, exact_dedup, hard_negatives, html_text, licenses, line_dedup, mixing, ngram_join, suffix_dedup
from . import quality as quality_trees
from . import toxicity as toxic_ngrams
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxic_ngrams.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(*toxic_ngrams.verdict("toxicity", toxic_ngrams.TOXIC))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "pages"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_trees.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(*toxic_ngrams.verdict("quality_score", quality_trees.GOOD))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer).select("doc_id", "tokens.*")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_mix_sources": op2_mix_sources,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_html_text": op4_html_text,
    "op5_toxicity": op5_toxicity,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality": op9_quality,
    "op10_ngram_join": op10_ngram_join,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_collocations": op12_collocations,
    "op13_bpe": op13_bpe,
}

ORACLES: dict[str, str] = {
    "op1_license_scan": licenses.ORACLE,
    "op2_mix_sources": mixing.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op12_collocations": collocations.ORACLE,
}

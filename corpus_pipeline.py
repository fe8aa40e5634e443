"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's documents.

Every stage works on all rows that its predecessor kept. The first four return the columns of documents and drop whole rows: texts
that the toxicity classifier rejects, all but the largest doc_id of equal texts, all but one row, with the smallest doc_id, of each component of
near copies, and texts that hold a benchmark window. The last one returns how much of each remaining document the mix takes.

ORACLE_SQL is None: a fitted classifier, and components over links between all pairs, are not expressible in SQL; the tests hold
each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markerflow.llm import decontaminate, exact_dedup, mixing, ngram_join, toxicity
from markerflow.llm.common import stage, table


def unused(docs: DataFrame, name: str) -> str:
    """The name, lengthened until no column of docs has it."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored below the classifier's threshold stay, repeated ones too; a null or empty text scores as the intercept alone, a null id changes nothing. Where no
    text to learn from is marked toxic, no row goes; where all are, every row does."""
    score = unused(docs, "toxicity")
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), column=score)
    return scored.where(F.col(score) < toxicity.TOXIC).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by id and a hash of the text, as ids may repeat or be null. Of rows that repeat both id and text one stays;
    they meet where the join has brought their id."""
    kept_id, kept_text, text_hash = unused(docs, "kept_id"), unused(docs, "kept_text"), F.xxhash64("text")
    keyed = docs.select("doc_id", "text", text_hash.alias(kept_text))
    kept = exact_dedup.exact_dedup(keyed, carry=[kept_text]).where("kept").select(F.col("doc_id").alias(kept_id), kept_text).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (text_hash == F.col(kept_text)), "left_semi").dropDuplicates(["doc_id", "text"])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: that with the smallest id (null is above all others), of those the one with the smallest
    hash of the text, and one of rows that repeat both. Rows without words stay."""
    gone_id, gone_text, text_hash = unused(docs, "gone_id"), unused(docs, "gone_text"), F.xxhash64("text")
    joined = stage(ngram_join.ngram_join(docs.select("doc_id", "text", text_hash.alias(gone_text)), tie=gone_text), "pipeline-near")
    row = (F.col("doc_id").alias(gone_id), gone_text)
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (text_hash == F.col(gone_text))
    gone = joined.where("NOT stays").select(*row)
    again = joined.where("stays AND n_shingles > 0").select(*row).groupBy(gone_id, gone_text).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if again.isEmpty():
        return docs.join(gone, same, "left_anti")
    return docs.join(gone.union(again), same, "left_anti").unionByName(docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no window of a benchmark item stay, repeated ones too; a null or empty text holds none, an empty benchmark takes nothing."""
    leaks = unused(docs, "leaks")
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), leaks)
    return found.where(F.col(leaks)["n_hit"] == 0).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, with what the mix takes of it (0 or more words); null sources are one source, a null text has no words."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus pipeline: toxic documents go, repeated lines go, one document of each group of near copies stays, documents with
benchmark passages go, and the rest is mixed to the sources' target weights.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept and returns a DataFrame with the columns of
``documents``; the last adds ``copies``, how often the mix takes a document (documents that it doesn't take are left out). Nulls, empty
texts, repeated rows and further columns are treated as each operator's module says; a document that had lines and loses all of
them to the line stage goes, one without any line with a word stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelattice.llm import decontaminate, line_dedup, mixture, toxicity, trie_join
from pricelattice.llm.common import stored, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = line_dedup.dedup(docs)
    kept = judged.filter("n_lines_with_words = 0 or n_lines_removed < n_lines_with_words")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_lines_removed") > 0, F.char_length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return kept.select(docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return trie_join.representatives(docs, n=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # an id may have rows of several sizes and sources, each with copies of its own
    plan = stored(mixture.decided(docs).filter("copies > 0").select("sid", F.col("doc_id").alias("of"), "size", "copies").distinct(), "copies")
    same = (mixture.sid() == plan["sid"]) & docs["doc_id"].eqNullSafe(plan["of"]) & (mixture.size() == plan["size"])
    return docs.join(plan, same).select(*(docs[c] for c in docs.columns), plan["copies"])


STAGES = [
    ("toxicity", without_toxic), ("line_dedup", without_repeated_lines), ("ngram_jaccard", without_near_copies),
    ("decontamination", without_benchmark), ("mixture", mixed),
]
#: The first stage learns its scores, which SQL can't express; the tests check each stage against its definition.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Registered queries of this folder; each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, chat, decision_list, decontaminate, divergence, html_paths, line_dedup, mixture, repair, secrets, sql,
               sql_divergence, sql_repair, token_counts, toxicity, trie_join)
from .common import stored, table

TOKENIZER = "word_bpe_49k.json"


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.removed_lines(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"), F.array_join("removed", ",").alias("removed"))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


def op3_html_paths(spark: SparkSession, folder: str) -> DataFrame:
    return html_paths.extract(table(spark, folder, "pages"))


def op4_decision_list(spark: SparkSession, folder: str) -> DataFrame:
    judged, _ = decision_list.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = F.col("findings")
    count = [secrets.count(found, kind).alias(f"n_{kind}") for kind in secrets.BASE]
    return secrets.findings(table(spark, folder, "documents")).select(
        "doc_id", *count, F.sha2(secrets.spans(found, secrets.BASE), 256).alias("base_sha256"), secrets.spans(found).alias("spans"))


def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    return chat.digests(chat.render(given.unionByName(spark.createDataFrame(tricky, given.schema))))


def op9_trie_join(spark: SparkSession, folder: str) -> DataFrame:
    return trie_join.similar(table(spark, folder, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op10_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mix(table(spark, folder, "documents")).drop("copies")


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


def op12_structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    given = table(spark, folder, "conversations")
    rows = repair.damaged(given)
    found = stored(repair.audits(rows), "audits")
    seals = repair.sealed(repair.repaired(rows, found)).withColumnRenamed("conv_id", "of")
    return found.join(seals, found["conv_id"].eqNullSafe(seals["of"]), "left").select(
        *found.columns, F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    path = public_tokenizers.path(TOKENIZER)
    coded = bpe.decode(bpe.encode(table(spark, folder, "documents"), path), path)
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_token_counts, op3_html_paths, op4_decision_list, op5_decontamination, op6_toxicity, op7_secrets, op8_chat, op9_trie_join, op10_mixture, op11_source_divergence, op12_structure_repair, op13_bpe)
}
ORACLES: dict[str, str] = {"op7_secrets": sql.secrets(), "op8_chat": sql.chat(), "op10_mixture": sql.MIXTURE,
                          "op11_source_divergence": sql_divergence.DIVERGENCE, "op12_structure_repair": sql_repair.repair()}

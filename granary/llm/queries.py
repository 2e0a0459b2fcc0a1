"""The queries over whole tables that the operators answer, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, digest_index, language, line_dedup, lpf_dedup, packing, pii, secret_scan, simhash, simhash_sql, toxicity
from .common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpf_dedup.removed(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identified(table(spark, sf_dir, "pages"), docs, also=docs)
    return found.withColumns({c: F.round(c, 6) for c in ("confidence", "text_p")})


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_index.DigestIndex(spark).add(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.applied(table(spark, sf_dir, "documents")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.BlobLedger(spark).scan(table(spark, sf_dir, "documents")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", "containment")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.trained(docs, table(spark, sf_dir, "labels"))).drop("h")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_simhash, op3_language, op4_exact_dedup, op5_line_dedup, op6_packing, op7_secrets, op8_decontamination, op9_pii, op10_toxicity)
}

SQL: dict[str, str] = {
    "op1_suffix_dedup": lpf_dedup.SQL, "op2_simhash": simhash_sql.SQL, "op3_language": language.SQL, "op4_exact_dedup": digest_index.SQL, "op5_line_dedup": line_dedup.SQL,
    "op7_secrets": secret_scan.SQL, "op8_decontamination": decontam.SQL, "op9_pii": pii.SQL,
}

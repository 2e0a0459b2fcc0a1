"""A corpus from raw documents to packed sequences, in stages that are each written and read again.

Stages take (spark, docs, sf_dir) and return a DataFrame. All but the last return the columns of
documents, in their order, whatever others the input may have. Documents are never changed
but by line dedup, which also counts n_chars anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import common, decontam, line_dedup, packing, simhash, toxicity

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _rows(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the keys of the operators under names of their own."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NULL_ID)).alias("key_did"), F.xxhash64(text).alias("key_h")
    return docs.select(*(F.col(c).cast(t).alias(c) for c, t in COLUMNS.items()), *keys)


def _without(rows: DataFrame, bad: DataFrame) -> DataFrame:
    """rows but for those whose (did, h) bad holds."""
    return rows.join(bad, [rows["key_did"] == bad["did"], rows["key_h"] == bad["h"]], "left_anti").select(*COLUMNS)


def _keys(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce("doc_id", F.lit(common.NULL_ID)).alias("did"), "h").distinct()


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic go. It learns from the raw documents that have labels."""
    model = toxicity.trained(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    rows = docs.select(*(F.col(c).cast(t).alias(c) for c, t in COLUMNS.items()), F.col("text").isNull().alias("none"))
    kept = toxicity.scored(rows, model, carry=("lang", "source", "n_chars", "none")).where("predicted = 0")
    text = F.when(~F.col("x_none"), F.col("text")).alias("text")
    return kept.select("doc_id", text, F.col("x_lang").alias("lang"), F.col("x_source").alias("source"), F.col("x_n_chars").alias("n_chars"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go; every document stays, if with an empty text."""
    rows = docs.select(*(F.col(c).cast(t).alias(c) for c, t in COLUMNS.items()), F.col("text").isNull().alias("none"))
    out = line_dedup.applied(rows, carry=("lang", "source", "n_chars", "none"))
    fewer, text = F.col("n_dropped") > 0, F.col("kept").cast("string")
    return out.select(
        common.doc_id(), F.when(fewer | ~F.col("x_none"), text).alias("text"), F.col("x_lang").alias("lang"), F.col("x_source").alias("source"),
        F.when(fewer, F.length(text).cast("long")).otherwise(F.col("x_n_chars")).alias("n_chars"),
    )


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 of their five-word shingles the smallest doc_id stays (a null is the smallest), of
    its texts the one with the least hash, and of rows that repeat both one. Unlike documents stay whatever their ids."""
    found = common.settle(simhash.near_duplicates(docs, size=5, least=0.8), "found")
    best = common.settle(found.groupBy("root").agg(F.min(F.struct("did", "h")).alias("best")), "best")
    ranked = found.join(best, "root").select("did", "h", (F.struct("did", "h") == F.col("best")).alias("stays"))
    bad = common.settle(ranked.where("not stays").select("did", "h").distinct(), "near")
    again = common.settle(ranked.where("stays").groupBy("did", "h").count().where("count > 1").select("did", "h"), "again")
    left = _without(_rows(docs), bad)
    if again.isEmpty():
        return left
    rows = _rows(left)
    on = [rows["key_did"] == again["did"], rows["key_h"] == again["h"]]
    once = rows.join(again, on, "left_semi").dropDuplicates(["key_did", "key_h"])
    return rows.join(again, on, "left_anti").select(*COLUMNS).unionByName(once.select(*COLUMNS))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    found = decontam.contained(docs, common.table(spark, sf_dir, "benchmark"))
    return _without(_rows(docs), common.settle(_keys(found), "leaks"))


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # executors have grown by now: less memory for words, in smaller steps
    return packing.packed(docs, memory=48 << 20, step=1 << 21)


STAGES = [("toxicity", toxic), ("line dedup", lines), ("near-dedup", near), ("decontamination", clean), ("packing", packs)]

ORACLE_SQL = None  # neither the network nor the tokenizer can be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.settle(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

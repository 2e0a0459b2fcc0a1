"""Exact dedup against a persistent index of text digests.

The index is a table bucketed and sorted by digest. New rows are digested,
grouped among themselves, sort-merge anti-joined against the index and what is
new is appended. Only digests and ids are shuffled, never texts; groups of copies
are pre-aggregated before the shuffle, and the join that hands the group's fate
back to each row is one that Spark can split where a digest is hot.

Null text counts as empty. A null id counts as the smallest id; where all ids of
a group are null, ``keep_id`` is null. Rows repeating both id and text share one
fate. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


class DigestIndex:
    """``add(docs)`` returns the fate of each row and appends what is new to the index.

    Within a batch the largest doc_id stays; a text that the index already holds
    keeps the row of the earlier batch, and none of the new rows. A batch counts once it is committed; with a
    name, it may be added again, after a failure or in doubt, with the same result. How many buckets there are
    is kept with the index, whatever the session that opens it later.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, (path or common.scratch(spark, "digests")).rstrip("/")
        self.commits = common.Commits(spark, self.path)
        self.buckets = int(self.commits.note("buckets", str(buckets or common.width(spark))))

    def _append(self, entries: DataFrame) -> None:
        name = f"granary_digests_{uuid.uuid4().hex}"
        sized = entries.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        self._named(name)
        sized.write.mode("append").option("path", f"{self.path}/entries").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")

    def _named(self, name: str) -> None:
        self.spark.sql(f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, attempt STRING) USING parquet OPTIONS (path '{self.path}/entries') CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS")

    def entries(self, but: str = "") -> DataFrame:
        """digest, keep_id of the committed batches, but for one."""
        name = f"granary_digests_{uuid.uuid4().hex}"
        self._named(name)
        rows = common.resolved(self.spark, name)
        done = [attempt for batch, attempt in self.commits.done().items() if batch != but]  # a name for each batch
        return rows.where(F.col("attempt").isin(done)).select("digest", "keep_id")

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """doc_id, keep_id, group_size (in this batch), kept, text_sha256 of every row."""
        batch, attempt = batch or uuid.uuid4().hex, uuid.uuid4().hex
        rows = common.keyed(docs).select("did", F.unhex(F.sha2("text", 256)).alias("digest"))
        rows = common.settle(rows, "digested")
        # settled, or Spark would anti-join the rows and only then group them
        groups = common.settle(rows.groupBy("digest").agg(F.max("did").alias("newest"), F.count("*").alias("group_size")), "groups")
        known = self.entries(but=batch)
        fresh = groups.join(known.hint("merge"), "digest", "left_anti")
        added = common.settle(fresh.select("digest", F.col("newest").alias("keep_id")), "fresh")
        before = known.join(groups.hint("merge"), "digest", "left_semi").select("digest", "keep_id")
        before = common.settle(before, "known")
        if batch not in self.commits.done():
            self._append(added.withColumn("attempt", F.lit(attempt)))
            self.commits.commit(batch, attempt)
        fate = groups.join(before.unionByName(added), "digest")
        fate = fate.join(added.select(F.col("digest"), F.lit(True).alias("new")), "digest", "left")
        out = rows.join(common.settle(fate, "fate"), "digest")
        return out.select(
            common.doc_id(), F.nullif("keep_id", F.lit(common.NULL_ID)).alias("keep_id"), "group_size",
            (F.coalesce("new", F.lit(False)) & (F.col("did") == F.col("keep_id"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by size (number of distinct five-word shingles, by powers
of two). An item's sketch is its smallest shingle hashes, as many as its partition
needs: a document that contains 0.8 of an item misses at most a fifth of its shingles, so among one more
than a fifth of the largest size in the partition at least one is in the document,
and a document with too few shingles for a partition does not probe it.
Candidates are verified by exact shingle containment, on the words themselves. The search
thus loses nothing.

Items are taken in blocks of a bounded size; each block's sketch goes to the executors
and every whole document is searched where it is read. Nothing is shuffled. Words are
`[^\\x20\\x09-\\x0D]+` with A-Z in lower case. An item of fewer words than five is one shingle, all its words, and
is searched among the shingles of as many words of every document; a text without words contains nothing and is
contained nowhere. Null ids stay null; rows are never merged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SIZE, LEAST = 5, 0.8
BLOCK_BYTES = 8 << 20
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingled(words: list[bytes], size: int = SIZE) -> tuple[np.ndarray, int]:
    """The hashes of the shingles in order, and the words of each."""
    from xxhash import xxh64_intdigest

    n = min(size, len(words))
    if not n:
        return np.zeros(0, np.uint64), 0
    w = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * STEP + w[k : k + len(out)]
    out ^= out >> np.uint64(31)
    return out * STEP, n


class Items:
    """A block of items: their shingles, sketches by size partition, and a search."""

    def __init__(self, items: list[tuple[int | None, bytes]], least: float = LEAST):
        self.least, self.ids = least, [i for i, _ in items]
        self.shingles: list[dict[bytes, None]] = []
        probe, widths = [], {SIZE}
        for k, (_, text) in enumerate(items):
            words = text.lower().split()
            hashes, n = shingled(words)
            widths |= {n} - {0}
            self.shingles.append(dict.fromkeys(b" ".join(words[j : j + n]) for j in range(len(hashes))))
            each = np.unique(hashes)
            if len(each):
                part = max(1, len(each) - 1).bit_length()  # sizes up to 2 ** part
                sketch = each[: int((1 - least) * (1 << part) + 1e-9) + 1]
                probe += [(int(x), k) for x in sketch]
        self.widths = sorted(widths)
        probe.sort()
        self.keys = np.array([x for x, _ in probe], np.uint64)
        self.of = np.array([k for _, k in probe], np.int64)
        self.mask = np.zeros(1 << 16, bool)
        self.mask[(self.keys >> np.uint64(48)).astype(np.int64)] = True
        self.need = np.array([max(1, int(np.ceil(least * len(s) - 1e-9))) for s in self.shingles], np.int64)

    def search(self, text: bytes) -> list[tuple[int, int]]:
        """(item's place, shingles shared) of the items that a document contains."""
        words = text.lower().split()
        found, held = set(), set()
        for n in self.widths:
            if len(words) < n:
                break
            hashes, _ = shingled(words, n)
            near = hashes[self.mask[(hashes >> np.uint64(48)).astype(np.int64)]]
            if not len(near):
                continue
            near = np.unique(near)
            i, j = np.searchsorted(self.keys, near, "left"), np.searchsorted(self.keys, near, "right")
            some = {int(k) for a, b in zip(i[i < j], j[i < j], strict=True) for k in self.of[a:b] if self.need[k] <= len(hashes)}
            if some:
                found |= some
                held |= {b" ".join(words[p : p + n]) for p in range(len(hashes))}
        counts = [(k, sum(s in held for s in self.shingles[k])) for k in sorted(found)]
        return [(k, c) for k, c in counts if c >= self.need[k]]


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks of about so many bytes; only one is held at once."""
    held, size = [], 0
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    for i, t in items.toLocalIterator():
        held.append((i, bytes(t)))
        size += len(t) + 64
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def contained(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, h, item_id, n_shingles, n_shared, containment of each document and item that it contains."""
    schema = "doc_id long, h long, item_id long, n_shingles long, n_shared long"
    rows = common.keyed(docs).select(common.doc_id(), "h", "text")
    out = rows.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark):
        sent = rows.sparkSession.sparkContext.broadcast(block)  # bounded by BLOCK_BYTES

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value, least)
            for b in batches:
                hits = [(r, k, c) for r, t in enumerate(common.raw(b)) for k, c in items.search(t)]
                at = pa.array([r for r, _, _ in hits], pa.int32())
                yield common.rows({"doc_id": (b.column("doc_id").take(at), None), "h": (b.column("h").take(at), None), "item_id": ([items.ids[k] for _, k, _ in hits], pa.int64()), "n_shingles": ([len(items.shingles[k]) for _, k, _ in hits], pa.int64()), "n_shared": ([c for _, _, c in hits], pa.int64())})

        out = out.unionByName(common.over(rows, work, schema))
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


SQL = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') FROM benchmark
), widths AS (
  SELECT side, id, w, least(len(w), 5) AS n FROM words WHERE side = 'b' AND len(w) > 0
  UNION ALL
  SELECT side, id, w, n FROM words JOIN (SELECT DISTINCT least(len(w), 5) AS n FROM words WHERE side = 'b' AND len(w) > 0) ON len(w) >= n WHERE side = 'd'
), shingles AS (
  SELECT DISTINCT side, id, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT side, id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM widths)
), size AS (SELECT id, count(*) AS n FROM shingles WHERE side = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, any_value(n) AS n_shingles, count(*) AS n_shared, count(*) / any_value(n) AS containment
FROM shingles b JOIN shingles d ON d.s = b.s AND d.side = 'd' AND b.side = 'b' JOIN size ON size.id = b.id
GROUP BY d.id, b.id HAVING count(*) >= ceil(0.8 * any_value(n) - 1e-9)
"""

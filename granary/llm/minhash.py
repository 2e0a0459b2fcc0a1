"""Links by shared shingles, for near-dedup of documents that differ in more than fingerprints within three bits allow.

A document is the set of its five-word shingles (words and short texts as in ``decontam``).
Documents with equal sets are one node. Candidates are linked if the sets, as 64-bit hashes, have a Jaccard
similarity of 0.8 or more. They come from two sides. Nodes whose SimHash fingerprints are within three bits meet at the
anchors of ``simhash``: that finds what differs in a word or two, about 0.98 and more. Fingerprints of sets that
share 0.8 differ in some ten of 64 bits, which no covering code reaches with a bearable number of copies; so of 160
permutations 5 make a band, and nodes that agree in one of the 32 bands are candidates too; a pair that shares 0.8 of its shingles is none
with probability (1 - 0.8 ** 5) ** 32, about 3 in a million, and one that shares more with less.

First the links of the anchors and all members of a band's bucket with two of its members are compared; where a bucket
then holds more than one component, its members are gathered with their sets, in pairs of blocks of bounded size, and all of
different components are compared by counting the shingles that they share; no pair is a row, what comes out is a forest
of the links found. So every candidate pair is compared or in one component already. Near copies that hang together
cost links in proportion to them; those that are just too unlike to be linked are still all compared. Nulls, empty and wordless texts have
the empty set, one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .decontam import shingled
from .simhash import forest, links, majority

SIZE, LEAST, BANDS, ROWS = 5, 0.8, 32, 5
CHUNK = 1 << 13  # shingles permuted at once
BLOCK, ROWS_AT_ONCE = 1 << 19, 512  # shingles of a block, and sets of it that are compared at once


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    a, b = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
    return a | np.uint64(1), b


def banded(held: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each band of a set's minima; a set without shingles has no bands."""
    if not len(held):
        return np.zeros(0, np.int64)
    least = np.full(len(a), np.iinfo(np.uint64).max)
    for k in range(0, len(held), CHUNK):
        np.minimum(least, (a[:, None] * held[None, k : k + CHUNK] + b[:, None]).min(axis=1), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for x in least.reshape(BANDS, ROWS).T:
        out = (out ^ x) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def sets(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """did, h, fp, node, n, bands, held: node names the set of shingles, held are its n hashes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        a, b = _permutations()
        for batch in batches:
            each = [shingled(t.lower().split(), size)[0] for t in common.raw(batch)]
            all_ = [np.unique(x) for x in each]
            yield common.rows({
                "did": (batch.column("did"), None),
                "h": (batch.column("h"), None),
                "fp": ([majority(x) for x in each], pa.int64()),
                "node": (pa.array(np.array([xxh64_intdigest(x.tobytes()) for x in all_], np.uint64).view(np.int64)), None),
                "n": ([len(x) for x in all_], pa.int64()),
                "bands": ([banded(x, a, b) for x in all_], pa.list_(pa.int64())),
                "held": ([x.tobytes() for x in all_], pa.binary()),
            })

    return common.over(common.keyed(docs), work, "did long, h long, fp long, node long, n long, bands array<long>, held binary")


def similar(pairs: DataFrame, held: DataFrame, least: float = LEAST) -> DataFrame:
    """u, v: of pairs u-v those whose sets have at least that Jaccard similarity."""
    left = held.select(F.col("node").alias("u"), F.col("held").alias("a"))
    right = held.select(F.col("node").alias("v"), F.col("held").alias("b"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for x, y in zip(batch.column("a"), batch.column("b"), strict=True):
                p, q = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                n = len(np.intersect1d(p, q, assume_unique=True))
                hit.append(n >= least * (len(p) + len(q) - n) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(hit, pa.bool_()))

    return common.over(both, work, "u long, v long")


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set on the left has in common with each on the right."""
    every = np.concatenate([*left, *right]) if left or right else np.zeros(0, np.uint64)
    _, at, times = np.unique(every, return_inverse=True, return_counts=True)
    cols = np.cumsum(times > 1) - 1  # what only one set has is in common with none
    width = int((times > 1).sum())
    ends = np.cumsum([0, *map(len, left), *map(len, right)])
    col, keep = cols[at], times[at] > 1
    row = np.repeat(np.arange(len(left) + len(right)), np.diff(ends))
    row, col = row[keep], col[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, width, CHUNK):
        i, j = np.searchsorted(col, (lo, lo + CHUNK))
        held = np.zeros((len(left) + len(right), min(CHUNK, width - lo)), np.float32)
        held[row[i:j], col[i:j] - lo] = 1
        out += held[: len(left)] @ held[len(left) :].T
    return out


def block_links(node: np.ndarray, root: np.ndarray, side: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between nodes of different components: within the one side, or from side to side."""
    n, found = np.array([len(x) for x in sets]), []
    first, second = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
    one = first[0] == second[0]
    for i in range(0, len(first), ROWS_AT_ONCE):
        a = first[i : i + ROWS_AT_ONCE]
        for j in range(i if one else 0, len(second), ROWS_AT_ONCE):
            b = second[j : j + ROWS_AT_ONCE]
            same = shared([sets[k] for k in a], [sets[k] for k in b])
            hit = (same >= least * (n[a][:, None] + n[b] - same) - 1e-4) & (root[a][:, None] != root[b])
            x, y = np.nonzero(hit)
            if len(x):
                found.append((node[a[x]], node[b[y]]))
    return forest(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def compared(left: DataFrame, held: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """u, v: a forest of the links between members (bucket, node, n, root) of different components in each bucket."""
    size = common.settle(left.groupBy("bucket").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks")), "blocks")
    dealt = left.join(size, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = dealt.select("bucket", "node", "root", "own", other).select("bucket", "node", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    parts = common.width(left.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        last = None

        def out() -> pa.RecordBatch:
            node, root, side = (np.array(x, np.int64) for x in list(zip(*rows, strict=True))[:3])
            u, v = block_links(node, root, side, [np.frombuffer(x[3], np.uint64) for x in rows], least)
            return common.rows({"u": (pa.array(u), None), "v": (pa.array(v), None)})

        for batch in batches:
            for bucket, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j", "node", "root", "own", "held")), strict=True):
                if last not in (None, (bucket, i, j)):
                    yield out()
                    rows.clear()
                last = (bucket, i, j)
                rows.append(tuple(row))
        if rows:
            yield out()

    given = dealt.join(held, "node").select("bucket", "i", "j", "node", "root", "own", "held")
    return common.over(given.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j"), work, "u long, v long")


def _pairs(a: F.Column, b: F.Column) -> list[F.Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def near(nodes: DataFrame) -> DataFrame:
    """u, v: pairs of nodes that hold together those whose fingerprints are within three bits."""
    hubs = common.settle(nodes.groupBy("fp").agg(F.min("node").alias("hub")), "hubs")
    same = nodes.join(hubs, "fp").where("node <> hub").select(*_pairs(F.col("node"), F.col("hub")))
    tree = common.settle(links(hubs.select("fp")), "tree")
    ends = tree.join(hubs.select(F.col("fp").alias("u"), F.col("hub").alias("a")), "u").join(hubs.select(F.col("fp").alias("v"), F.col("hub").alias("b")), "v")
    return same.unionByName(ends.select(*_pairs(F.col("a"), F.col("b")))).distinct()


def linked(docs: DataFrame, least: float = LEAST, size: int = SIZE) -> DataFrame:
    """did, h, fp, root of every document: those with one root are linked, by near-duplicates of near-duplicates too."""
    rows = common.settle(sets(docs, size), "sets")
    nodes = common.settle(rows.groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.min("fp").alias("fp")), "nodes")
    close = common.settle(near(nodes.select("node", "fp")), "near")
    at = common.settle(nodes.select("node", "n", F.explode("bands").alias("bucket")), "bands")
    hubs = common.settle(at.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi"), "hubs")
    members = common.settle(at.join(hubs, "bucket"), "members")
    wanted = members.select("node").unionByName(close.select(F.col("u").alias("node"))).unionByName(close.select(F.col("v").alias("node")))
    held = common.settle(rows.join(common.settle(wanted.distinct(), "wanted"), "node", "left_semi").groupBy("node").agg(F.first("held").alias("held")), "held")

    star = members.select("node", F.explode(F.array("lo", "hi")).alias("hub")).where("node <> hub").select(*_pairs(F.col("node"), F.col("hub"))).unionByName(close)
    first = common.settle(similar(common.settle(star.distinct(), "star"), held, least), "similar")
    tree = common.settle(components(first), "tree").select("node", F.col("root").alias("low"))
    placed = common.settle(members.join(tree, "node", "left").select("bucket", "node", "n", F.coalesce("low", "node").alias("root")), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("bucket")
    left = common.settle(placed.join(common.settle(mixed, "mixed"), "bucket"), "left")
    second = common.settle(compared(left, held, least), "similar")
    tree = common.settle(components(first.unionByName(second)), "tree").withColumnRenamed("root", "low")
    return rows.select("did", "h", "fp", "node").join(tree, "node", "left").select("did", "h", "fp", F.coalesce("low", "node").alias("root"))

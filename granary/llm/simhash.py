"""SimHash near-dedup by anchor points from a covering code.

Two 64-bit fingerprints that differ in at most three bits differ in at most one bit of
one of their halves. The anchors of a half are the codewords of the perfect [31,26]
code on 31 of its 32 bits, whose covering radius is 1: every fingerprint is at home at
the one anchor within that radius, and is replicated to every anchor within radius plus
threshold, that is 2 (one anchor if it is a codeword itself, else 16). A pair meets at
the home of either, where the two whole fingerprints are compared.

Only distinct fingerprints are dealt out. Anchors with many of them are dealt in blocks,
each with all that are at home there. From an anchor come no pairs but a spanning forest
of the links found, so that output is linear in what was read; connected components of the
forest are those of the links. Nulls, empty and wordless texts have fingerprint zero,
linked like any other; a null id counts as the smallest id. Rows that repeat are linked, ties of a group go to its
smallest id; long texts give one fingerprint like any others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

BITS, NEAR, SHINGLE, SEED, BLOCK = 31, 3, 3, 42, 4096


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have set."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.asarray(hashes[k : k + (1 << 16)], dtype=">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprint_of(text: bytes, size: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return majority(np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1]
    return majority(np.fromiter((xxh64_intdigest(joined[i:j], SEED) for i, j in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, len(starts)))


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """did, h, fp of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield common.rows({"did": (b.column("did"), None), "h": (b.column("h"), None), "fp": ([fingerprint_of(t, size) for t in common.raw(b)], pa.int64())})

    return common.over(common.keyed(docs), work, "did long, h long, fp long")


def _masks() -> np.ndarray:
    """By syndrome, what leads from a word to its codewords within distance 2; the first is its home."""
    out = np.zeros((BITS + 1, (BITS + 1) // 2), np.uint32)
    for s in range(1, BITS + 1):
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, BITS + 1) if i < i ^ s]
        out[s] = [1 << (s - 1), *pairs]
    return out


def _syndrome(x: np.ndarray) -> np.ndarray:
    s = np.zeros(x.shape, np.uint32)
    for j in range(5):
        mask = sum(1 << (i - 1) for i in range(1, BITS + 1) if i >> j & 1)
        s |= (np.bitwise_count(x & np.uint32(mask)).astype(np.uint32) & 1) << j
    return s


def placed(fps: DataFrame) -> DataFrame:
    """anchor, fp, home: every distinct fingerprint at each of its anchors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = _masks()
        for b in batches:
            fp = b.column("fp").to_numpy().astype(np.int64)
            for half in (0, 1):
                x = ((fp.view(np.uint64) >> np.uint64(32 * half)) & np.uint64((1 << BITS) - 1)).astype(np.uint32)
                s = _syndrome(x)
                many = s > 0
                for rows, n in ((np.flatnonzero(~many), 1), (np.flatnonzero(many), masks.shape[1])):
                    code = (x[rows, None] ^ masks[s[rows], :n]).astype(np.int64) | half << 32
                    home = np.zeros(code.shape, bool)
                    home[:, 0] = True
                    yield common.rows({"anchor": (pa.array(code.ravel()), None), "fp": (pa.array(np.repeat(fp[rows], n)), None), "home": (pa.array(home.ravel()), None)})

    return common.over(fps, work, "anchor long, fp long, home boolean")


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links u-v the nodes that are not the smallest of their component, and that smallest."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j, lab = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        low = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, lab[i], low)
        np.minimum.at(new, lab[j], low)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    leaf = np.flatnonzero(lab != np.arange(len(nodes)))
    return nodes[leaf], nodes[lab[leaf]]


def compared(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, near: int = NEAR, chunk: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Forests of the links within whole anchors, given in order of anchor; at most about chunk pairs at once."""
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
    size = np.diff(np.append(starts, len(anchor)))
    group = np.repeat(np.arange(len(starts)), size)
    at = np.flatnonzero(home & (size[group] > 1))  # each home row meets its whole anchor
    cost = np.cumsum(size[group[at]])
    u: list[np.ndarray] = []
    v: list[np.ndarray] = []
    lo = held = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + chunk, "right")))
        n = size[group[at[lo:hi]]]
        left = np.repeat(at[lo:hi], n)
        right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[group[at[lo:hi]]], n)
        a, b = fp[left], fp[right]
        hit = (np.bitwise_count((a ^ b).view(np.uint64)) <= near) & (a != b)
        if hit.any():
            x, y = forest(a[hit], b[hit])
            u.append(x)
            v.append(y)
            held += len(x)
        if held > chunk:
            yield forest(np.concatenate(u), np.concatenate(v))
            u, v, held = [], [], 0
        lo = hi
    if u:
        yield forest(np.concatenate(u), np.concatenate(v))


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """u, v: a forest with the components of all links between distinct fingerprints."""
    at = placed(fps)
    # only anchors of more than a block are joined and dealt in blocks; there are at most 1/block as many as rows
    hot = at.groupBy("anchor").count().where(F.col("count") > block).select("anchor", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    at = at.join(common.settle(hot, "hot"), "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # a row that is at home goes to all blocks, once as a member
    dealt = at.select("anchor", "fp", F.explode(F.when(F.col("home"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))).alias("block"), "home")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for u, v in compared(parts[0] * 1, parts[1], parts[2]):
                yield common.rows({"u": (pa.array(u), None), "v": (pa.array(v), None)})

        for b in batches:
            if not b.num_rows:
                continue
            now = [b.column(x).to_numpy(zero_copy_only=False) for x in ("anchor", "fp", "home", "block")]
            # blocks of an anchor are told apart as anchors of their own
            key = now[0] | (now[3].astype(np.int64) << 33)
            last = np.flatnonzero(key != key[-1])
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from out([np.concatenate(x) for x in zip(*held, [key[:cut], now[1][:cut], now[2][:cut]], strict=True)])
                held = []
            held.append([key[cut:], now[1][cut:], now[2][cut:]])
        if held:
            yield from out([np.concatenate(x) for x in zip(*held, strict=True)])

    n = common.width(fps.sparkSession)
    return common.over(dealt.repartition(n, "anchor", "block").sortWithinPartitions("anchor", "block"), work, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, least: float | None = None) -> DataFrame:
    """did, h, fp, root, component (smallest did reachable, null id as the smallest) of every document; those with one root
    are linked. Without ``least`` fingerprints within three bits are links. With it links are between documents whose
    sets of shingles of ``size`` words have at least that similarity, as ``minhash`` finds them."""
    if least is not None:
        from . import minhash

        rows = common.settle(minhash.linked(docs, least, size), "linked")
        named = rows.groupBy("root").agg(F.min("did").alias("component"))
        return rows.join(common.settle(named, "named"), "root").select("did", "h", "fp", "root", "component")
    rows = common.settle(fingerprints(docs, size), "fingerprints")
    alone = common.settle(rows.groupBy("fp").agg(F.min("did").alias("first")), "distinct")
    tree = components(links(alone.select("fp")))
    rooted = alone.join(tree, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = common.settle(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("first").alias("component"))
    return rows.join(common.settle(rooted.join(named, "root").select("fp", "root", "component"), "named"), "fp")


def digest(near: DataFrame) -> DataFrame:
    return near.select(common.doc_id(), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.nullif("component", F.lit(common.NULL_ID)).alias("component_id"))

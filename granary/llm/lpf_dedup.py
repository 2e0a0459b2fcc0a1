"""Removal of long repeats by longest-previous-factor arrays over suffix order.

Every string of ``size`` bytes has one anchor: its smallest hash of ``gram`` bytes, the
first of equals. Equal strings have equal anchors, so strings are dealt out by anchor:
consecutive starts with one anchor make a run, whose hull is all bytes of its strings. Equal
hulls are collapsed to the first of them and a count. Anchors that occur once end here.
Where several hulls share an anchor, they are gathered, put in suffix order, and previous
and next smaller (larger) positions give each start its longest earlier (later) match.

An anchor with more hulls than a block should take is split before it is gathered: equal strings
begin equally far before their anchor, so its hulls are cut into cells of neighbouring distances, and
hulls whose cells have the same bytes in common meet again, equal ones collapsed as before. Cells get
narrower until few hulls share one; one distance wide, they hold a single string. Texts are
shuffled once, compressed, and then kept in buckets. All bytes of each text take part;
matches never cross documents.

Null text counts as empty; a null id counts as the smallest id; rows that repeat id and
text are two documents, and so copies of each other, with one result. Ties between equal
copies go to the smallest (doc_id, start).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .suffix import factors

SIZE, GRAM, HOT, BLOCK = 400, 100, 1024, 1 << 19
WIDTHS = (32, 4, 1)  # distances from the anchor that a cell takes, for anchors with more hulls than HOT
SLICE, PLACE = 1 << 20, 21  # starts handled at once, and bits for a place among them
BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(BASE), of(pow(BASE, -1, 1 << 64))


def _ordered(buf: np.ndarray, gram: int, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each gram, and what orders them: its upper bits, then its place."""
    n = len(buf)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(buf * powers[0][:n], out=sums[1:])
    grams = (sums[gram:] - sums[: n - gram + 1]) * powers[1][: n - gram + 1]
    grams ^= grams >> np.uint64(33)
    grams *= np.uint64(0xFF51AFD7ED558CCD)
    grams ^= grams >> np.uint64(29)
    return grams, grams & ~np.uint64((1 << PLACE) - 1) | np.arange(len(grams), dtype=np.uint64)


def runs(buf: np.ndarray, valid: np.ndarray, size: int, gram: int, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of the anchor, the first and the last start of each run; valid: the starts that count."""
    n, width = len(buf), size - gram + 1
    grams, key = _ordered(buf, gram, powers)
    low = np.uint64((1 << PLACE) - 1)
    starts = n - size + 1
    padded = np.full(-(-len(key) // width) * width, ~np.uint64(0))
    padded[: len(key)] = key
    tiles = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].reshape(-1)[:starts]
    behind = np.minimum.accumulate(tiles, axis=1).reshape(-1)[width - 1 : width - 1 + starts]
    place = (np.minimum(ahead, behind) & low).astype(np.int64)
    step = np.flatnonzero(np.diff(place) != 0) + 1
    ok = np.concatenate([[False], valid[:starts], [False]])
    first = np.union1d(step[valid[:starts][step]], np.flatnonzero(ok[1:-1] & ~ok[:-2]))
    last = np.union1d(step[valid[:starts][step - 1]] - 1, np.flatnonzero(ok[1:-1] & ~ok[2:]))
    return grams[place[first]], first, last


def _slices(texts: list[bytes], size: int) -> Iterator[tuple[list[tuple[int, int]], bytes]]:
    """Texts, or slices of long ones, put together: (row, offset in its text) of each, and the bytes.
    A slice has size - 1 bytes of the next, so that each start is in one."""
    at: list[tuple[int, int]] = []
    held: list[bytes] = []
    total = 0
    for r, t in enumerate(texts):
        for lo in range(0, len(t) - size + 1, SLICE):
            part = t[lo : lo + SLICE + size - 1]
            if total + len(part) > SLICE + size and held:
                yield at, held
                at, held, total = [], [], 0
            at.append((r, lo))
            held.append(part)
            total += len(part)
    if held:
        yield at, held


def marked(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """did, h, n_bytes, sha, and the runs of every document: anchor hash, hull digest, first and last start."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        powers = _powers(SLICE + 2 * size)
        for b in batches:
            texts = common.raw(b)
            out: list[list[list]] = [[[] for _ in texts] for _ in range(4)]
            for at, parts in _slices(texts, size):
                joined = b"".join(parts)
                buf = np.frombuffer(joined, np.uint8).astype(np.uint64)
                ends = np.cumsum([len(x) for x in parts])
                valid = np.ones(len(buf), bool)
                for e in ends.tolist():
                    valid[max(0, e - size + 1) : e] = False
                key, lo, hi = runs(buf, valid, size, gram, powers)
                doc = np.searchsorted(ends, lo, "right").tolist()
                begin = (ends - [len(x) for x in parts]).tolist()
                for d, k, i, j in zip(doc, key.view(np.int64).tolist(), lo.tolist(), hi.tolist(), strict=True):
                    r, off = at[d]
                    hull = digest(joined[i : j + size])
                    for to, x in zip(out, (k, hull - (1 << 64) * (hull >> 63), i - begin[d] + off, j - begin[d] + off), strict=True):
                        to[r].append(x)
            longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
            yield common.rows({
                "did": (b.column("did"), None), "h": (b.column("h"), None), "n_bytes": ([len(t) for t in texts], pa.int64()), "sha": ([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                "key": (out[0], longs), "hull": (out[1], longs), "lo": (out[2], ints), "hi": (out[3], ints),
            })

    return common.over(docs, work, "did long, h long, n_bytes long, sha binary, key array<long>, hull array<long>, lo array<int>, hi array<int>")


SPAN = "did long, h long, lo int, hi int"
PART = "did long, h long, key long, m long, lo long, hi long, hull binary"


def _spread(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive true values: their first and last places."""
    edge = np.diff(np.concatenate([[0], first.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def block_spans(rows: list[tuple[int, int, int, int, int, bytes]], size: int, keep: str) -> list[tuple[int, int, int, int]]:
    """For hulls (did, h, first start, last start, count, bytes): the bytes of strings that repeat, or with keep
    "first" of those that have an earlier copy. Without, hulls with a count over 1 are settled already."""
    buf = np.frombuffer(b"".join(x[5] for x in rows) + bytes(8), np.uint8)
    sizes = np.array([len(x[5]) for x in rows])
    begin = np.cumsum(sizes) - sizes
    starts = np.concatenate([np.arange(o, o + n - size + 1) for o, n in zip(begin.tolist(), sizes.tolist(), strict=True)])
    before, after = factors(buf, starts, size)
    found = before >= size if keep == "first" else (before >= size) | (after >= size)
    out, at = [], 0
    for x, n in zip(rows, (sizes - size + 1).tolist(), strict=True):
        hit = found[at : at + n]
        at += n
        if hit.any() and (keep == "first" or x[4] == 1):
            out += [(x[0], x[1], x[2] + int(i), x[2] + int(j) + size) for i, j in zip(*_spread(hit), strict=True)]
    return out


def _cut(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The bytes of wanted hulls (did, h, key, m, lo, hi)."""
    asked = wanted.groupBy("did", "h").agg(F.collect_list(F.struct("key", "m", "lo", "hi")).alias("w"))  # at most a document's own runs

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = common.unpacker()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:6]), pa.array(cols[6], pa.binary())], ["did", "h", "key", "m", "lo", "hi", "hull"])

        for b in batches:
            rows: list[tuple] = []
            held = 0
            for did, h, z, want in zip(*(b.column(x).to_pylist() for x in ("did", "h", "z", "w")), strict=True):
                t = unpack(z)
                for w in want:
                    rows.append((did, h, w["key"], w["m"], w["lo"], w["hi"], t[w["lo"] : w["hi"] + size]))
                    held += len(rows[-1][-1])
                if held > 1 << 23:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    return common.over(texts.join(asked.hint("shuffle_hash"), ["did", "h"]), work, PART)


def _solved(parts: DataFrame, size: int, keep: str) -> DataFrame:
    """Spans of hulls that share anchors, by suffix order in blocks of whole anchors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total, last = 0, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*block_spans(rows, size, keep), strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["did", "h", "lo", "hi"])

        for b in batches:
            for key, *row in zip(*(b.column(x).to_pylist() for x in ("key", "did", "h", "lo", "hi", "m", "hull")), strict=True):
                if total >= BLOCK and key != last:  # anchors are never torn
                    yield out(held)
                    held, total = [], 0
                held.append(tuple(row))
                total += len(row[5])
                last = key
        if held:
            yield out(held)

    n = common.width(parts.sparkSession)
    dealt = parts.select("key", "did", "h", "lo", "hi", "m", "hull").repartition(n, "key").sortWithinPartitions("key", "did", "lo", "h")
    return common.over(dealt, work, SPAN)


def cells(hull: bytes, key: int, width: int, size: int, gram: int, powers: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, int, bytes]]:
    """A hull in parts, by how far before its anchor strings begin, ``width`` distances together: (key, first start,
    last start, bytes). Equal strings lie equally far before their anchor, and all of a cell have its core in common,
    so cells are told apart by key, distance and core, and equal strings stay together."""
    from xxhash import xxh3_64_intdigest as digest

    place = int(_ordered(np.frombuffer(hull[:size], np.uint8).astype(np.uint64), gram, powers)[1].argmin())
    far, near = place, place - (len(hull) - size)  # of the first start and of the last
    for c in range(near // width, far // width + 1):
        lo, hi = max(near, c * width), min(far, c * width + width - 1)
        core = hull[place - c * width : place - (c * width + width - 1) + size]
        new = digest(b"%d %d " % (key, c) + core)
        yield new - (1 << 64) * (new >> 63), place - hi, place - lo, hull[place - hi : place - lo + size]


def _refined(parts: DataFrame, width: int, size: int, gram: int) -> DataFrame:
    """Hulls as ``_shared`` takes them, cell by cell."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        powers = _powers(size)
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for did, h, key, m, first, hull in zip(*(b.column(x).to_pylist() for x in ("did", "h", "key", "m", "lo", "hull")), strict=True):
                for new, i, j, part in cells(hull, key, width, size, gram, powers):
                    d = digest(part)
                    for to, x in zip(out, (new, d - (1 << 64) * (d >> 63), did, h, first + i << 32 | first + j, m), strict=True):
                        to.append(x)
            yield common.rows(dict(zip(("key", "hull", "did", "h", "at", "m"), ((x, pa.int64()) for x in out), strict=True)))

    return common.over(parts, work, "key long, hull long, did long, h long, at long, m long")


def _shared(each: DataFrame, size: int, keep: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For hulls (key, hull, did, h, at, m) those whose anchor others have, the spans of those that equal others, and, of
    the anchors with different hulls, the first of each kind (did, h, key, m, lo, hi, kinds)."""
    twice = common.settle(each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "twice")
    shared = common.settle(each.join(twice, "key"), "shared")
    hulls = common.settle(shared.groupBy("key", "hull").agg(F.count("*").alias("n"), F.sum("m").alias("m"), F.min(F.struct("did", "at", "h")).alias("first")), "hulls")
    kinds = common.settle(hulls.groupBy("key").agg(F.count("*").alias("kinds")), "kinds")
    hulls = common.settle(hulls.join(kinds, "key").where("kinds > 1 or n > 1"), "met")
    lo, hi = F.shiftright("at", 32).cast("int"), F.col("at").bitwiseAND(0xFFFFFFFF).cast("int")
    copies = shared.join(hulls.where("n > 1").select("key", "hull", "first"), ["key", "hull"])
    # without copies to keep, what counts more than once is settled already
    copies = copies.where(F.struct("did", "at", "h") > F.col("first") if keep == "first" else F.col("m") == 1)
    whole = copies.select("did", "h", lo.alias("lo"), (hi + size).alias("hi"))
    wanted = hulls.where("kinds > 1").select("first.did", "first.h", "key", "m", F.col("first.at").alias("at"), "kinds")
    return shared, whole, wanted.select("did", "h", "key", "m", lo.alias("lo"), hi.alias("hi"), "kinds")


def repeats(docs: DataFrame, keep: str = "none", size: int = SIZE, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(did, h, n_bytes, sha of every row; did, h, z of the documents that may hold repeats; spans).

    Spans (did, h, lo, hi) are bytes covered by strings that also start elsewhere, or with keep "first" by
    strings that also start earlier, in order of (doc_id, start)."""
    if keep not in ("none", "first"):
        raise ValueError(f"keep is none or first, not {keep!r}")
    rows = common.keyed(docs)
    marks = common.settle(marked(rows, size, gram), "marked")
    each = marks.select("did", "h", F.explode(F.arrays_zip("key", "hull", "lo", "hi")).alias("r"))
    each = each.select("r.key", "r.hull", "did", "h", (F.shiftleft(F.col("r.lo").cast("long"), 32) + F.col("r.hi")).alias("at"), F.lit(1).cast("long").alias("m"))
    shared, spans, wanted = _shared(each, size, keep)
    texts = common.packed(rows).join(shared.select("did", "h").distinct().hint("shuffle_hash"), ["did", "h"], "left_semi")
    texts = common.settle_bucketed(texts.dropDuplicates(["did", "h"]), "repeated", ["did", "h"], common.width(docs.sparkSession))
    for width in WIDTHS:
        many = wanted.where(F.col("kinds") > hot)
        if many.isEmpty():
            break
        spans = spans.unionByName(_solved(_cut(texts, wanted.where(F.col("kinds") <= hot), size), size, keep))
        _, more, wanted = _shared(_refined(_cut(texts, many, size), width, size, gram), size, keep)
        spans = spans.unionByName(more)
    # in cells one distance wide all hulls of a key are equal, so that nothing is wanted
    return marks.select("did", "h", "n_bytes", "sha"), texts, spans.unionByName(_solved(_cut(texts, wanted, size), size, keep))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def removed(docs: DataFrame, keep: str = "none", size: int = SIZE, gram: int = GRAM, hot: int = HOT, texts: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row, with ``texts`` also did, h and what is kept of
    each document that loses bytes. keep: "none" removes every copy of a repeat, "first" all but the earliest."""
    every, held, spans = repeats(docs, keep, size, gram, hot)
    # a row that is repeated as a whole has the same spans twice
    by_doc = spans.groupBy("did", "h").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = common.unpacker()
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for z, spans in zip(b.column("z").to_pylist(), b.column("spans").to_pylist(), strict=True):
                t, cuts = unpack(z), merged([(s["lo"], s["hi"]) for s in spans])
                kept = b"".join(t[i:j] for i, j in zip([0, *(hi for _, hi in cuts)], [*(lo for lo, _ in cuts), len(t)], strict=True))
                for to, x in zip(out, (len(t) - len(kept), len(cuts), hashlib.sha256(kept).digest(), kept if texts else None), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([b.column("did"), b.column("h"), *(pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True))], ["did", "h", "n_removed", "n_spans", "kept_sha", "kept"])

    cut = common.over(held.join(by_doc.hint("shuffle_hash"), ["did", "h"]), work, "did long, h long, n_removed long, n_spans long, kept_sha binary, kept binary")
    out = every.join(cut if texts else cut.drop("kept"), ["did", "h"], "left")
    named = out.select(
        common.doc_id(), "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.lower(F.hex(F.coalesce("kept_sha", "sha"))).alias("kept_sha256"), *(("did", "h", "kept") if texts else ()),
    )
    return named


def brute(texts: dict[int, bytes], size: int = SIZE) -> dict[int, tuple[int, int, int, str]]:
    """The same of a few documents by counting every string, for tests."""
    from collections import Counter

    seen = Counter(t[i : i + size] for t in texts.values() for i in range(len(t) - size + 1))
    out = {}
    for d, t in texts.items():
        cuts = merged([(i, i + size) for i in range(len(t) - size + 1) if seen[t[i : i + size]] > 1])
        kept = b"".join(t[i:j] for i, j in zip([0, *(hi for _, hi in cuts)], [*(lo for lo, _ in cuts), len(t)], strict=True))
        out[d] = (len(t), len(t) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest())
    return out


SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
start AS (SELECT r, s, md5(array_slice(b, s, s + 399)) AS m FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS s FROM doc)),
twice AS (SELECT m FROM start GROUP BY m HAVING count(*) > 1),
island AS (SELECT r, s, coalesce(s > lag(s) OVER (PARTITION BY r ORDER BY s) + 400, TRUE)::INT AS fresh FROM start JOIN twice USING (m)),
span AS (
  SELECT r, min(s) AS lo, max(s) + 400 AS hi
  FROM (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS run FROM island) GROUP BY r, run
), gone AS (SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last FROM span GROUP BY r),
piece AS (
  SELECT r, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 1) AS a, lo - 1 AS z FROM span
  UNION ALL SELECT r, coalesce(last, 1), octet_length(b) FROM doc LEFT JOIN gone USING (r)
), kept AS (SELECT r, string_agg(CASE WHEN a <= z THEN hex(array_slice(b, a, z)) ELSE '' END, '' ORDER BY a) AS x FROM piece JOIN doc USING (r) GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(x)) AS kept_sha256
FROM doc JOIN kept USING (r) LEFT JOIN gone USING (r)
"""

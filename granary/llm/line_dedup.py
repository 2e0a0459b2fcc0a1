"""Line dedup by a range-partitioned, secondarily sorted stream of line hashes.

A line's key is the line without white space at its ends and with A-Z in lower
case. Keys of at least ``least`` code points that more than one document holds
keep their lines only in the smallest doc_id. What is sorted is (128-bit hash, document,
position), never text. The range partitioning includes the document, so that one
hash may run over many partitions: each streams first occurrences with constant
memory, decides all but the hash that it began in, and reports its first and last
hash, from which the few open hashes are decided. The result is a compressed keep
bitmap for each document, not text.

Null or empty text is one empty line. A null id counts as the smallest id; rows
that repeat id and text are one document. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SPACE = b" \t\n\v\f\r"


def lines_of(docs: DataFrame, least: int) -> DataFrame:
    """did, h, pos, k1, k2 of each line whose key is long enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest as digest

        for b in batches:
            hashes, at, rows = [], [], []
            for r, t in enumerate(common.raw(b)):
                for pos, line in enumerate(t.split(b"\n")):
                    key = line.strip(SPACE)
                    if len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least):
                        hashes.append(digest(key.lower()))
                        at.append(pos)
                        rows.append(r)
            k = np.frombuffer(b"".join(hashes), dtype=">i8").astype(np.int64).reshape(-1, 2)
            took = pa.array(rows, pa.int32())
            yield common.rows({"did": (b.column("did").take(took), None), "h": (b.column("h").take(took), None), "pos": (at, pa.int32()), "k1": (pa.array(k[:, 0]), None), "k2": (pa.array(k[:, 1]), None)})

    return common.over(docs.select("did", "h", "text"), work, "did long, h long, pos int, k1 long, k2 long")


def first_seen(lines: DataFrame) -> DataFrame:
    """Lines to drop (open: false), lines of a partition's first key, undecided (open: true), and for
    the first and last key of each partition the smallest did that it holds of it (pos: -1)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("did", "h", "pos", "k1", "k2")
        key, least, opening, began = None, None, True, None  # the running key, its smallest did, whether it is the first key

        def out(part: dict[str, np.ndarray], is_open: bool) -> pa.RecordBatch:
            return common.rows({x: (pa.array(part[x]), None) for x in names} | {"open": (pa.array(np.full(len(part["did"]), is_open)), None)})

        def note(k: tuple[int, int], did: int) -> pa.RecordBatch:
            one = {"did": did, "h": 0, "k1": k[0], "k2": k[1]}
            return out({x: np.array([v], np.int64) for x, v in one.items()} | {"pos": np.array([-1], np.int32)}, True)

        for b in batches:
            if not b.num_rows:
                continue
            c = {x: b.column(x).to_numpy() for x in names}
            new = np.ones(b.num_rows, bool)
            new[1:] = (c["k1"][1:] != c["k1"][:-1]) | (c["k2"][1:] != c["k2"][:-1])
            head = (int(c["k1"][0]), int(c["k2"][0]))
            if key is None:
                key, least, began = head, int(c["did"][0]), (head, int(c["did"][0]))
            new[0] = head != key
            starts = np.flatnonzero(new)
            # the smallest did of each row's key: rows come by did within a key
            keeper = np.concatenate([[least], c["did"][starts]])[np.cumsum(new)]
            edge = (starts[0] if len(starts) else b.num_rows) if opening else 0
            if edge:
                yield out({x: v[:edge] for x, v in c.items()}, True)
            late = np.flatnonzero(c["did"][edge:] != keeper[edge:]) + edge
            if len(late):
                yield out({x: v[late] for x, v in c.items()}, False)
            if len(starts):
                opening, least = False, int(c["did"][starts[-1]])
                key = (int(c["k1"][-1]), int(c["k2"][-1]))
        if key is not None:
            yield note(*began)
            if not opening:
                yield note(key, least)

    n = common.width(lines.sparkSession)
    dealt = lines.repartitionByRange(n, "k1", "k2", "did").sortWithinPartitions("k1", "k2", "did", "h", "pos")
    return common.over(dealt, work, "did long, h long, pos int, k1 long, k2 long, open boolean")


def dropped(docs: DataFrame, least: int = 10) -> DataFrame:
    """did, h, bits: for each document that loses lines, its keep bitmap up to the last dropped line, compressed."""
    seen = common.settle(first_seen(lines_of(docs, least)), "lines")
    ends = common.settle(seen.where("pos < 0").groupBy("k1", "k2").agg(F.min("did").alias("keeper")), "ends")
    late = seen.where("open and pos >= 0").join(ends, ["k1", "k2"]).where("did <> keeper")
    gone = seen.where("not open").select("did", "h", "pos").unionByName(late.select("did", "h", "pos"))
    # a row that is repeated as a whole drops the same lines twice
    by_doc = gone.groupBy("did", "h").agg(F.collect_set("pos").alias("gone"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone, bits = b.column("gone"), []
            for k in range(b.num_rows):
                at = gone[k].values.to_numpy()
                keep = np.ones(int(at.max()) + 1, np.uint8)
                keep[at] = 0
                bits.append(zlib.compress(np.packbits(keep).tobytes()))
            last = pa.array([int(gone[k].values.to_numpy().max()) + 1 for k in range(b.num_rows)], pa.int32())
            yield common.rows({"did": (b.column("did"), None), "h": (b.column("h"), None), "upto": (last, None), "n_dropped": (pa.array([len(gone[k]) for k in range(b.num_rows)], pa.int64()), None), "bits": (bits, pa.binary())})

    return common.over(by_doc, work, "did long, h long, upto int, n_dropped long, bits binary")


def kept_lines(text: bytes, upto: int | None, bits: bytes | None) -> tuple[int, bytes]:
    """The number of lines of a text, and what its bitmap keeps of it."""
    lines = text.split(b"\n")
    if bits is None:
        return len(lines), text
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8))[:upto].tolist()
    return len(lines), b"\n".join([x for x, k in zip(lines, keep) if k] + lines[upto:])


def applied(docs: DataFrame, least: int = 10, carry: Sequence[str] = ()) -> DataFrame:
    """did, h, n_lines, n_dropped and the kept text of every document, and columns to carry along as x_<name>. Texts are shuffled once."""
    rows = common.keyed(docs, carry)
    marks = common.settle(dropped(rows, least), "bitmaps")
    extra = [f for f in rows.schema.fields if f.name.startswith("x_")]
    own = T._parse_datatype_string("did long, h long, n_lines long, n_dropped long, kept binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = common.unpacker()
        for b in batches:
            n, kept = [], []
            for z, upto, bits in zip(*(b.column(x).to_pylist() for x in ("z", "upto", "bits")), strict=True):
                count, text = kept_lines(unpack(z), upto, bits)
                n.append(count)
                kept.append(text)
            yield common.rows({"did": (b.column("did"), None), "h": (b.column("h"), None), "n_lines": (n, pa.int64()), "n_dropped": (b.column("n_dropped").fill_null(0), None), "kept": (kept, pa.binary())} | {f.name: (b.column(f.name), None) for f in extra})

    both = common.packed(rows).join(marks.hint("shuffle_hash"), ["did", "h"], "left")
    return common.over(both, work, T.StructType([*own.fields, *extra]))


def digest(kept: DataFrame) -> DataFrame:
    return kept.select(common.doc_id(), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def brute(texts: dict[int, bytes], least: int = 10) -> dict[int, tuple[int, int, str]]:
    """The same of a few documents by dictionaries, for tests."""
    key = lambda x: x.strip(SPACE).lower()
    holds: dict[bytes, set[int]] = {}
    for d, t in texts.items():
        for x in t.split(b"\n"):
            holds.setdefault(key(x), set()).add(d)
    out = {}
    for d, t in texts.items():
        lines = t.split(b"\n")
        kept = [x for x in lines if len(key(x).decode()) < least or min(holds[key(x)]) == d]
        out[d] = (len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest())
    return out


SQL = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line
), held AS (SELECT key, min(doc_id) AS keeper FROM keyed GROUP BY key HAVING length(key) >= 10 AND min(doc_id) < max(doc_id)),
marked AS (SELECT k.*, h.keeper IS NOT NULL AND h.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN held h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

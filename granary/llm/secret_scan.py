"""Secret scanning over an incremental, content-addressed blob ledger.

Every historical version of a path is addressed by the SHA-256 of its text. The
ledger says which (blob, rule, rule version) have been scanned; only pairs that it
does not hold are scanned, each blob once however many paths hold it, and the
findings are joined back to all paths. The blobs to scan are chosen on digests
alone; the one shuffle that carries text carries it compressed. Joins back to
paths are plain equi-joins, which Spark splits where one blob has many paths.

Kinds, in listed order: assign, access, hex, and pem, which the method adds: a
private key's whole armoured block. Null text counts as empty, null paths stay
null, an empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The patterns, with the version under which the ledger files each.
RULES = {
    "assign": (1, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": (1, r"AKIA[A-Z0-9]+"),
    "hex": (1, r"[0-9a-f]+"),
    "pem": (1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
}
KINDS = tuple(RULES)
BASE = KINDS[:3]
CUES = ("password", "passwd", "secret", "token", "api")
END = re.compile(r"-----END (?:[A-Z]+ )*PRIVATE KEY-----", re.ASCII)
FINDS = "array<struct<kind:string,start:int,end:int>>"


def scanner(kinds: tuple[str, ...] = KINDS):
    """A function from a text to its (start, place of kind, end); linear time for each rule."""
    assign, pem = (re.compile(RULES[k][1], re.ASCII) for k in ("assign", "pem"))
    # the runs that are long enough are those that the whole pattern's runs become after dropping the short
    access, runs = re.compile(r"AKIA[A-Z0-9]{16,}", re.ASCII), re.compile(r"[0-9a-f]{24,}", re.ASCII)

    def scan(t: str) -> list[tuple[int, int, int]]:
        out = []
        if "assign" in kinds:
            low = t.lower()
            if any(c in low for c in CUES):
                out += [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 6]
        if "access" in kinds and "AKIA" in t:
            out += [(m.start(), 1, m.end()) for m in access.finditer(t)]
        if "hex" in kinds:
            out += [(m.start(), 2, m.end()) for m in runs.finditer(t)]
        if "pem" in kinds and "-----BEGIN " in t:
            ends = [m.span() for m in END.finditer(t)]
            begins = [m.span() for m in pem.finditer(t)] + [(len(t), 0)]
            k = 0
            # a block ends before the next begins; a begin without an end stands alone
            for (i, j), (following, _) in zip(begins, begins[1:], strict=False):
                while k < len(ends) and ends[k][0] < j:
                    k += 1
                out.append((i, 3, ends[k][1] if k < len(ends) and ends[k][0] < following else j))
        return sorted(out)

    return scan


class BlobLedger:
    """Scanned pairs and findings, kept as two tables under a path that executors share.

    ``scan(versions)`` takes rows with ``doc_id`` (the path) and ``text`` (one version),
    scans what is new, files it, and returns a row for each version with its findings.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or common.scratch(spark, "ledger")).rstrip("/")
        self.commits = common.Commits(spark, self.path)

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        rows = self.spark.read.schema(f"{schema}, attempt string").parquet(f"{self.path}/{name}") if there else self.spark.createDataFrame([], f"{schema}, attempt string")
        return rows.where(F.col("attempt").isin(list(self.commits.done().values()))).drop("attempt")

    def pairs(self) -> DataFrame:
        """The (blob, rule, version) whose scan is committed."""
        return self._read("pairs", "blob binary, rule string, version int")

    def findings(self) -> DataFrame:
        return self._read("findings", f"blob binary, rule string, version int, spans {FINDS}")

    def _file(self, rows: DataFrame, name: str, attempt: str) -> None:
        rows.withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(f"{self.path}/{name}")

    def scan(self, versions: DataFrame, rules: dict[str, int] | None = None) -> DataFrame:
        rules = rules or {k: v for k, (v, _) in RULES.items()}
        docs = common.keyed(versions)
        paths = common.settle(docs.select("did", "h", F.unhex(F.sha2("text", 256)).alias("blob")), "paths")
        first = paths.groupBy("blob").agg(F.min(F.struct("did", "h")).alias("at"))
        asked = F.array(*(F.struct(F.lit(k).alias("rule"), F.lit(v).alias("version")) for k, v in rules.items()))
        wanted = first.select("blob", "at", F.explode(asked).alias("r")).select("blob", "at", "r.rule", "r.version")
        unseen = wanted.join(self.pairs(), ["blob", "rule", "version"], "left_anti")
        unseen = unseen.groupBy("blob", "at").agg(F.sort_array(F.collect_list("rule")).alias("rules"))
        unseen = common.settle(unseen.select("at.did", "at.h", "blob", "rules"), "unseen")
        found = common.settle(self._scanned(docs, unseen, rules), "found")
        attempt = uuid.uuid4().hex
        self._file(found, "findings", attempt)
        todo = unseen.select("blob", F.explode("rules").alias("rule"))
        version = F.element_at(F.create_map(*(F.lit(x) for kv in rules.items() for x in kv)), F.col("rule"))
        self._file(todo.select("blob", "rule", version.alias("version")), "pairs", attempt)
        self.commits.commit(attempt, attempt)  # findings and pairs count from here on, or neither
        now = self.findings().where(version == F.col("version")).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        return paths.join(common.settle(now, "now"), "blob", "left").select(common.doc_id(), "blob", F.coalesce("spans", F.array().cast(FINDS)).alias("spans"))

    def _scanned(self, docs: DataFrame, unseen: DataFrame, rules: dict[str, int]) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpack, scans = common.unpacker(), {}
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            for b in batches:
                out: tuple[list, list, list, list] = ([], [], [], [])
                for blob, z, todo in zip(*(b.column(x).to_pylist() for x in ("blob", "z", "rules")), strict=True):
                    scan = scans.setdefault(tuple(todo), scanner(tuple(todo)))
                    by: dict[int, list] = {}
                    for i, k, j in scan(unpack(z).decode("utf-8", "replace")):
                        by.setdefault(k, []).append({"kind": KINDS[k], "start": i, "end": j})
                    for k, spans in by.items():
                        for to, x in zip(out, (blob, KINDS[k], rules[KINDS[k]], spans), strict=True):
                            to.append(x)
                yield common.rows(dict(zip(("blob", "rule", "version", "spans"), zip(out, (pa.binary(), pa.string(), pa.int32(), kind), strict=True), strict=True)))

        # a row repeated as a whole is one blob's source twice over: once is enough, either will do
        once = common.packed(docs).join(unseen.hint("shuffle_hash"), ["did", "h"])  # ids and rules are what is hashed, not texts
        return common.over(once.select("blob", "z", "rules"), work, f"blob binary, rule string, version int, spans {FINDS}").dropDuplicates(["blob", "rule"])


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and digests of what ``BlobLedger.scan`` returns."""
    place = F.create_map(*(F.lit(x) for k, name in enumerate(KINDS) for x in (name, k)))
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.element_at(place, s["kind"]).alias("k"), s["kind"].alias("kind"), s["end"].alias("end"))))

    def joined(kinds: tuple[str, ...]) -> F.Column:
        held = F.filter("o", lambda s: s["kind"].isin(*kinds))
        return F.array_join(F.transform(held, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> F.Column:
        return F.size(F.filter("o", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    n = [number(k) for k in KINDS]
    return scanned.withColumn("o", order).select("doc_id", *n, F.sha2(joined(BASE), 256).alias("base_sha256"), joined(KINDS).alias("spans"))


def brute(t: str) -> list[tuple[int, int, int]]:
    """The base spans by the patterns as they stand, for tests."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(RULES["assign"][1], t, re.ASCII) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(RULES["access"][1], t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(RULES["hex"][1], t) if len(m[0]) >= 24]
    return sorted(out)


SQL = r"""
WITH kinds(kind, place, pattern) AS (VALUES
  ('assign', 0, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  ('access', 1, 'AKIA[A-Z0-9]+'), ('hex', 2, '[0-9a-f]+'),
  ('begin', 3, '-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----'), ('end', 4, '-----END (?:[A-Z]+ )*PRIVATE KEY-----')
), doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
cut AS (SELECT r, kind, place, pattern, regexp_extract_all(t, pattern) AS hits, list_transform(string_split_regex(t, pattern), lambda x: length(x)) AS gaps FROM doc, kinds),
hit AS (
  SELECT r, kind, place, hits[k] AS m, list_sum(gaps[1:k]) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS start,
         CASE kind WHEN 'assign' THEN length(regexp_extract(hits[k], pattern, 1)) >= 6 WHEN 'access' THEN length(hits[k]) >= 20 WHEN 'hex' THEN length(hits[k]) >= 24 ELSE TRUE END AS ok
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM cut)
), place AS (SELECT r, kind, place, start::BIGINT AS start, (start + length(m))::BIGINT AS stop FROM hit WHERE ok),
begins AS (SELECT *, coalesce(lead(start) OVER (PARTITION BY r ORDER BY start), 9223372036854775807) AS following FROM place WHERE kind = 'begin'),
pem AS (SELECT b.r, 'pem' AS kind, 3 AS place, b.start, coalesce(min(e.stop), any_value(b.stop)) AS stop FROM begins b LEFT JOIN place e ON e.kind = 'end' AND e.r = b.r AND e.start >= b.stop AND e.start < b.following GROUP BY b.r, b.start),
span AS (SELECT r, kind, place, start, stop FROM place WHERE kind IN ('assign', 'access', 'hex') UNION ALL SELECT * FROM pem),
told AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'pem') AS n_pem,
         string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, place) FILTER (kind <> 'pem') AS base, string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, place) AS spans
  FROM span GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_pem, 0) AS n_pem, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN told USING (r)
"""

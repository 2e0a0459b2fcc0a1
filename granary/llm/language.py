"""Language of web pages by Bayesian evidence fusion.

Text: hashed byte trigrams of the visible text, under counts of all labelled documents.
Markup: the declared language, under a table of what is declared where the text says what.
Address suffix: the same for the last label of the host. Host: a prior smoothed from all pages to
the registered domain to the host, the page's own share left out. Pages and documents have tables of their own, so
that neither change the answers of the others. All tables come from grouped
aggregations over all pages; hosts are joined back by an equi-join that Spark can split where a
host is hot. What reaches the driver is the trigram counts, of fixed size for each language;
all languages count, in blocks of 128 to a broadcast, and a worker holds 64 KB for each.

Null html or url counts as empty, and its host, suffix or declaration is then one value like any other; null ids stay
null; documents have a doc_id and no page_id, pages a page_id and no doc_id; rows that repeat are pages of their own. Without labelled documents there are no languages and lang is null.
Of languages that are equally likely the first by name is given. Texts of any length count whole, read once from end to end.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 13
BLOCK = 128  # languages counted and broadcast at once: 8 MB
HIDDEN = re.compile(rb"<(script|style|noscript|nav)\b")
CLOSED = {x: re.compile(rb"</" + x + rb"\s*>") for x in (b"script", b"style", b"noscript", b"nav")}
HTML, LANG = re.compile(rb"<html\b", re.I), re.compile(rb"\blang\s*=\s*[\"']?([A-Za-z]{2,8})", re.I)
# Labels under which countries' registries register names.
SECOND = frozenset({"ac", "co", "com", "edu", "gov", "net", "org"})
HOST = re.compile(rb"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.I)


def trigrams(text: bytes) -> np.ndarray:
    """Counts of the hashed trigrams of a text in lower case."""
    b = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(BUCKETS, np.int64)
    code = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
    return np.bincount(code >> np.uint32(19), minlength=BUCKETS)


def visible(html: bytes) -> bytes:
    """Without comments, tags, and what scripts and the like hold. What is never closed is looked for once."""
    low, out, at, never = html.lower(), [], 0, set()
    while (i := html.find(b"<", at)) >= 0:
        out.append(html[at:i])
        end = -1
        if low.startswith(b"<!--", i) and b"-->" not in never:
            j = html.find(b"-->", i + 4)
            end = j + 3 if j >= 0 else -1
            if j < 0:
                never.add(b"-->")
        if end < 0 and (m := HIDDEN.match(low, i)) and m[1] not in never:
            closed = CLOSED[m[1]].search(low, m.end())
            end = closed.end() if closed else -1
            if not closed:
                never.add(m[1])
        if end < 0 and b">" not in never:
            end = html.find(b">", i) + 1 or -1
            if end < 0:
                never.add(b">")
        out.append(b" " if end >= 0 else b"<")
        at = end if end >= 0 else i + 1
    out.append(html[at:])
    return b"".join(out)


def declared(html: bytes) -> str:
    """The language that the first tag of the document to name one names."""
    at = 0
    while m := HTML.search(html, at):
        at = html.find(b">", m.end())
        at = len(html) if at < 0 else at
        if said := LANG.search(html, m.end(), at):
            return said[1].lower().decode()
    return ""


def domain(labels: list[str]) -> str:
    """The registered domain of a host."""
    return ".".join(labels[-3 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in SECOND else -2 :])


def counted(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over all labelled documents; combined in each task before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for t, lang in zip(common.raw(b), b.column("lang").to_pylist(), strict=True):
                total[lang] = total.get(lang, 0) + trigrams(t)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield common.rows({"lang": ([lang] * len(at), pa.string()), "bucket": (pa.array(at.astype(np.int32)), None), "n": (pa.array(n[at]), None)})

    rows = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return common.over(rows, work, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def likelihoods(docs: DataFrame, block: int = BLOCK) -> tuple[list[str], Iterator[np.ndarray]]:
    """All languages, and by blocks of them in their order the logarithms of their trigrams' shares."""
    got = common.settle(counted(docs), "trigrams")
    langs = sorted(r[0] for r in got.select("lang").distinct().collect())

    def tables() -> Iterator[np.ndarray]:
        for k in range(0, len(langs), block):
            at = {lang: i for i, lang in enumerate(langs[k : k + block])}
            n = np.full((len(at), BUCKETS), 0.5)
            for lang, bucket, count in got.where(F.col("lang").isin(list(at))).toLocalIterator():  # languages by buckets
                n[at[lang], bucket] += count
            yield np.log(n / n.sum(axis=1, keepdims=True))

    return langs, tables()


def evidence(pages: DataFrame, docs: DataFrame | None, tables: Iterable[np.ndarray]) -> DataFrame:
    """page_id, doc_id, marked, host, domain, suffix, declared, p: the text's posterior under equal priors, tempered for its length.
    Documents are pages without markup or address, whose source stands for the host."""
    sent = [pages.sparkSession.sparkContext.broadcast(t) for t in tables]  # each at most BLOCK languages by BUCKETS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [x.value for x in sent]
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for html, url, marked in zip(common.raw(b, "html"), common.raw(b, "url"), b.column("marked").to_pylist(), strict=True):
                n = trigrams(visible(html) if marked else html)
                # neighbouring trigrams overlap, so their evidence counts as that of the root of their number
                logit = np.concatenate([t @ n for t in tables]) / max(1.0, float(n.sum()) ** 0.5)
                p = np.exp(logit - logit.max())
                if marked:
                    host = (m[1].lower().decode("utf-8", "replace") if (m := HOST.match(url)) else "").rstrip(".")
                    labels = host.split(".")
                    said = declared(html)
                else:
                    host, labels, said = "source:" + url.decode("utf-8", "replace"), [""], ""
                for to, x in zip(out, (host, domain(labels) if marked else "source:", labels[-1], said, p / p.sum()), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("doc_id"), b.column("marked"), *(pa.array(x, pa.string()) for x in out[:4]), pa.array(out[4], pa.list_(pa.float64()))], ["page_id", "doc_id", "marked", "host", "domain", "suffix", "declared", "p"])

    return common.over(_asked(pages, docs), work, "page_id long, doc_id long, marked boolean, host string, domain string, suffix string, declared string, p array<double>")


def _asked(pages: DataFrame, docs: DataFrame | None) -> DataFrame:
    def blank(c: str, name: str) -> F.Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)

    none = F.lit(None).cast("long")
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), none.alias("doc_id"), blank("html", "html"), blank("url", "url"), F.lit(True).alias("marked"))
    if docs is not None:
        out = out.unionByName(docs.select(none.alias("page_id"), F.col("doc_id").cast("long").alias("doc_id"), blank("text", "html"), blank("source", "url"), F.lit(False).alias("marked")))
    return out


def identified(pages: DataFrame, docs: DataFrame, weight: float = 5.0, also: DataFrame | None = None) -> DataFrame:
    """page_id, doc_id, host, declared, text_lang, lang, confidence, text_p of every page, and of every document of ``also``.
    docs: what the likelihoods are counted on. weight: of what a host's prior is smoothed with."""
    langs, tables = likelihoods(docs)
    if not langs:
        rows = _asked(pages, also)
        return rows.select("page_id", "doc_id", *(F.lit(None).cast("string").alias(c) for c in ("host", "declared", "text_lang", "lang")), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("text_p"))
    size = len(langs)
    seen = common.settle(evidence(pages, also, tables), "evidence")
    mass = F.array(*(F.sum(F.col("p")[k]) for k in range(size)))

    def add(a: F.Column, b: F.Column, f) -> F.Column:
        return F.zip_with(a, b, f)

    def share(c: F.Column) -> F.Column:
        total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
        return F.transform(c, lambda x: x / total)

    every = seen.groupBy("marked").agg(mass.alias("all"), F.count_distinct("declared").alias("sayings"), F.count_distinct("suffix").alias("suffixes"))
    # a row of totals for pages and one for documents, and tables of distinct values; Spark broadcasts those it measures as small
    said = common.settle(seen.groupBy("marked", "declared").agg(mass.alias("said")), "said")
    ends = common.settle(seen.groupBy("marked", "suffix").agg(mass.alias("ends")), "ends")
    hosts = common.settle(seen.groupBy("host", "domain").agg(mass.alias("own")), "hosts")
    domains = hosts.groupBy("domain").agg(F.array(*(F.sum(F.col("own")[k]) for k in range(size))).alias("wide"))
    prior = common.settle(hosts.join(domains, "domain").select("host", "own", "wide"), "prior")
    totals = {r["marked"]: r for r in every.collect()}  # two rows at most
    if not totals:
        return seen.select("page_id", "doc_id", "host", "declared", *(F.lit(None).cast("string").alias(c) for c in ("text_lang", "lang")), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("text_p"))

    def of(make) -> F.Column:  # what the totals of a row's kind give
        kinds = list(totals.items())
        out = make(kinds[0][1])
        return F.when(F.col("marked") == kinds[0][0], out).otherwise(make(kinds[1][1])) if len(kinds) > 1 else out

    whole = of(lambda r: F.array(*(F.lit(float(x)) for x in r["all"])))
    base = of(lambda r: F.array(*(F.lit((float(x) + 1.0) / (sum(r["all"]) + size)) for x in r["all"])))
    out = seen.join(said, ["marked", "declared"]).join(ends, ["marked", "suffix"]).join(prior, "host")
    without = lambda c: add(F.col(c), F.col("p"), lambda x, y: F.greatest(x - y, F.lit(0.0)))

    def smoothed(c: F.Column, under: F.Column) -> F.Column:
        return share(add(c, under, lambda x, u: x + weight * u))

    def odds(c: str, kinds: F.Column) -> F.Column:  # of this value where the text is in each language, the page's own share left out
        return add(without(c), whole, lambda x, n: F.log((x + 0.5) / (n + 0.5 * (kinds + 1))))

    host_prior = smoothed(without("own"), smoothed(without("wide"), base))
    logit = add(add(odds("said", of(lambda r: F.lit(r["sayings"]))), odds("ends", of(lambda r: F.lit(r["suffixes"]))), lambda x, y: x + y), add(host_prior, F.col("p"), lambda x, y: F.log(x) + F.log(F.greatest(y, F.lit(1e-30)))), lambda x, y: x + y)
    out = out.withColumn("logit", logit)
    out = out.withColumn("post", share(F.transform("logit", lambda x: F.exp(x - F.array_max("logit")))))
    name = F.array(*(F.lit(x) for x in langs))
    best = lambda c: F.element_at(name, F.array_position(c, F.array_max(c)).cast("int"))
    return out.select("page_id", "doc_id", "host", "declared", best("p").alias("text_lang"), best("post").alias("lang"), F.array_max("post").alias("confidence"), F.array_max("p").alias("text_p"))


SQL = r"""
WITH labelled AS (SELECT lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL),
asked AS (
  SELECT row_number() OVER () AS r, * FROM (
    SELECT page_id, NULL::BIGINT AS doc_id, TRUE AS marked, coalesce(html, '') AS html, coalesce(url, '') AS url FROM pages
    UNION ALL SELECT NULL, doc_id, FALSE, coalesce(text, ''), coalesce(source, '') FROM documents)
), named AS (
  SELECT r, page_id, doc_id, marked,
         CASE WHEN marked THEN rtrim(lower(regexp_extract(url, '^(?i:[a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.') ELSE 'source:' || url END AS host,
         CASE WHEN marked THEN lower(regexp_extract(html, '(?i)<html\b[^>]*?\blang\s*=\s*["'']?([A-Za-z]{2,8})', 1)) ELSE '' END AS declared,
         translate(CASE WHEN marked THEN regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<nav\b.*?</nav\s*>|<[^>]*>', ' ', 'g') ELSE html END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM asked
), placed AS (
  SELECT *, CASE WHEN NOT marked THEN '' ELSE l[-1] END AS suffix,
         CASE WHEN NOT marked THEN 'source:' WHEN len(l) > 2 AND length(l[-1]) = 2 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain
  FROM (SELECT *, string_split(host, '.') AS l FROM named)
), bytes AS (
  SELECT kind, key, hex(encode(' ' || regexp_replace(regexp_replace(t, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g') || ' ')) AS x
  FROM (SELECT 'lang' AS kind, lang AS key, t FROM labelled UNION ALL SELECT 'text', r::VARCHAR, t FROM placed)
), trigram AS (
  SELECT kind, key, (('0x' || substr(x, i, 6))::BIGINT * 2654435761) % 4294967296 >> 19 AS bucket, count(*) AS n
  FROM (SELECT kind, key, x, unnest(range(1, length(x) - 4, 2)) AS i FROM bytes WHERE length(x) > 4) GROUP BY ALL
), langs AS (SELECT DISTINCT lang FROM labelled),
total AS (SELECT key AS lang, sum(n) + 0.5 * 8192 AS total FROM trigram WHERE kind = 'lang' GROUP BY key),
share AS (SELECT g.lang, b.bucket, ln((coalesce(t.n, 0) + 0.5) / g.total) AS share FROM total g CROSS JOIN (SELECT DISTINCT bucket FROM trigram WHERE kind = 'text') b LEFT JOIN trigram t ON t.kind = 'lang' AND t.key = g.lang AND t.bucket = b.bucket),
size AS (SELECT key::BIGINT AS r, greatest(1.0, sqrt(sum(n))) AS size FROM trigram WHERE kind = 'text' GROUP BY key),
logit AS (SELECT t.key::BIGINT AS r, s.lang, sum(t.n * s.share) / any_value(z.size) AS logit FROM trigram t JOIN share s USING (bucket) JOIN size z ON z.r = t.key::BIGINT WHERE t.kind = 'text' GROUP BY 1, 2),
power AS (SELECT p.r, g.lang, exp(coalesce(logit, 0) - max(coalesce(logit, 0)) OVER (PARTITION BY p.r)) AS e FROM placed p CROSS JOIN langs g LEFT JOIN logit l ON l.r = p.r AND l.lang = g.lang),
seen AS (SELECT placed.*, lang, e / sum(e) OVER (PARTITION BY r) AS p FROM power JOIN placed USING (r)),
whole AS (SELECT marked, lang, sum(p) AS whole FROM seen GROUP BY ALL),
kinds AS (SELECT marked, count(DISTINCT declared) AS sayings, count(DISTINCT suffix) AS suffixes FROM placed GROUP BY marked),
base AS (SELECT marked, lang, (whole + 1) / (sum(whole + 1) OVER (PARTITION BY marked)) AS base FROM whole),
said AS (SELECT marked, declared, lang, sum(p) AS said FROM seen GROUP BY ALL),
ends AS (SELECT marked, suffix, lang, sum(p) AS ends FROM seen GROUP BY ALL),
hosts AS (SELECT host, domain, lang, sum(p) AS own FROM seen GROUP BY ALL),
wides AS (SELECT domain, lang, sum(own) AS wide FROM hosts GROUP BY ALL),
wide AS (SELECT s.*, whole, sayings, suffixes, said, ends, own, greatest(wide - p, 0) + 5 * base AS w
  FROM seen s JOIN whole USING (marked, lang) JOIN kinds USING (marked) JOIN base USING (marked, lang) JOIN said USING (marked, declared, lang) JOIN ends USING (marked, suffix, lang) JOIN hosts USING (host, domain, lang) JOIN wides USING (domain, lang)),
own AS (SELECT *, greatest(own - p, 0) + 5 * w / sum(w) OVER (PARTITION BY r) AS o FROM wide),
post AS (SELECT *, ln((greatest(said - p, 0) + 0.5) / (whole + 0.5 * (sayings + 1))) + ln((greatest(ends - p, 0) + 0.5) / (whole + 0.5 * (suffixes + 1))) + ln(o / sum(o) OVER (PARTITION BY r)) + ln(greatest(p, 1e-30)) AS score FROM own),
risen AS (SELECT *, exp(score - max(score) OVER (PARTITION BY r)) AS e FROM post)
SELECT any_value(page_id) AS page_id, any_value(doc_id) AS doc_id, any_value(host) AS host, any_value(declared) AS declared, first(lang ORDER BY p DESC, lang) AS text_lang, first(lang ORDER BY e DESC, lang) AS lang, round(max(e) / sum(e), 6) AS confidence, round(max(p), 6) AS text_p
FROM risen GROUP BY r
"""

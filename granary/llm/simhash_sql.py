"""What operator 2 returns, in SQL: shingles, XXH64 step by step, majority, links and what they reach.

DuckDB has no such hash, so its rounds are put together here, in unsigned 128-bit numbers modulo 2 ** 64.
Links are found by comparing all fingerprints, which is for small tables.
"""

from __future__ import annotations

# The primes of the hash.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
M = f"{1 << 64}::UHUGEINT"


def _mul(a: str, by: int) -> str:
    return f"(({a}) * {by}::UHUGEINT % {M})"


def _rot(a: str, r: int) -> str:
    return f"(((({a}) << {r}) | (({a}) >> {64 - r})) % {M})"


def _round(acc: str, lane: str) -> str:
    return _mul(_rot(f"(({acc}) + {_mul(lane, P2)}) % {M}", 31), P1)


def _lane(at: str, n: int) -> str:
    """n bytes of the hex text x from a place on, the last first."""
    return "('0x' || " + " || ".join(f"substr(x, {at} + {2 * k}, 2)" for k in reversed(range(n))) + ")::UBIGINT::UHUGEINT"


SQL = f"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingle AS (
  SELECT r, array_to_string(w[i : i + least(len(w), 3) - 1], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM doc WHERE len(w) > 0)
), raw AS (SELECT s, hex(encode(s)) AS x, octet_length(encode(s)) AS n FROM (SELECT DISTINCT s FROM shingle)),
-- stripes of 32 bytes, lanes of 8 and 4, single bytes: the hash's own order
stripes AS (SELECT s, x, n, n // 32 * 32 AS done, list_transform(range(0, n // 32 * 4), lambda k: {_lane('k * 16 + 1', 8)}) AS a FROM raw),
accs AS (
  SELECT *, list_transform([0, 1, 2, 3], lambda j: list_reduce([CASE j WHEN 0 THEN (42::UHUGEINT + {P1}::UHUGEINT + {P2}::UHUGEINT) % {M} WHEN 1 THEN (42::UHUGEINT + {P2}::UHUGEINT) % {M} WHEN 2 THEN 42::UHUGEINT ELSE (42::UHUGEINT + {M} - {P1}::UHUGEINT) % {M} END] || list_filter(a, lambda v, k: (k - 1) % 4 = j), lambda v, y: {_round('v', 'y')})) AS v FROM stripes
), merged AS (
  SELECT s, x, n, done, ((CASE WHEN done = 0 THEN 42::UHUGEINT + {P5}::UHUGEINT ELSE
    list_reduce([({_rot('v[1]', 1)} + {_rot('v[2]', 7)} + {_rot('v[3]', 12)} + {_rot('v[4]', 18)}) % {M}] || v, lambda h, y: ({_mul(f"xor(h, {_round('0::UHUGEINT', 'y')})", P1)} + {P4}::UHUGEINT) % {M}) END) + n::UHUGEINT) % {M} AS h FROM accs
), eights AS (
  SELECT s, x, n, done + (n - done) // 8 * 8 AS done, list_reduce([h] || list_transform(range(done // 8, n // 8), lambda k: {_lane('k * 16 + 1', 8)}), lambda h, y: ({_mul(_rot(f"xor(h, {_round('0::UHUGEINT', 'y')})", 27), P1)} + {P4}::UHUGEINT) % {M}) AS h FROM merged
), fours AS (
  SELECT s, x, n, done + CASE WHEN n - done >= 4 THEN 4 ELSE 0 END AS done, CASE WHEN n - done >= 4 THEN ({_mul(_rot(f"xor(h, {_mul(_lane('done * 2 + 1', 4), P1)})", 23), P2)} + {P3}::UHUGEINT) % {M} ELSE h END AS h FROM eights
), ones AS (SELECT s, list_reduce([h] || list_transform(range(done, n), lambda k: ('0x' || substr(x, k * 2 + 1, 2))::UBIGINT::UHUGEINT), lambda h, y: {_mul(_rot(f"xor(h, {_mul('y', P5)})", 11), P1)}) AS h FROM fours),
first AS (SELECT s, {_mul('xor(h, h >> 33)', P2)} AS h FROM ones), second AS (SELECT s, {_mul('xor(h, h >> 29)', P3)} AS h FROM first), hash AS (SELECT s, xor(h, h >> 32)::UBIGINT AS h FROM second),
bit AS (SELECT r, b, 2 * sum((h >> b) & 1) > count(*) AS lit FROM (SELECT r, h, unnest(range(64))::UBIGINT AS b FROM shingle JOIN hash USING (s)) GROUP BY r, b),
print AS (SELECT r, doc_id, coalesce(fp, 0)::UBIGINT AS fp FROM doc LEFT JOIN (SELECT r, bit_or(CASE WHEN lit THEN 1::UHUGEINT << b ELSE 0::UHUGEINT END) AS fp FROM bit GROUP BY r) USING (r)),
node AS (SELECT DISTINCT fp FROM print),
link AS (SELECT a.fp AS a, b.fp AS b FROM node a JOIN node b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)::UHUGEINT::BIT) <= 3),
reach(a, b) AS (SELECT fp, fp FROM node UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
held AS (SELECT reach.a AS fp, min(doc_id) AS low, bool_or(doc_id IS NULL) AS blank FROM reach JOIN print ON print.fp = reach.b GROUP BY reach.a)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, CASE WHEN blank THEN NULL ELSE low END AS component_id FROM print JOIN held USING (fp)
"""

"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, address
schemes, cue words for accounts, and a digit followed by a dot, a digit or a separator. From each anchor
a deterministic local parser walks outwards, finds where the entity begins and
ends, and validates it. No text is ever scanned by a backtracking expression, and
nothing is shuffled: each row is done where it is read.

Kinds, in listed order: email, ip, card, phone, url, account (an international bank account number whose check
digits hold, soon after a cue). Spans are code points, end
exclusive. Null text counts as empty; bytes that are not UTF-8 are read as replacement characters;
null ids stay null; rows are never merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# The alphabets of the entities.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
DIGIT = frozenset("0123456789")
DIALLED = frozenset(" ().0123456789-")
SCHEMES = ("http://", "https://", "ftp://")
URL_ENDS = frozenset(" \t\n\v\f\r<>\"'`")
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta")
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
NEAR = 24  # characters after a cue in which an account number begins


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def email(t: str, at: int, low: int) -> tuple[int, int] | None:
    """Around the at-sign, not beginning before low."""
    i, n = at, len(t)
    while i > low and t[i - 1] in LOCAL:
        i -= 1
    if i == at:
        return None
    j = at + 1
    while j < n and t[j] in LABEL:
        j += 1
    if j == at + 1:
        return None
    end = 0
    while j + 1 < n and t[j] == "." and t[j + 1] in LABEL:
        j += 2
        while j < n and t[j] in LABEL:
            j += 1
        end = j
    return (i, end) if end else None


def dotted(t: str, i: int) -> tuple[list[tuple[int, int]], int]:
    """The runs of digits from i on that single dots join, and where the last ends."""
    n, runs = len(t), []
    while True:
        j = i
        while j < n and t[j] in DIGIT:
            j += 1
        runs.append((i, j))
        if j + 1 < n and t[j] == "." and t[j + 1] in DIGIT:
            i = j + 1
        else:
            return runs, j


def numbered(t: str, i: int) -> int:
    """Where the chain of digits with single separators from i on ends."""
    n = len(t)
    while True:
        while i < n and t[i] in DIGIT:
            i += 1
        if i + 1 < n and t[i] in " -" and t[i + 1] in DIGIT:
            i += 1
        else:
            return i


def dialled(t: str, plus: int) -> int | None:
    """Where a number from the plus sign on ends: at its last digit."""
    n, j = len(t), plus + 1
    if j >= n or t[j] not in DIGIT:
        return None
    j += 1
    while j < n and t[j] in DIALLED:
        j += 1
    while t[j - 1] not in DIGIT:
        j -= 1
    return j if j - plus >= 4 else None


def address(t: str, start: int, after: int) -> int | None:
    """Where a web address ends whose scheme ends at after: a host is needed, closing marks do not belong to it."""
    j, n = after, len(t)
    while j < n and t[j] not in URL_ENDS:
        j += 1
    while j > after and t[j - 1] in ".,;:!?)]}":
        j -= 1
    return j if j > after and (t[after] in LABEL or t[after] == "[") else None


def account(t: str, after: int) -> tuple[int, int] | None:
    """The first account number that begins soon after a cue: two capitals, two digits, 11 to 30 more of either in groups,
    which as a number leave 1 when divided by 97. It ends where letters and digits do, or earlier if only so it holds."""
    n = len(t)
    for i in range(after, min(n - 14, after + NEAR)):
        head = t[i : i + 4]
        if not (head[:2].isalpha() and head[:2].isascii() and head[:2].isupper() and head[2:].isdigit() and head.isascii()) or t[i - 1].isalnum():
            continue
        ends, number, j = [], "", i
        while j < n and len(number) < 34:
            c = t[j]
            if c in DIGIT or "A" <= c <= "Z":
                number += c
                if len(number) >= 15 and not (j + 1 < n and (t[j + 1] in DIGIT or "A" <= t[j + 1] <= "Z")):
                    ends.append((j + 1, number))
            elif c not in " -" or j + 1 == n or not (t[j + 1] in DIGIT or "A" <= t[j + 1] <= "Z"):
                break
            j += 1
        for end, digits in reversed(ends):
            if int("".join(str(int(c, 36)) for c in digits[4:] + digits[:4])) % 97 == 1:
                return i, end
    return None


def anchors():
    """The automaton; the digit pairs come from the alphabets."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in ("@", "+", *SCHEMES, *(a + b for a in sorted(DIGIT) for b in (*sorted(DIGIT), ".", " ", "-"))):
        found.add_word(word, (word if len(word) != 2 else "d.", len(word)) if not word[0].isdigit() else ("dot" if word[1] == "." else "num", 2))
    for word in (f(cue) for cue in CUES for f in (str, str.upper, str.capitalize)):
        found.add_word(word, ("cue", len(word)))
    found.make_automaton()
    return found


def scan(t: str, automaton) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) of all that t holds, by kind, then start."""
    out: list[tuple[int, int, int]] = []
    mail = dots = nums = phones = urls = 0  # where the last match of each kind ended
    for last, (what, size) in automaton.iter(t):
        at = last - size + 1
        if what == "num":
            if at < nums:
                continue
            nums = numbered(t, at)
            digits = t[at:nums].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, at, nums))
        elif what == "dot":
            if at < dots:
                continue
            low = at
            while low > dots and t[low - 1] in DIGIT:
                low -= 1
            runs, dots = dotted(t, low)
            for k in range(0, len(runs) - 3, 4):
                if all(int(t[a:b][-9:]) <= 255 and not t[a : max(a, b - 9)].strip("0") for a, b in runs[k : k + 4]):
                    out.append((1, runs[k][0], runs[k + 3][1]))
        elif what == "@":
            if hit := email(t, at, mail):
                out.append((0, *hit))
                mail = hit[1]
        elif what == "+":
            if at >= phones and (end := dialled(t, at)):
                phones = end
                if 8 <= sum(c in DIGIT for c in t[at:end]) <= 15:
                    out.append((3, at, end))
        elif what == "cue":
            if hit := account(t, last + 1):
                out.append((5, *hit))
        elif at >= urls and (end := address(t, at, last + 1)):
            out.append((4, at, end))
            urls = end
    return sorted(dict.fromkeys(out))  # several cues may lead to one number


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and its spans (kind, start, end, value) of each row of a documents table."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
        for b in batches:
            got = []
            for raw in common.raw(b):
                t = raw.decode("utf-8", "replace")
                got.append([{"kind": KINDS[k], "start": i, "end": j, "value": t[i:j]} for k, i, j in scan(t, automaton)])
            yield common.rows({"doc_id": (b.column("doc_id"), None), "spans": (got, kind)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return common.over(rows, work, "doc_id long, spans array<struct<kind:string,start:int,end:int,value:string>>")


def digest(found: DataFrame) -> DataFrame:
    """The counts and digests of what ``find`` returns."""

    def listed(kinds: tuple[str, ...]) -> F.Column:
        # spans come by kind as listed, then start
        held = F.filter("spans", lambda s: s["kind"].isin(*kinds))
        return F.array_join(F.transform(held, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    n = [number(k) for k in KINDS]
    return found.select("doc_id", *n, F.sha2(listed(BASE), 256).alias("base_sha256"), listed(KINDS).alias("spans"))


def brute(t: str) -> list[tuple[int, int, int]]:
    """The same base spans by regular expressions, for tests."""
    import re

    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub(r"\D", "", m[0])) <= 19 and luhn(d)]
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out)


def sha(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{i}:{j}" for k, i, j in spans if k < 4).encode()).hexdigest()


SQL = r"""
WITH kinds(kind, place, pattern) AS (VALUES
  ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'), ('ip', 1, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
  ('card', 2, '[0-9]([\x20-]?[0-9])+'), ('phone', 3, '\+[0-9][\x20().0-9-]+[0-9]'),
  ('url', 4, '(?:https?|ftp)://[A-Za-z0-9\[-](?:[^ \t\n\x0B\f\r<>"''`]*[^ \t\n\x0B\f\r<>"''`.,;:!?)\]}])?'), ('cue', 5, '__CUES__')
), doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
cut AS (SELECT r, kind, place, regexp_extract_all(t, pattern) AS hits, list_transform(string_split_regex(t, pattern), lambda x: length(x)) AS gaps FROM doc, kinds),
hit AS (
  SELECT r, kind, place, hits[k] AS m, regexp_replace(hits[k], '[^0-9]', '', 'g') AS d,
         (list_sum(gaps[1:k]) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0))::BIGINT AS start
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM cut)
), base AS (
  SELECT r, kind, place, start, start + length(m) AS stop FROM hit WHERE CASE kind
    WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR right('000' || x, 3) > '255')) = 0
    WHEN 'card' THEN length(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN substr(d, i, 1)::INT ELSE 2 * substr(d, i, 1)::INT - 9 * (substr(d, i, 1) > '4')::INT END)) % 10 = 0
    WHEN 'phone' THEN length(d) BETWEEN 8 AND 15 WHEN 'cue' THEN FALSE ELSE TRUE END
), near AS (
  SELECT r, cue, i, substr(t, i + 1, 100) AS rest
  FROM (SELECT r, start AS cue, unnest(range(start + length(m), start + length(m) + 24)) AS i FROM hit WHERE kind = 'cue') JOIN doc USING (r)
  WHERE regexp_matches(substr(t, i + 1, 4), '^[A-Z]{2}[0-9]{2}') AND NOT regexp_matches(substr(t, i, 1), '[\p{L}\p{N}]')
), chain AS (
  SELECT r, cue, i, length(x) AS n, regexp_replace(x, '[ -]', '', 'g') AS d
  FROM (SELECT r, cue, i, rest, regexp_extract(rest, '^[A-Z0-9](?:[ -]?[A-Z0-9]){' || unnest(range(14, 34)) || '}') AS x FROM near)
  WHERE x <> '' AND NOT regexp_matches(substr(rest, length(x) + 1, 1), '[A-Z0-9]')
), sound AS (
  SELECT r, cue, i, n FROM chain
  WHERE list_reduce([0] || list_transform(string_split(substr(d, 5) || substr(d, 1, 4), ''), lambda c: CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1
), account AS (SELECT DISTINCT r, 'account' AS kind, 5 AS place, first(i ORDER BY i, n DESC) AS start, first(i + n ORDER BY i, n DESC) AS stop FROM sound GROUP BY r, cue),
span AS (SELECT * FROM base UNION ALL SELECT * FROM account),
told AS (
  SELECT r, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone, count(*) FILTER (kind = 'url') AS n_url, count(*) FILTER (kind = 'account') AS n_account,
         string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY place, start) FILTER (place < 4) AS base, string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY place, start) AS spans
  FROM span GROUP BY r
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, coalesce(n_url, 0) AS n_url, coalesce(n_account, 0) AS n_account, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN told USING (r)
""".replace("__CUES__", "|".join(f(cue) for cue in CUES for f in (str, str.upper, str.capitalize)))

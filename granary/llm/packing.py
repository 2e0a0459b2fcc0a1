"""Best-fit packing of tokenized documents by bin completion with branch and bound.

Every document is tokenized where it is read (each distinct word once for a worker), cut
only if longer than a sequence. Packing needs no more than how many pieces have each
length: a histogram of bounded size, which is all that reaches the driver. There, around the
largest piece that is left, the undominated fillings of the rest of its sequence are
enumerated, least waste first, and tried with as many sequences as the counts allow;
branches whose waste cannot beat the incumbent are cut. The incumbent begins as best-fit
decreasing; a bound on the sequences needed ends the search once it is met.

A plan is a table of (length, ranks from, first sequence, offset). Pieces learn their rank among
those of their length from counts by task, and look their place up in it. No tokens are shuffled.

Null text counts as empty: one piece with the end id alone. A null id stays null; rows that repeat
are pieces of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import sys
import unicodedata
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

LENGTH, END = 2048, 0
MEMORY, ENTRY = 96 << 20, 200  # bytes of each of the two generations of words that a worker remembers, and of an entry beside its own
STEP = 1 << 22  # bytes of text that are encoded at once
EFFORT = 500_000  # steps of the search for a plan, some seconds
STOPS = b".,;:!?"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of whole texts by a vocabulary that drops white space and case and never joins what ASCII white space parts.

    Each distinct word is encoded once while it is remembered. Stops after a word of letters are tokens of their own."""

    def __init__(self, path: str, memory: int = MEMORY, step: int = STEP):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.memory, self.step = Tokenizer.from_file(path), memory, step
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # as it is, and for words of lower-case letters, to which its normalizers and patterns do nothing
        self.whole = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.plain = normalizers.Sequence([]), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.held = 0  # bytes of known

    def _encode(self, how: tuple, words: list[str]) -> list[bytes]:
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = how
        ids = [array("I", e.ids) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        if sys.byteorder == "big":
            for x in ids:
                x.byteswap()
        return [x.tobytes() for x in ids]

    def _keep(self, items: list[tuple[bytes, bytes]]) -> None:
        self.known.update(items)
        self.held += sum(ENTRY + len(w) + len(x) for w, x in items)

    def learn(self, words: Iterable[bytes]) -> None:
        plain, other, parted = {}, {}, []
        for w in words:
            core = w.rstrip(STOPS)
            s = core.decode("utf-8", "replace")
            if s.isalpha() and (s.isascii() or s.islower() and s == s.lower() and unicodedata.is_normalized("NFC", s)):
                plain[core] = s
                if len(core) < len(w):
                    other[w[len(core) :]] = w[len(core) :].decode()
                    parted.append((w, core, w[len(core) :]))
            else:
                other[w] = w.decode("utf-8", "replace")
        for how, named in ((self.plain, plain), (self.whole, other)):
            todo = [w for w in named if w not in self.known]
            self._keep(list(zip(todo, self._encode(how, [named[w] for w in todo]), strict=True)))
        self._keep([(w, self.known[core] + self.known[tail]) for w, core, tail in parted])

    def of_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words in ASCII lower case."""
        if self.held > self.memory:  # the words of one call at most are beyond; of the two generations the older goes
            self.before, self.known, self.held = self.known, {}, 0
        known, before = self.known, self.before
        new = [w for w in words if w not in known]
        self._keep([(w, before[w]) for w in new if w in before])
        self.learn([w for w in new if w not in known])
        return [known[w] for w in words]

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        joined = b"\n".join([*texts, b""]).lower()
        buf = np.frombuffer(joined, np.uint8)
        letter = (buf != 32) & ((buf < 9) | (buf > 13))
        edge = np.diff(letter.view(np.int8), prepend=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # the words without what parts them, as an array of Arrow, which finds the distinct ones
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buf[letter])])
        distinct = words.dictionary_encode()
        each = self.of_words(distinct.dictionary.to_pylist())
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        pool, first = np.frombuffer(b"".join(each), "<u4"), np.cumsum(size) - size
        word = distinct.indices.to_numpy()
        n = size[word]
        upto = np.concatenate([[0], np.cumsum(n)])
        flat = pool[np.arange(upto[-1]) + np.repeat(first[word] - upto[:-1], n)].tobytes()
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cut = (4 * upto[np.searchsorted(starts, begin)]).tolist()
        out = [flat[i:j] for i, j in zip(cut, cut[1:], strict=False)]
        # the names of special tokens are ids of their own in a text
        for k, t in enumerate(texts):
            if b"<|" in t and any(s in t for s in self.special):
                out[k] = self._encode(self.whole, [t.decode("utf-8", "replace")])[0]
        return out

    def stream(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text, so many texts together that a step has about ``step`` bytes."""
        held, size = [], 0
        for t in texts:
            held.append(t)
            size += len(t)
            if size >= self.step:
                yield from self.ids(held)
                held, size = [], 0
        if held:
            yield from self.ids(held)


def pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None, memory: int = MEMORY, step: int = STEP) -> DataFrame:
    """did, piece, start, length, ids_crc32, and task, nth: its place among pieces of its length from its task."""
    path = path or vocabulary()
    name = f"encoder {path} {memory} {step}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = common.memo(name, lambda: Encoder(path, memory, step))
        task, seen = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        end = np.array([END], "<u4").tobytes()
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for r, got in enumerate(encoder.stream(common.raw(b))):
                ids = got + end
                for k, lo in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[lo : lo + 4 * length]
                    n = len(part) // 4
                    for to, x in zip(out, (r, k, lo // 4, n, zlib.crc32(part), seen[n]), strict=True):
                        to.append(x)
                    seen[n] += 1
            did = b.column("did").take(pa.array(out[0], pa.int32()))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([did, *(pa.array(x, k) for x, k in zip(out[1:5], kinds, strict=True)), pa.array(np.full(len(did), task, np.int32)), pa.array(out[5], pa.int64())], ["did", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return common.over(common.keyed(docs), work, "did long, piece int, start long, length long, ids_crc32 long, task int, nth long", keeps=name)


def least_bins(counts: np.ndarray, length: int) -> int:
    """A lower bound on the sequences needed: by total, and by what cannot share one with what."""
    sizes = np.arange(len(counts))
    tokens, number = np.cumsum(counts * sizes), np.cumsum(counts)
    small = np.arange(1, length // 2 + 1)
    alone = number[-1] - number[length - small]  # over length - small: nothing from small on fits beside them
    halves = number[length - small] - number[length // 2]
    half_tokens = tokens[length - small] - tokens[length // 2]
    rest = tokens[length // 2] - tokens[small - 1]
    beside = np.maximum(0, -(-(rest - (halves * length - half_tokens)) // length))
    return max(-(-int(tokens[-1]) // length), int((alone + halves + beside).max(initial=0)))


class Fillings:
    """The undominated fillings of a room, those of least waste first, one after another.

    Depth first for each waste, larger pieces before smaller, and only into sums that the smaller sizes can
    reach. A filling is dominated if a piece that is left fits beside it, or in place of one or two that are
    together no larger than it: in any solution the two could change places."""

    def __init__(self, counts: np.ndarray, room: int):
        self.counts, self.room = counts, room
        self.forget()

    def forget(self) -> None:
        """Give up what can be made again: a branch waits while those below it are tried."""
        self.sizes: list[int] = []
        self.sums: list[int] = []

    def _know(self) -> None:
        if self.sums:
            return
        self.sizes = [int(s) for s in np.flatnonzero(self.counts[: self.room + 1])[::-1] if s]
        # as bits, the sums that the sizes from each on can reach, any number of each
        sums, bits, full = [1], 1, (1 << self.room + 1) - 1
        for s in reversed(self.sizes):
            step = s
            while step <= self.room:
                bits |= bits << step & full
                step *= 2
            sums.append(bits)
        self.sums = sums[::-1]

    def _dominated(self, taken: tuple[int, ...], waste: int) -> bool:
        free = lambda s: self.counts[s] > taken.count(s)
        if any(free(s) for s in self.sizes if s <= waste):
            return True
        alone, two = set(taken), {a + b for i, a in enumerate(taken) for b in taken[:i]}
        return any(free(u) for t in alone for u in range(t + 1, min(t + waste, self.room) + 1)) or any(free(u) for t in two for u in range(t, min(t + waste, self.room) + 1))

    def of(self, waste: int) -> Iterator[tuple[int, ...] | None]:
        """Those of one waste; None in between, for each step that found nothing."""
        stack: list[tuple[int, int, tuple[int, ...]]] = [(0, self.room - waste, ())]
        while stack:
            self._know()
            k, left, taken = stack.pop()
            if not left:
                yield None if self._dominated(taken, waste) else taken
                continue
            if k == len(self.sizes) or not self.sums[k] >> left & 1:
                yield None
                continue
            k = max(k, bisect_left(self.sizes, -left, key=lambda s: -s))
            if k == len(self.sizes):
                yield None
                continue
            size = self.sizes[k]
            stack.append((k + 1, left, taken))
            if self.counts[size] > taken.count(size):
                stack.append((k, left - size, (*taken, size)))


def _times(counts: np.ndarray, pattern: tuple[int, ...]) -> int:
    return min(int(counts[s]) // pattern.count(s) for s in set(pattern))


def best_fit(counts: np.ndarray, length: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (pieces of a sequence, how many sequences)."""
    left, out = counts.copy(), []
    for size in range(length, 0, -1):
        while left[size]:
            pattern, room = [size], length - size
            used = {size: 1}
            while room > 0:
                fits = np.flatnonzero(left[1 : room + 1])[::-1] + 1
                nxt = next((int(s) for s in fits[: len(used) + 1] if left[s] > used.get(int(s), 0)), 0)
                if not nxt:
                    break
                pattern.append(nxt)
                used[nxt] = used.get(nxt, 0) + 1
                room -= nxt
            n = _times(left, tuple(pattern))
            for s in pattern:
                left[s] -= n
            out.append((tuple(pattern), n))
    return out


Plan = list[tuple[tuple[int, ...], int]]


def complete(counts: np.ndarray, length: int, effort: int = EFFORT) -> tuple[Plan, bool]:
    """A plan of few sequences for a histogram of lengths 1 to length, and whether none has fewer.

    Branch and bound, depth first: the largest piece that is left takes each of its undominated fillings in turn,
    first for as many sequences as the counts allow, then for one. A branch ends where its waste, or a bound on what is
    left, shows that it cannot beat the incumbent: best-fit decreasing, of the whole and of what partial plans
    leave. All fillings are branched on; ``effort`` steps bound the search, and so the proof, alone."""
    counts = np.asarray(counts, np.int64)
    total, bound = int((counts * np.arange(len(counts))).sum()), least_bins(counts, length)
    incumbent = best_fit(counts, length)
    best = sum(n for _, n in incumbent)
    steps, seen = 0, {}  # type: int, dict[bytes, int]

    def children(left: np.ndarray, used: int, tokens: int) -> Iterator[tuple[tuple[int, ...], int] | None]:
        size = int(np.flatnonzero(left)[-1])
        rest = left.copy()
        rest[size] -= 1
        options, once = Fillings(rest, length - size), []
        del rest
        search: dict[int, Iterator[tuple[int, ...] | None]] = {}
        ended, turn = set(), 64
        while True:
            # waste that one sequence fewer than the incumbent could still have
            wastes = [w for w in range(min(length - size, (best - 1 - used) * length - tokens) + 1) if w not in ended]
            if not wastes:
                break
            for waste in wastes:  # in turns that grow, for a waste may have very many fillings, or none that the counts allow
                found = search.setdefault(waste, options.of(waste))
                for _ in range(turn):
                    taken = next(found, StopIteration)
                    if taken is StopIteration:
                        ended.add(waste)
                        break
                    if taken is None:
                        yield None
                        continue
                    pattern = (size, *taken)
                    n = _times(left, pattern)
                    if waste:
                        n = min(n, ((best - 1 - used) * length - tokens) // waste)
                    if n > 1:
                        once.append(pattern)
                    if n > 0:
                        options.forget()
                        yield pattern, n
            turn *= 4
        for pattern in once:
            yield pattern, 1

    stack = [(counts, 0, total, children(counts, 0, total))] if total and best > bound else []
    plan: Plan = []
    while stack and best > bound and steps < effort:
        left, used, tokens, more = stack[-1]
        child = next(more, StopIteration)
        steps += 1
        if child is StopIteration:
            stack.pop()
            if plan:
                plan.pop()
            continue
        if child is None:
            continue
        pattern, n = child
        now, tokens, used = left.copy(), tokens - n * sum(pattern), used + n
        for s in pattern:
            now[s] -= n
        if not tokens:
            if used < best:
                incumbent, best = [*plan, child], used
            continue
        steps += 10  # what the bound and the sums of a branch cost, about
        mark = hashlib.blake2b(now.tobytes(), digest_size=16).digest()
        if used + least_bins(now, length) >= best or seen.get(mark, best) <= used:
            continue
        seen[mark] = used
        plan.append(child)
        stack.append((now, used, tokens, children(now, used, tokens)))
        if len(plan) & len(plan) - 1 == 0:  # of partial plans of 1, 2, 4, 8, ... patterns
            rest = best_fit(now, length)
            steps += len(rest)
            if (n := used + sum(x for _, x in rest)) < best:
                incumbent, best = [*plan, *rest], n
    return incumbent, best <= bound or not stack


def places(plan: list[tuple[tuple[int, ...], int]], length: int) -> np.ndarray:
    """Rows (length, rank from, first sequence, offset), sorted: a piece's place is that of the last row not above it."""
    out, taken, first = [], np.zeros(length + 1, np.int64), 0
    for pattern, n in plan:
        offset = 0
        for s in pattern:
            out.append((s, int(taken[s]), first, offset))
            taken[s] += n
            offset += s
        first += n
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def packed(docs: DataFrame, length: int = LENGTH, path: str | None = None, memory: int = MEMORY, step: int = STEP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece. memory, step: bytes of words
    that a worker remembers and of text that it handles at once, memory against time; the result is the same."""
    cut = common.settle(pieces(docs, length, path, memory, step), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = common.settle(by_task.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "counts")
    counts = np.zeros(length + 1, np.int64)
    for size, n in by_task.groupBy("length").agg(F.sum("n")).collect():  # at most one row for each length
        counts[size] = n
    table = places(complete(counts, length)[0], length)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = table[:, 0] << 44 | table[:, 1]
        for b in batches:
            at = b.column("length").to_numpy() << 44 | b.column("rank").to_numpy()
            row = table[np.searchsorted(key, at, "right") - 1]
            sequence = row[:, 2] + b.column("rank").to_numpy() - row[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("did", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(row[:, 3])], ["did", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(by_task.select("length", "task", "before").hint("merge"), ["length", "task"])
    ranked = ranked.select("did", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    out = common.over(ranked, work, "did long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.select(common.doc_id(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

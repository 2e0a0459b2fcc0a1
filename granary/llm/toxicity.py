"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is the sum of hashed embeddings of the word and of its characters: its first 4 to 7
bytes of UTF-8, its last 4, and in two halves all between its first and last 4, so that every byte is in one. The
first of the embedding's columns begins as the naive Bayes odds of its bucket. Two gated recurrent layers read a window forwards and backwards; attention
pools their states into one logit. A document is scored by all its overlapping windows: its
largest logits, smoothed, are calibrated to a probability by a logistic fitted on
labelled rows that took no part in the training of the network.

Labels only come from rows whose crc32(doc_id as text) mod 4 is not 2, at most ``most`` toxic and twice
as many others, chosen by a hash of their ids, and of each kind no more than come to ``volume`` bytes together: that
bounds what reaches the driver. Of several rows of an id the text with the least hash is learned from. The naive
Bayes counts are of whole texts; the network trains on at most ``per_text`` windows of each: of toxic ones, where a
label says nothing of which window made it so, those whose naive Bayes evidence is near that of the strongest, of
others the strongest and some at random. Calibration reads all windows of its rows. Language, source and id are no inputs. Long texts are
windowed like any others, however many windows they have. Scoring covers all words of every document where it is read; nothing is
shuffled. Null, empty and wordless texts score 0; a null id is not held out and its row never trained on; rows that
repeat get equal scores; without any labels of both classes every score is 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW, STEP = 128, 64  # words
BUCKETS, WIDTH, HIDDEN, ATTEND = 1 << 16, 8, 8, 8
PUNCTUATION = b".,;:!?\"'()[]{}|<>*_-"
FEATURES = 8
WORDS = 250_000  # distinct words that a task remembers
THRESHOLD = 0.3
PER_TEXT = 3  # windows of a text that the network trains on
VOLUME = 16 << 20  # bytes of texts of either label to learn from


def features(words: list[bytes]) -> np.ndarray:
    """For each word the buckets of itself, of its first 4 to 7 bytes, of its last 4, and of the halves between."""
    crc, rows = zlib.crc32, []
    for word in words:
        w = word.strip(PUNCTUATION) or word
        inner = w[4:-4]
        half = (len(inner) + 1) // 2
        rows.append((crc(w, 1), crc(w[:4], 2), crc(w[:5], 3), crc(w[:6], 4), crc(w[:7], 5), crc(w[-4:], 6), crc(inner[:half], 7), crc(inner[half:], 8)))
    return np.array(rows, np.int64).reshape(-1, FEATURES) % BUCKETS


def spans(n: int) -> list[tuple[int, int]]:
    """The windows of n words."""
    return [(i, min(n, i + WINDOW)) for i in range(0, max(1, n - WINDOW + STEP), STEP)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, forward pass with what the backward pass needs, and training by Adam."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {"emb": rng.normal(0, 0.05, (BUCKETS, WIDTH)).astype(np.float32)}
        for d in "fb":
            self.p[f"wx{d}"] = (rng.normal(0, 0.4, (WIDTH, 3 * HIDDEN))).astype(np.float32)
            self.p[f"wh{d}"] = (rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))).astype(np.float32)
            self.p[f"b{d}"] = np.zeros(3 * HIDDEN, np.float32)
        self.p["wa"] = rng.normal(0, 0.3, (2 * HIDDEN, ATTEND)).astype(np.float32)
        self.p["va"] = rng.normal(0, 0.3, ATTEND).astype(np.float32)
        self.p["wo"] = rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32)
        self.p["bo"] = np.zeros(1, np.float32)

    def inputs(self, ids: np.ndarray) -> np.ndarray:
        """What each word (a row of feature buckets) adds to the gates of both directions."""
        x = self.p["emb"][ids].sum(axis=1)
        return np.concatenate([x @ self.p["wxf"] + self.p["bf"], x @ self.p["wxb"] + self.p["bb"]], axis=1)

    def run(self, gates: np.ndarray, at: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States of one direction; gates: by word, at: (windows, steps) places in it, mask: whether a step is a word."""
        n, steps = at.shape
        lo = 0 if d == "f" else 3 * HIDDEN
        table = np.ascontiguousarray(gates[:, lo : lo + 3 * HIDDEN])
        h, wh = np.zeros((n, HIDDEN), np.float32), self.p[f"wh{d}"]
        full = bool(mask.all())
        out = np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x = table[at[:, t]]
            u = h @ wh
            zr = 1 / (1 + np.exp(-(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])))
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            new = c + z * (h - c)
            if not full:
                new = np.where(mask[:, t, None], new, h)
            if keep is not None:
                keep.append((t, h, z, r, c, u[:, 2 * HIDDEN :]))
            out[t] = h = new
        return out

    def logits(self, gates: np.ndarray, at: np.ndarray, mask: np.ndarray, cache: dict | None = None) -> np.ndarray:
        keeps = {d: [] if cache is not None else None for d in "fb"}
        h = np.concatenate([self.run(gates, at, mask, d, keeps[d]) for d in "fb"], axis=2)  # steps, windows, states
        a = np.tanh(h @ self.p["wa"])
        e = a @ self.p["va"]
        e = np.where(mask.T, e, np.float32(-1e4))
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", w, h)
        if cache is not None:
            cache.update(h=h, a=a, w=w, pooled=pooled, keeps=keeps)
        return pooled @ self.p["wo"] + self.p["bo"]

    def gradients(self, ids: np.ndarray, at: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, cache = self.p, {}
        gates = self.inputs(ids)
        out = sigmoid(self.logits(gates, at, mask, cache))
        h, a, w, pooled = (cache[k] for k in ("h", "a", "w", "pooled"))
        g = {k: np.zeros_like(v) for k, v in p.items() if k != "emb"}
        dl = ((out - y) / len(y)).astype(np.float32)
        g["wo"], g["bo"] = pooled.T @ dl, dl.sum(keepdims=True)
        dpool = dl[:, None] * p["wo"]
        dh = w[:, :, None] * dpool
        dw = np.einsum("nh,tnh->tn", dpool, h)
        de = w * (dw - (w * dw).sum(axis=0))
        g["va"] = np.einsum("tn,tna->a", de, a)
        da = de[:, :, None] * p["va"] * (1 - a * a)
        g["wa"] = np.einsum("tnh,tna->ha", h, da)
        dh += da @ p["wa"].T
        dgates = np.zeros_like(gates)
        for d, lo in (("f", 0), ("b", HIDDEN)):
            dn = np.zeros((len(y), HIDDEN), np.float32)
            part = slice(0, 3 * HIDDEN) if d == "f" else slice(3 * HIDDEN, 6 * HIDDEN)
            for t, prev, z, r, c, uc in reversed(cache["keeps"][d]):
                total = dn + dh[t, :, lo : lo + HIDDEN]
                m = mask[:, t, None]
                live = np.where(m, total, 0)
                dc = live * (1 - z) * (1 - c * c)
                dz = live * (prev - c) * z * (1 - z)
                dr = dc * uc * r * (1 - r)
                du = np.concatenate([dz, dr, dc * r], axis=1)
                dx = np.concatenate([dz, dr, dc], axis=1)
                g[f"wh{d}"] += prev.T @ du
                np.add.at(dgates[:, part], at[:, t], dx)
                dn = np.where(m, live * z + du @ p[f"wh{d}"].T, total)
            g[f"b{d}"] = dgates[:, part].sum(axis=0)
        x = p["emb"][ids].sum(axis=1)
        g["wxf"], g["wxb"] = x.T @ dgates[:, : 3 * HIDDEN], x.T @ dgates[:, 3 * HIDDEN :]
        dx = dgates[:, : 3 * HIDDEN] @ p["wxf"].T + dgates[:, 3 * HIDDEN :] @ p["wxb"].T
        g["emb"] = (ids, dx)
        return g

    def fit(self, windows: list[np.ndarray], y: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        """windows: feature rows of the words of each."""
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for lo in range(0, len(order), batch):
                at, mask, ids = batched([windows[i] for i in order[lo : lo + batch]])
                g = self.gradients(ids, at, mask, y[order[lo : lo + batch]])
                step += 1
                rate_now = rate * min(1, step / 20) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                rows, dx = g.pop("emb")
                for k, dk in g.items():
                    dk = np.clip(dk, -1, 1)
                    m[k] += 0.1 * (dk - m[k])
                    v[k] += 0.001 * (dk * dk - v[k])
                    self.p[k] -= (rate_now * m[k] / (np.sqrt(v[k]) + 1e-6)).astype(np.float32)
                flat, back = np.unique(rows.ravel(), return_inverse=True)
                de = np.zeros((len(flat), WIDTH), np.float32)
                np.add.at(de, back, np.repeat(dx, FEATURES, axis=0))
                m["emb"][flat] += 0.1 * (de - m["emb"][flat])
                v["emb"][flat] += 0.001 * (de * de - v["emb"][flat])
                self.p["emb"][flat] -= rate_now * 0.5 * m["emb"][flat] / (np.sqrt(v["emb"][flat]) + 1e-6)


def batched(windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, mask and distinct feature rows of windows of any lengths; an empty one is one step that counts as a word of no features' sum."""
    steps = max(1, *(len(w) for w in windows))
    every = np.concatenate([np.zeros((1, FEATURES), np.int64), *windows]).astype(np.int64)
    ids, back = np.unique(every, axis=0, return_inverse=True)
    back = back.ravel()
    at = np.full((len(windows), steps), back[0])
    mask = np.zeros(at.shape, bool)
    k = 1
    for r, w in enumerate(windows):
        at[r, : len(w)] = back[k : k + len(w)]
        mask[r, : max(1, len(w))] = True
        k += len(w)
    return at, mask, ids


def pooled(logits: np.ndarray) -> tuple[float, float]:
    """A document's evidence: the largest logit, and the mean of the larger half."""
    top = np.sort(logits)[::-1]
    return float(top[0]), float(top[: (len(top) + 1) // 2].mean())


class Model:
    """The network with its calibration; ``score`` takes texts as bytes."""

    def __init__(self, net: Network | None, weights: np.ndarray | None = None):
        self.net, self.weights = net, weights
        self.place: dict[bytes, int] = {}
        self.gates = np.zeros((0, 6 * HIDDEN), np.float32)

    def _places(self, words: list[bytes]) -> list[int]:
        place = self.place
        try:
            return [place[w] for w in words]
        except KeyError:
            fresh = [w for w in dict.fromkeys(words) if w not in place]
            if len(self.gates) == 0 or len(place) + len(fresh) > WORDS:
                place.clear()
                fresh = list(dict.fromkeys(words))
                self.gates, self.used = np.zeros((max(WORDS, len(fresh)) + 1, 6 * HIDDEN), np.float32), 1
                self.gates[:1] = self.net.inputs(np.zeros((1, FEATURES), np.int64))
            ids = features(fresh)
            self.gates[self.used : self.used + len(fresh)] = self.net.inputs(ids)
            place.update(zip(fresh, range(self.used, self.used + len(fresh)), strict=True))
            self.used += len(fresh)
            return [place[w] for w in words]

    def window_logits(self, texts: list[bytes]) -> list[np.ndarray]:
        """Logits of all windows of each text; texts go together up to some tens of thousands of words."""
        out: list[np.ndarray] = []
        lo = 0
        split = [t.lower().split() for t in texts]
        while lo < len(split):
            hi, n = lo, 0
            while hi < len(split) and (hi == lo or n + len(split[hi]) <= 100_000):
                n += len(split[hi])
                hi += 1
            out += self._some(split[lo:hi])
            lo = hi
        return out

    def _some(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        if len(docs) == 1 and len(docs[0]) > 100_000:  # a long text goes in parts, whose windows are those of the whole
            words, parts, cut = docs[0], [], 1024 * STEP
            for i in range(0, len(words), cut):
                if i and len(words) - i <= WINDOW - STEP:
                    break
                more = i + cut < len(words) - (WINDOW - STEP)
                got = self._some([words[i : i + cut + (WINDOW - STEP if more else WINDOW)]])[0]
                parts.append(got)
            return [np.concatenate(parts)]
        flat = np.array(self._places([w for d in docs for w in d]) if any(docs) else [], np.int64)
        if not len(self.gates):
            self._places([b""])
        rows: list[tuple[int, int]] = []
        owner: list[int] = []
        base = 0
        for r, d in enumerate(docs):
            got = spans(len(d))
            rows += [(base + i, base + j) for i, j in got]
            owner += [r] * len(got)
            base += len(d)
        edge = np.array(rows)
        size = edge[:, 1] - edge[:, 0]
        logits = np.zeros(len(rows), np.float32)
        order = np.argsort(size, kind="stable")  # alike lengths go together
        for k in range(0, len(order), 1024):
            some = order[k : k + 1024]
            steps = max(1, int(size[some].max()))
            col = np.arange(steps)
            mask = col < np.maximum(1, size[some])[:, None]
            at = edge[some, 0][:, None] + col
            at = np.where(col < size[some][:, None], flat[np.minimum(at, max(0, len(flat) - 1))], 0) if len(flat) else np.zeros(mask.shape, np.int64)
            logits[some] = self.net.logits(self.gates, at, mask)
        cuts = np.flatnonzero(np.diff(owner)) + 1
        return np.split(logits, cuts)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.net is None:
            return np.zeros(len(texts))
        x = np.array([[*pooled(g), 1.0] for g in self.window_logits(texts)]).reshape(-1, 3)
        worded = np.array([bool(t.split()) for t in texts], bool)
        return sigmoid(x @ self.weights) * worded


def held_out(doc: int | None) -> bool:
    return doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2


def fit(rows: list[tuple[int, bytes, int]], per_text: int = PER_TEXT) -> Model:
    """A model from (doc_id, text, label)."""
    rows = sorted(rows)
    if len({y for _, _, y in rows}) < 2:
        return Model(None)
    apart = np.array([zlib.crc32(b"calibrate" + str(d).encode()) % 5 == 0 for d, _, _ in rows])
    if len({y for (_, _, y), a in zip(rows, apart, strict=True) if not a}) < 2:
        apart[:] = False
    net, rng = Network(), np.random.default_rng(3)
    ids = [features(t.lower().split()).astype(np.uint16) for _, t, _ in rows]
    # naive Bayes weights of the buckets start the first embedding dimension, and choose windows
    seen = np.zeros((2, BUCKETS))
    number = np.zeros(2)
    for x, (_, _, y), a in zip(ids, rows, apart, strict=True):
        if not a:
            seen[y, np.unique(x).astype(np.int64)] += 1
            number[y] += 1
    odds = np.log((seen[1] + 0.3) / (number[1] + 0.6)) - np.log((seen[0] + 0.3) / (number[0] + 0.6))
    odds = np.where(seen.sum(axis=0) >= 3, odds, 0)
    net.p["emb"][:, 0] += np.clip(odds, -1, 4).astype(np.float32) * 0.3
    windows, y = [], []
    for x, (_, _, label), a in zip(ids, rows, apart, strict=True):
        if a:
            continue
        at = spans(len(x))
        weight = np.array([np.clip(odds[x[i:j]].max(axis=1, initial=0), 0, None).sum() if j > i else 0 for i, j in at])
        best = np.argsort(-weight)[: per_text if label else 1].tolist()
        if not label:
            best += rng.choice(len(at), min(per_text - 1, len(at)), replace=False).tolist()
        for k in dict.fromkeys(best):
            if not label or weight[k] >= 0.7 * weight[best[0]]:
                windows.append(x[at[k][0] : at[k][1]])
                y.append(label)
    # few rows see many epochs, many see few
    net.fit(windows, np.array(y, np.float32), epochs=int(np.clip(12_000 // max(1, len(windows)), 2, 12)))
    model = Model(net)
    use = apart if len({y for (_, _, y), a in zip(rows, apart, strict=True) if a}) == 2 else np.ones(len(rows), bool)
    logits = model.window_logits([t for (_, t, _), a in zip(rows, use, strict=True) if a])
    x = np.array([[*pooled(g), 1.0] for g in logits])
    truth = np.array([y for (_, _, y), a in zip(rows, use, strict=True) if a], float)
    model.weights = calibrated(x, truth)
    return Model(net, model.weights)


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights by Newton's method, drawn towards a plain reading of the largest logit."""
    prior = np.array([0.7, 0.3, 0.0])
    strength = np.array([ridge, ridge, 1e-3])
    w = prior.copy()
    for _ in range(30):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + strength * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(strength)
        w = w - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return w


def labelled(docs: DataFrame, labels: DataFrame, most: int = 2000) -> DataFrame:
    """doc_id, text, toxic of the rows to learn from: at most so many toxic and twice as many others, by a hash of the id."""
    may = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    may = may.where("doc_id is not null and toxic in (0, 1)").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [may.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((0, 2 * most), (1, most))]
    chosen = parts[0].unionByName(parts[1])  # at most 3 * most rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id")


def trained(docs: DataFrame, labels: DataFrame, most: int = 2000, volume: int = VOLUME, per_text: int = PER_TEXT) -> Model:
    rows = labelled(docs, labels, most).select("doc_id", F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"), "toxic")
    rows = common.settle(rows, "labelled")
    # a row of numbers for each id, so many in order of their hash as come to the volume
    each = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct("h", F.octet_length("text").alias("n"))).alias("one"))
    wanted: list[tuple[int, int]] = []
    for y in (0, 1):
        left = volume
        for doc, (h, n) in each.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "one").collect():
            if n <= left:
                left -= n
                wanted.append((doc, h))
    chosen = docs.sparkSession.createDataFrame(wanted, "doc_id long, h long")
    once = rows.join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    return fit([(d, bytes(t), y) for d, t, y in once.select("doc_id", "text", "toxic").toLocalIterator()], per_text)


def scored(docs: DataFrame, model: Model, carry: Sequence[str] | None = None) -> DataFrame:
    """doc_id, h, held_out, score, predicted of every document; with ``carry`` also its text and those columns as x_<name>."""
    sent = docs.sparkSession.sparkContext.broadcast((model.net and model.net.p, model.weights))  # a few MB, of fixed size
    rows = common.keyed(docs, carry or ())
    extra = [] if carry is None else [f for f in rows.schema.fields if f.name not in ("did", "h")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, weights = sent.value
        net = None
        if params is not None:
            net = Network.__new__(Network)
            net.p = params
        model = Model(net, weights)
        for b in batches:
            texts, got = common.raw(b), []
            for k in range(0, len(texts), 256):
                got.append(model.score(texts[k : k + 256]))
            score = pa.array(np.concatenate(got) if got else np.zeros(0))
            yield pa.RecordBatch.from_arrays([b.column("did"), b.column("h"), score, *(b.column(f.name) for f in extra)], ["did", "h", "score", *(f.name for f in extra)])

    own = T._parse_datatype_string("did long, h long, score double")
    out = common.over(rows, work, T.StructType([*own.fields, *extra]))
    id_ = common.doc_id()
    held = F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    return out.select(id_, "h", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *(f.name for f in extra))

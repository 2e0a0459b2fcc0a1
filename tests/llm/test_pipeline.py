"""The stages one after another against brute force on what each was given, and run() against them."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline as pipeline  # noqa: E402
from granary.llm import components, decontam, line_dedup, minhash, packing, simhash  # noqa: E402

COLUMNS = list(pipeline.COLUMNS)
WORDS = [a + b for a in ("ba", "do", "ri", "ke", "lu", "ö") for b in ("n", "st", "mo", "x")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(20)
    item = prose(rng, 40)
    shared = "a line that many documents hold " + prose(rng, 4)
    rows = []
    for k in range(120):
        words = prose(rng, rng.randint(40, 160)).split()
        if k % 4 == 0:
            for _ in range(len(words) // 10):
                words.insert(rng.randrange(len(words)), "vile")
        text = " ".join(words)
        if k % 5 == 1:
            text = f"{shared}\n{text}\n{shared}"
        if k % 20 == 2:
            text = f"{text} {item} {prose(rng, 20)}"
        rows.append((k, text))
    near = prose(rng, 500).split()
    for k in range(5):
        words = list(near)
        words[50 * k] = "changed"
        rows.append((200 + k, " ".join(words)))
    rows += [(300, None), (301, ""), (302, None), (303, rows[3][1]), (3, rows[3][1]), (304, prose(rng, 6000))]
    docs = [(d, t, "en", "s", len(t or "")) for d, t in rows]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS h", "2 AS did", "'x' AS key_did").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 0, int(k % 4 == 0)) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, prose(rng, 30))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages(spark, corpus, tmp_path):
    at = {}
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        at[name] = docs
        out = stage(spark, docs, corpus)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == COLUMNS
    given = {n: [(r.doc_id, r.text) for r in df.collect()] for n, df in at.items()}
    # toxic documents go, nearly all and nearly only they
    kept = {d for d, _ in given["line dedup"]}
    bad = {k for k in range(120) if k % 4 == 0}
    assert len(bad & kept) <= 3 and len({d for d, _ in given["toxicity"]} - bad - kept) <= 3
    # lines
    want = line_dedup.brute({d: (t or "").encode() for d, t in given["line dedup"]})
    import hashlib

    got = {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in given["near-dedup"]}
    assert got == {d: x[2] for d, x in want.items()} and sum(x[1] for x in want.values()) > 5
    assert all(r.n_chars == len(r.text or "") for r in at["near-dedup"].collect() if r.doc_id in want and want[r.doc_id][1])
    # one of each group of near-duplicates: nulls and empty texts are one such group
    left = {d for d, _ in given["decontamination"]}
    assert len(left & {200, 201, 202, 203, 204}) == 1 and len(left & {300, 301, 302}) == 1 and 303 not in left and len(given["decontamination"]) == len(left)
    # leaks
    assert {d for d, _ in given["decontamination"]} - {d for d, _ in given["packing"]} == {d for d in left if d < 120 and d % 20 == 2}
    # pieces
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary())
    pieces = []
    for d, t in given["packing"]:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        pieces += [(d, k // 2048, k, len(x := ids[k : k + 2048]), zlib.crc32(np.array(x, "<u4").tobytes())) for k in range(0, len(ids), 2048)]
    assert rows_of(docs.select("doc_id", "piece", "start", "length", "ids_crc32")) == sorted(pieces, key=str)
    assert rows_of(pipeline.run(spark, corpus).select("doc_id", "piece", "length", "ids_crc32")) == rows_of(docs.select("doc_id", "piece", "length", "ids_crc32"))


def test_stages_take_empty_tables(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0


def near_of(spark, rows, tmp_path):
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return [(r.doc_id, r.text) for r in pipeline.near(spark, docs, str(tmp_path)).collect()]


def test_near_dedup_leaves_one_of_a_group(spark, tmp_path):
    rng = random.Random(5)
    rows, other = [], [(300 + k, prose(rng, 500)) for k in range(5)]
    for group, edits in enumerate((1, 3, 5)):  # pairs have similarities of 0.96, 0.89 and 0.82
        base = [f"{prose(rng, 1)}{k}" for k in range(500)]
        for k in range(5):
            words = list(base)
            for x in range(edits):
                words[50 * x + 7 * k] = f"changed{k}"
            rows.append((10 * group + k, " ".join(words)))
    far = [f"{prose(rng, 1)}{k}" for k in range(500)]
    other += [(400, " ".join(far)), (401, " ".join("changed" if k % 10 == 3 else w for k, w in enumerate(far)))]  # 0.33
    got = near_of(spark, rows + other, tmp_path)
    assert sorted(d for d, _ in got) == [0, 10, 20, *sorted(d for d, _ in other)]


def test_near_dedup_links_are_those_of_brute_force(spark, docs):
    rng = random.Random(6)
    base = [f"{prose(rng, 1)}{k}" for k in range(120)]
    texts = ["", " ", "one two", "ONE  two"]
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(120)] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    held = [set(decontam.shingled(t.encode().lower().split())[0].tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(held[i] & held[j])
            if both >= 0.8 * (len(held[i]) + len(held[j]) - both) and root[i] != root[j]:
                root = [root[j] if x == root[i] else x for x in root]
    got = {r.did: r.root for r in simhash.near_duplicates(docs(texts), size=5, least=0.8).collect()}
    assert len(set(zip(root, (got[k] for k in range(len(texts))), strict=True))) == len(set(root)) == len(set(got.values())) > 4


@pytest.mark.parametrize("block", [1 << 19, 400])
def test_links_of_a_bucket(spark, block):
    """All of different components are compared, in however many blocks."""
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 60, np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 60 - k % 14, replace=False), rng.integers(0, 1 << 63, k % 9, np.uint64)])) for k in range(70)]
    root = [k % 11 for k in range(70)]
    left = spark.createDataFrame([(5, k, len(x), root[k]) for k, x in enumerate(sets)] + [(6, 1, 50, 1), (6, 2, 50, 2)], "bucket long, node long, n long, root long")
    held = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(sets)], "node long, held binary")
    tree = {r.node: r.root for r in components.components(minhash.compared(left, held, 0.8, block)).collect()}
    low = list(range(70))
    for _ in range(70):
        for i in range(70):
            for j in range(i):
                same = len(np.intersect1d(sets[i], sets[j]))
                if root[i] != root[j] and same >= 0.8 * (len(sets[i]) + len(sets[j]) - same) and low[i] != low[j]:
                    low[i] = low[j] = min(low[i], low[j])
    assert [tree.get(k, k) for k in range(70)] == low and 1 < len(set(low)) < 70


def test_near_dedup_keeps_unlike_documents_of_one_id(spark, tmp_path):
    rng = random.Random(7)
    texts = [prose(rng, 60) for _ in range(6)]
    rows = [*((None, t) for t in texts[:4]), (None, texts[0]), (8, texts[4]), (8, texts[5]), (8, texts[5]), (9, texts[5]), (7, texts[1])]
    got = near_of(spark, rows, tmp_path)
    assert sorted(got, key=str) == sorted([*((None, t) for t in texts[:4]), (8, texts[4]), (8, texts[5])], key=str)

from __future__ import annotations

import pyarrow as pa
from granary.llm import common


def test_slices_hold_all_rows(monkeypatch):
    monkeypatch.setattr(common, "SLICE", 100)
    batch = pa.RecordBatch.from_arrays([pa.array([f"text {k}" * 5 for k in range(50)])], ["text"])
    parts = list(common.sliced(iter([batch, batch.slice(0, 0), batch.slice(3, 1)])))
    assert len(parts) > 10 and [t for p in parts for t in common.raw(p)] == common.raw(batch) + common.raw(batch.slice(3, 1))


def test_memos():
    made = []
    assert common.memo("a", lambda: made.append(1) or "x") == common.memo("a", lambda: made.append(1) or "y") == "x"
    common.memo("b", lambda: 2)
    common.forget("b")
    assert common.memo("b", lambda: 3) == 2 and common.memo("a", lambda: "new") == "new" and made == [1]
    common.forget()


def test_keys(docs):
    rows = common.keyed(docs([(1, "a"), (None, "a"), (2, None), (3, "")])).collect()
    assert [r.did for r in rows] == [1, common.NULL_ID, 2, 3] and rows[2].h == rows[3].h != rows[0].h and rows[2].text == ""


def test_settled_tables_are_the_same(spark, docs):
    df = common.keyed(docs(["a", "b", None]))
    got = common.settle(df, "t")
    assert got.schema.names == df.schema.names and sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    kept = common.settle_bucketed(df, "t", ["did", "h"], 3)
    assert kept.count() == 3 and common.settle(df.limit(0), "t").count() == 0


def test_packed_texts_come_back(docs):
    df = common.keyed(docs(["a" * 1000, "", "é"]))
    unpack = common.unpacker()
    assert sorted(unpack(bytes(r.z)).decode() for r in common.packed(df).collect()) == sorted(["a" * 1000, "", "é"])

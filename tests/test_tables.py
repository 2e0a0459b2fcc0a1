"""Stored tables: writing, positions, truncation, columns, types, Arrow, indexes, validation, streams."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pytest
from granary import (
    ColumnSpec, ConformanceError, Deflate, FillValueError, FilterError, FixedString, GranaryError, LeafValues, ListColumnSpec, NestedList, Opaque, OversizedStringError,
    ReservedNameError, SchemaError, Shuffle, StaleIndexError, StringValues, Table, TableSpec, VersionError, field, is_missing, opaque_fill_bytes, over, recommended_fill,
    specs_from_arrow, validate_fill_outside_range,
)
from granary.functions import specs as sp
from granary.functions import types as ty
from granary.sources import arrow_io, paths
from pyspark.sql import functions as F


@pytest.fixture
def where(tmp_path):
    return str(tmp_path / "table")


def make(spark, where, n=20, **kw):
    specs = [ColumnSpec("x", "int64", fill_value=-1), ColumnSpec("s", FixedString(6)), ColumnSpec("ok", "bool")]
    return Table.from_arrays(spark, where, rows(0, n), specs, **kw)


def rows(lo, hi):
    return {"x": list(range(lo, hi)), "s": [f"r{k}" for k in range(lo, hi)], "ok": [k % 2 == 0 for k in range(lo, hi)]}


# names, fills, specifications


def test_helpers():
    assert [recommended_fill(d) for d in ("int8", "uint64", "float32", str, "S4")] == [-127, 2**64 - 1, 9.969209968386869e36, "", ""]
    assert recommended_fill("V6") == opaque_fill_bytes(6) == b"FILL\x01\x02" and opaque_fill_bytes(2) == b"FI"
    assert is_missing(np.array([1.0, np.nan]), np.nan).tolist() == [False, True] and is_missing([1, 2], 2).tolist() == [False, True] and not is_missing([1], None).any()
    for bad in ("float16", "bool"):
        with pytest.raises(FillValueError):
            recommended_fill(bad)
    validate_fill_outside_range(-1, 0, 5)
    validate_fill_outside_range(float("nan"), 0, 5)
    for args in ((3, 0, 5), (3, None, 5), (3, 1, None)):
        with pytest.raises(FillValueError):
            validate_fill_outside_range(*args)
    assert [ty.choose_code_dtype(n) for n in (0, 128, 129, 40000)] == ["int8", "int8", "int16", "int32"]
    assert FixedString(4).decode(FixedString(4).encode("ab")) == "ab"
    with pytest.raises(OversizedStringError):
        FixedString(2).encode("é€")


def test_specifications():
    for bad in (
        lambda: ColumnSpec("a/b", "int8"), lambda: ColumnSpec("", "int8"), lambda: ColumnSpec("VALUES", "int8"), lambda: ColumnSpec("__pos", "int8"), lambda: ColumnSpec("a", "complex64"),
        lambda: ColumnSpec("a", "bool", fill_value=True), lambda: ColumnSpec("a", "int8", fill_value=300), lambda: ColumnSpec("a", "int8", fill_value=5, valid_min=0, valid_max=9),
        lambda: ColumnSpec("a", "int8", categories=["x", "x"]), lambda: ColumnSpec("a", "float32", categories=["x"]), lambda: ColumnSpec("a", "int8", categories=["x"], fill_value=0),
        lambda: ColumnSpec("a", "int8", ordered=True), lambda: ColumnSpec("a", "float16"), lambda: ColumnSpec("a", "int8", attributes={"units": "m"}), lambda: ColumnSpec("a", "int8", attributes={"CLASS": 1}),
        lambda: LeafValues("bool", fill_value=1), lambda: NestedList("int8"), lambda: ListColumnSpec("l", "int8"), lambda: Deflate(11), lambda: ColumnSpec("a", "int8", filters=(Shuffle(), Shuffle())),
        lambda: TableSpec([ColumnSpec("a", "int8"), ColumnSpec("A", "int8")]), lambda: TableSpec([ColumnSpec("a", "int8")], column_order=["b"]), lambda: TableSpec([ListColumnSpec("l", LeafValues("int8"))], index_columns=["l"]),
    ):
        with pytest.raises(SchemaError):
            bad()
    with pytest.raises(ReservedNameError):
        ColumnSpec("GENERATION", "int8")
    with pytest.raises(FilterError):
        Deflate(-1)
    full = TableSpec(
        [
            ColumnSpec("a", "float32", fill_value=float("nan"), units="m", units_vocabulary="udunits", description="d", valid_min=0.0, valid_max=2.0, attributes={"who": "me"}, filters=(Shuffle(), Deflate(3)), chunks=7),
            ColumnSpec("c", None, categories=[10, 20], ordered=True), ColumnSpec("o", Opaque(3)), ColumnSpec("u", "uint64"), ListColumnSpec("l", NestedList(StringValues(True), nullable=True), nullable=True),
            ListColumnSpec("m", LeafValues("float64", float("inf"))),
        ], title="t", index_columns=["c"], column_order=["u", "a", "c", "o", "l", "m"], chunk_rows=3, attributes={"x": 1},
    )
    again = sp.table_from_json(json.loads(json.dumps(sp.table_to_json(full))))
    assert sp.table_to_json(again) == sp.table_to_json(full) and again.ordered_names[0] == "u" and again.column("c").dtype == "int8"


# writing and truncating


def test_append_and_truncate(spark, where):
    t = make(spark, where, title="T")
    assert (t.nrows, t.generation, t.title, len(t), list(t), "x" in t) == (20, None, "T", 3, ["x", "s", "ok"], True)
    t.truncate(8)
    t.append(rows(100, 103))
    t.append({"x": [None, -1, np.ma.masked], "ok": [1, 0, True]})
    want = [*range(8), 100, 101, 102, None, None, None]
    assert t["x"].read().tolist() == want and t["s"].read().tolist()[-4:] == ["r102", None, None, None]
    assert t.read(["x"], masked=False)["x"].tolist() == [-1 if v is None else v for v in want]
    assert t.read(["s"], masked=False)["s"].tolist()[-1] == ""
    assert t["x"].is_missing().tolist() == [v is None for v in want]
    t.truncate(2)
    t.truncate(2)
    t.append(rows(7, 8))
    assert Table.open(spark, where)["x"].read().tolist() == [0, 1, 7]
    t.truncate(0)
    assert t.read()["x"].tolist() == [] and t.count() == 0
    t.validate(deep=True)
    for bad in (-1, 5, True, 1.0):
        with pytest.raises(SchemaError):
            t.truncate(bad)
    assert t.vacuum() >= 1 and Table.open(spark, where).nrows == 0


def test_failed_writes_change_nothing(spark, where):
    t = make(spark, where)
    before = paths.names(spark, f"{where}/data")
    for bad, kind in (
        ({"x": [1], "s": ["toolong"], "ok": [True]}, OversizedStringError), ({"x": [1], "s": ["éééé"], "ok": [True]}, OversizedStringError), ({"x": [1], "ok": [2]}, SchemaError), ({"x": [1], "ok": [None]}, SchemaError),
        ({"x": [1]}, SchemaError), ({"x": [1, 2], "ok": [True]}, SchemaError), ({"nope": [1], "ok": [True]}, SchemaError), ({"x": ["a"], "ok": [True]}, SchemaError), ({"x": [2.5], "ok": [True]}, SchemaError), ({"x": [2**63], "ok": [True]}, SchemaError),
    ):
        with pytest.raises(kind):
            t.append(bad)
    assert Table.open(spark, where).nrows == 20 and paths.names(spark, f"{where}/data") == before
    other = Table.open(spark, where)
    other.append(rows(20, 21))
    with pytest.raises(GranaryError, match="first"):
        t.append(rows(50, 51))
    assert t.refresh().nrows == 21 and t["x"].read().tolist()[-1] == 20
    with pytest.raises(SchemaError):
        Table.create(spark, where, t.spec)
    assert Table.is_table(spark, where) and not Table.is_table(spark, where + "x")
    with pytest.raises(ConformanceError):
        Table.open(spark, where + "x")


def test_storage_hints(spark, where):
    spec = TableSpec([ColumnSpec("x", "int64", filters=(Shuffle(), Deflate(3), sp.Fletcher32()))], default_chunk_bytes=2048, encoding_type="dataframe", encoding_version="0.2", units_vocabulary="udunits")
    t = Table.create(spark, where, spec)
    t.append(spark.range(20000).select(F.col("id").alias("x")))
    import glob

    import pyarrow.parquet as pq

    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{where}/data/*/*.parquet")]
    assert sum(m.num_row_groups for m in files) > len(files) and files[0].row_group(0).column(1).compression == "ZSTD"
    again = Table.open(spark, where)
    assert again.encoding == ("dataframe", "0.2") and again.units_vocabulary == "udunits" and again["x"].build_index().name in again.refresh()["x"].search_indexes


def test_values():
    from granary.functions import values as v

    assert v.encode_bool([True, 0, 1.0]).tolist() == [1, 0, 1] and v.decode_bool([1, 0]).tolist() == [True, False]
    for bad in ([2], [np.nan], ["a"], np.ma.masked_array([1], [True])):
        with pytest.raises(SchemaError):
            v.encode_bool(bad)
    with pytest.raises(ConformanceError):
        v.decode_bool([3])
    assert v.min_max([3.0, np.nan, -1.0, 9.0], 9.0) == (-1.0, 3.0) and v.min_max([np.nan]) is None and v.min_max(np.array(["b", "é", "a"])) == ("a", "é")
    assert v.is_bool_dtype("?") and v.is_opaque_dtype("V3") and v.is_fixed_string("S3") and not v.is_fixed_string("nope") and v.is_orderable("f4") and not v.is_orderable("V3")
    assert v.normalize_strings(["a \0", b"b"], True) == [b"a", b"b"] and v.n_categories(ColumnSpec("c", None, categories=["a"])) == 1


def test_later_version(spark, where):
    t = make(spark, where, 2)
    paths.create_text(spark, f"{where}/manifest/{t.number + 1:010d}.json", json.dumps(t.manifest | {"version": "2.0"}))
    with pytest.raises(VersionError):
        Table.open(spark, where)


def test_failed_creation_leaves_nothing(spark, where):
    with pytest.raises(SchemaError):
        Table.from_arrays(spark, where, {"x": [1, 2], "s": ["a", 3]}, [ColumnSpec("x", "int8"), ColumnSpec("s", FixedString(2))])
    assert not paths.exists(spark, where)


def test_dataframe_append(spark, where):
    """Many partitions are numbered without a global sort, and checks hold for each row."""
    t = Table.create(spark, where, [ColumnSpec("id", "int32"), ColumnSpec("v", "float64"), ColumnSpec("k", None, categories=["a", "b"])])
    df = spark.range(0, 1000, 1, 7).select(F.col("id").alias("id"), (F.col("id") / 2).alias("v"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("k"))
    assert t.append(df) == 1000 and t["id"].read().tolist() == list(range(1000))
    t.append(df.limit(3))
    assert t.nrows == 1003 and t.read_rows([1000, 1002])["id"].tolist() == [0, 2]
    for bad, kind in ((df.withColumn("k", F.lit("z")), SchemaError), (df.withColumn("id", F.lit(2**40)), SchemaError)):
        with pytest.raises(kind):
            t.append(bad)
    assert Table.open(spark, where).nrows == 1003
    assert t.df.schema["k"].metadata["granary"]["categories"] == ["a", "b"]
    assert t.df.groupBy("k").count().count() == 2


def test_add_column(spark, where):
    t = make(spark, where, 3)
    t.add_column(ColumnSpec("n", "float32", units="m"))
    t.append(rows(3, 4) | {"n": [1.5]})
    assert t["n"].read().tolist() == [None, None, None, 1.5] and t["n"].units == "m" and t.column_names == ["x", "s", "ok", "n"]
    for bad in (ColumnSpec("n", "int8"), ColumnSpec("b", "bool"), ListColumnSpec("l", LeafValues("int8"), nullable=True)):
        with pytest.raises(SchemaError):
            t.add_column(bad)


# types


def test_types_round_trip(spark, where):
    specs = [ColumnSpec(f"c_{d}", d) for d in ("int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float32", "float64")]
    specs += [ColumnSpec("h", "float16", fill_value=float("nan")), ColumnSpec("cat", "int16", categories=["lo", "hi"]), ColumnSpec("num", None, categories=[10, 20]), ColumnSpec("raw", "V2"), ColumnSpec("free", "string"), ColumnSpec("b", "bool")]
    data = {c.name: [1, None, 3] for c in specs[:10]} | {"h": [0.5, None, float("nan")], "cat": ["hi", None, "lo"], "num": [20, 10, None], "raw": [b"ab", None, b"\0\0"], "free": ["x" * 100, "", None], "b": [True, 0, 1.0]}
    data["c_uint64"] = [2**64 - 2, None, 2**63]
    t = Table.from_arrays(spark, where, data, specs)
    got = t.read()
    for c in specs[:10]:
        assert got[c.name].dtype == np.dtype(c.dtype) and got[c.name].tolist() == data[c.name]
    assert got["h"].tolist() == [0.5, None, None] and got["cat"].tolist() == ["hi", None, "lo"] and got["num"].tolist() == [20, 10, None]
    assert got["raw"].tolist() == [b"ab", None, b"\0\0"] and got["free"].tolist() == ["x" * 100, None, None] and got["b"].tolist() == [True, False, True]
    assert t["cat"].codes.tolist() == [1, -1, 0] and t["cat"].codes.dtype == np.int16 and t["cat"].categories == ["lo", "hi"]
    assert t.select(field("c_uint64") > 2**63).count() == 1 and t.select(field("num") == 20).count() == 1
    assert t["b"].fill_value is None and t["b"].is_boolean and t["c_int8"].fill_value == -127
    with pytest.raises(SchemaError):
        t["free"].codes  # noqa: B018
    for bad in ({"cat": ["mid"]}, {"raw": [b"abc"]}, {"c_uint8": [-1]}, {"num": [11]}):
        with pytest.raises(SchemaError):
            t.append(bad | {"b": [True]})


def test_bad_code_is_an_error(spark, where):
    df = spark.createDataFrame([(0, 0), (1, 7)], "p long, cat int")
    t = Table.create(spark, where, [ColumnSpec("cat", None, categories=["a"])])
    from granary.sources.frame import Reader

    broken = Reader(spark, t.spec, df.select(F.col("p").alias("__pos"), F.col("cat").cast("byte").alias("cat")))
    with pytest.raises(Exception, match="no label for code 7"):
        broken.read()
    with pytest.raises(ConformanceError):
        broken.to_arrow()


def test_lists(spark, where):
    specs = [ListColumnSpec("r", LeafValues("float32", -999.0), nullable=True), ListColumnSpec("tags", StringValues()), ListColumnSpec("some", StringValues(nullable=True)), ListColumnSpec("m", NestedList(LeafValues("int64"))), ListColumnSpec("f", LeafValues("bool"))]
    data = {"r": [[0.5, -999.0, None], None, []], "tags": [["a", ""], ["g"], []], "some": [["a", None], [], [None]], "m": [[[1, 2], [3]], [[4]], []], "f": [[True], [], [False, True]]}
    t = Table.from_arrays(spark, where, data, specs)
    want = data | {"r": [[0.5, None, None], None, []]}
    assert t.read() == want and t["r"].is_missing().tolist() == [False, True, False]
    assert t.read_rows([2, 0, 0])["m"] == [data["m"][2], data["m"][0], data["m"][0]] and t["tags"][1] == ["g"] and t["r"][-2] is None and t["r"].nullable
    assert t["tags"].to_arrow().type == pa.large_list(pa.large_string()) and t["m"].to_arrow([0, 2]).to_pylist() == [data["m"][0], []]
    t.validate()
    for bad in ({"tags": [None]}, {"tags": [["a", None]]}, {"m": [[None]]}, {"f": [[None]]}, {"f": [[2]]}):
        with pytest.raises(SchemaError):
            t.append({"r": [[]], "tags": [[]], "some": [[]], "m": [[]], "f": [[]]} | bad)


# positions


def test_positions(spark, where):
    n = 40
    t = Table.from_arrays(spark, where, {"num": [None if k % 5 == 0 else k for k in range(n)]}, [ColumnSpec("num", "int32")])
    t.append({"num": list(range(n, n + 4))})
    whole = t["num"].read()
    c = t["num"]
    for s in (slice(None), slice(3, 9), slice(None, None, -1), slice(30, 2, -7), slice(-5, None), slice(5, 5), slice(100, 200), slice(1, None, 6)):
        assert c[s].tolist() == whole[s].tolist() and t.rows_at(s).collect() == [(v,) for v in whole[s].tolist()]
    for p in ([0, 3, 3, -1], [], np.array([43, 0, 7])):
        assert c.read_rows(p).tolist() == whole[np.asarray(p, int)].tolist()
    mask = np.arange(n + 4) % 3 == 1
    assert c[mask].tolist() == whole[mask].tolist() and t.read_rows(mask)["num"].tolist() == whole[mask].tolist()
    assert c[1] == 1 and c[0] is np.ma.masked and c[-1] == 43 and c[np.int8(2)] == 2 and list(c)[:3] == [None, 1, 2] and len(c) == 44
    for bad, kind in (((0, 1), IndexError), (44, IndexError), (-45, IndexError), (True, TypeError), (1.5, TypeError), (slice(None, None, 0), ValueError), ([True] * 3, IndexError), ([1.5], TypeError), ([[1]], Exception), ([99], IndexError)):
        with pytest.raises(kind):
            c[bad]
    with pytest.raises(KeyError):
        t["nope"]
    with pytest.raises(KeyError):
        t.read(["nope"])


def test_foreign_frames(spark):
    df = spark.createDataFrame([(2, "b", 5.0), (0, "a", -9.0), (1, None, float("nan"))], "pos int, k string, v double")
    t = over(df, [ColumnSpec("k", None, categories=["b", "a"]), ColumnSpec("v", "float64", fill_value=-9.0)], "pos")
    assert t.read()["k"].tolist() == ["a", None, "b"] and t.select(field("k") > "b").row_positions.tolist() == [0] and t.select(~(field("v") > 7)).row_positions.tolist() == [1, 2]
    with pytest.raises(ConformanceError):
        over(df, [ColumnSpec("nope", "int8")], "pos")


# Arrow


def test_arrow_round_trip(spark, tmp_path):
    fields = {
        **{f"n_{k}": pa.array([1, None, 3], getattr(pa, k)()) for k in ("int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float32", "float64")},
        "b": pa.array([True, False, True]), "s": pa.array(["é", None, "long"], pa.large_string()), "cat": pa.DictionaryArray.from_arrays(pa.array([0, None, 1], pa.int8()), pa.array(["p", "q"], pa.large_string())),
        "ord": pa.DictionaryArray.from_arrays(pa.array([1, 0, None], pa.int32()), pa.array([10, 20]), ordered=True), "o": pa.array([b"12345678", None, b"x" * 8], pa.binary(8)),
        "lo": pa.array([[b"1234", None], None, []], pa.large_list(pa.binary(4))), "ln": pa.array([[1.0, None], None, []], pa.large_list(pa.float64())), "ls": pa.array([["a", None], [], ["b"]], pa.large_list(pa.large_string())),
        "lb": pa.array([[True], [], [False]], pa.large_list(pa.bool_())), "ll": pa.array([[[1], []], [], [[2, 3]]], pa.large_list(pa.large_list(pa.int64()))),
    }
    table = pa.table(fields)
    meta = {"granary.units": "degC", "granary.valid_min": "-80", "granary.description": "air", "mine": "x"}
    table = table.set_column(0, table.schema.field(0).with_metadata(meta), table.column(0))
    t = Table.from_arrow(spark, str(tmp_path / "a"), table)
    out = t.to_arrow()
    assert out.equals(table) and out.schema.field(0).metadata == {k.encode(): v.encode() for k, v in meta.items()}
    assert t["n_int8"].units == "degC" and t["n_int8"].valid_min == -80 and t["n_int8"].attributes == {"mine": "x"} and t["ord"].ordered
    again = Table.from_arrow(spark, str(tmp_path / "b"), out).to_arrow()
    assert again.equals(out, check_metadata=True)
    assert t.to_arrow(["s"], where=field("cat") == "q").to_pylist() == [{"s": "long"}] and t.select(field("b") == False).to_arrow(["n_int8"]).num_rows == 1  # noqa: E712
    assert t["s"].to_arrow(slice(None, None, -1)).to_pylist() == ["long", None, "é"]


def test_arrow_batches(spark, tmp_path):
    """Batches on the executors are those of to_arrow, and come back as the same table, in order."""
    n = 500
    some = lambda k, x: None if k % 7 == 3 else x
    fields = {
        **{f"n_{kind}": pa.array([some(k, k % 100) for k in range(n)], getattr(pa, kind)()) for kind in ("int8", "int64", "uint16", "uint64", "float32")},
        "h": pa.array(np.arange(n, dtype="float16")), "b": pa.array([k % 3 == 0 for k in range(n)]), "s": pa.array([some(k, "é" * (k % 11)) for k in range(n)], pa.large_string()), "o": pa.array([some(k, k.to_bytes(8, "big")) for k in range(n)], pa.binary(8)),
        "cat": pa.DictionaryArray.from_arrays(pa.array([some(k, k % 2) for k in range(n)], pa.int8()), pa.array(["p", "q", "never"], pa.large_string())), "ord": pa.DictionaryArray.from_arrays(pa.array([k % 2 for k in range(n)], pa.int32()), pa.array([10, 20]), ordered=True),
        "lo": pa.array([some(k, [b"1234", None]) for k in range(n)], pa.large_list(pa.binary(4))), "ls": pa.array([["a", None] if k == 499 else [] for k in range(n)], pa.large_list(pa.large_string())),
        "lb": pa.array([[True] * (k % 2) for k in range(n)], pa.large_list(pa.bool_())), "ll": pa.array([[[k], None] if k == 1 else [[]] for k in range(n)], pa.large_list(pa.large_list(pa.int64()))), "ln": pa.array([[float("nan"), None] if k == 498 else [k] for k in range(n)], pa.large_list(pa.float64())),
    }
    table = pa.table(fields)
    table = table.set_column(0, table.schema.field(0).with_metadata({"granary.units": "degC", "mine": "x"}), table.column(0))
    spread = Table.from_arrow(spark, str(tmp_path / "a"), table)
    for k in range(3):  # parts, so that there are several partitions
        spread.append(table)
    whole, out = spread.to_arrow(), spread.to_arrow_batches()
    assert out.schema.equals(whole.schema, check_metadata=True) and out.column_names == whole.column_names
    given = [ColumnSpec("n_int64", "int64", fill_value=-5)]
    for specs in (None, given):  # as text, for fills of NaN
        assert str(arrow_io.prepared(out.digest(specs), specs)) == str(arrow_io.prepared(whole, specs)) and out.digest(specs).num_rows < 50
    again = Table.from_arrow(spark, str(tmp_path / "b"), out)
    assert again.to_arrow().schema.equals(whole.schema, check_metadata=True) and str(again.to_arrow().to_pylist()) == str(whole.to_pylist())
    assert again.append(spread.to_arrow_batches(where=field("cat") == "never")) == 0 and again.append(spread.to_arrow_batches(where=field("cat") == "q")) == spread.count(field("cat") == "q") > 0
    assert str(out.df.collect()) == str(arrow_io.frame_of(spark, whole).collect())
    none = Table.from_arrow(spark, str(tmp_path / "c"), spread.to_arrow_batches(where=field("cat") == "never"))
    assert none.nrows == 0 and none.specs["cat"].categories == ["p", "q", "never"] and none.to_arrow().num_rows == 0


def test_arrow_batches_refusals(spark, where):
    """What from_arrow refuses, whichever partition it is in; codes without labels."""
    rows = spark.range(0, 400, 1, 4).selectExpr("id p", "IF(id = 399, -127, 3) v", "CAST(IF(id = 399, 7, 0) AS byte) cat", "IF(id = 399, 'wide', 'w') s")
    out = over(rows, [ColumnSpec("v", "int8", fill_value=-128)], "p").to_arrow_batches()
    with pytest.raises(SchemaError, match="-128 is free"):
        Table.from_arrow(spark, where, out)
    with pytest.raises(SchemaError, match="its fill 3 as a value"):
        Table.from_arrow(spark, where, out, [ColumnSpec("v", "int8", fill_value=3)])
    with pytest.raises(SchemaError):
        Table.from_arrow(spark, where, out, [ColumnSpec("w", "int8")])
    t = Table.from_arrow(spark, where, out, [ColumnSpec("v", "int8", fill_value=-128)])
    assert t["v"].read().tolist() == [3] * 399 + [-127]
    assert Table.from_arrow(spark, f"{where}s", over(rows, [ColumnSpec("s", FixedString(9))], "p").to_arrow_batches()).specs["s"].dtype == FixedString(4)
    from granary.sources.frame import Reader

    broken = Reader(spark, TableSpec([ColumnSpec("cat", None, categories=["a"])]), rows.select(F.col("p").alias("__pos"), "cat"))
    with pytest.raises(ConformanceError, match="column 'cat' has codes without labels"):
        Table.from_arrow(spark, f"{where}c", broken.to_arrow_batches())


def test_arrow_refusals(spark, where):
    import datetime as dt
    import decimal

    for values in (
        pa.array([dt.datetime(2020, 1, 1)]), pa.array([dt.date(2020, 1, 1)]), pa.array([dt.time(1)]), pa.array([dt.timedelta(1)]), pa.array([decimal.Decimal("1.5")]), pa.array([{"a": 1}]), pa.array([[("a", 1)]], pa.map_(pa.string(), pa.int8())),
        pa.nulls(1), pa.array([b"ab"]), pa.array([[1, 2]], pa.list_(pa.int8(), 2)), pa.array([True, None]),
    ):
        with pytest.raises(SchemaError):
            specs_from_arrow(pa.table({"v": values}))
    with pytest.raises(SchemaError, match="seconds"):
        specs_from_arrow(pa.table({"v": pa.array([dt.datetime(2020, 1, 1)])}))
    bad = pa.table({"v": [1]}).cast(pa.schema([pa.field("v", pa.int64(), metadata={"granary.nope": "1"})]))
    with pytest.raises(SchemaError):
        specs_from_arrow(bad)
    with pytest.raises(SchemaError):
        specs_from_arrow(pa.Table.from_arrays([pa.array([1]), pa.array([2])], ["a", "a"]))
    with pytest.raises(ReservedNameError):
        specs_from_arrow(pa.table({"NROWS": [1]}))
    with pytest.raises(SchemaError, match="-128 is free"):
        Table.from_arrow(spark, where, pa.table({"v": pa.array([-127, 3], pa.int8())}))
    with pytest.raises(SchemaError):
        Table.from_arrow(spark, where, pa.table({"v": [1]}), [ColumnSpec("w", "int8")])
    assert arrow_io.suggested_fill(pa.chunked_array([pa.array([1.0, float("nan")])]), "float64") == float(np.finfo("float64").max)
    t = Table.from_arrow(spark, where, pa.table({"v": pa.array([-127, 3], pa.int8())}), [ColumnSpec("v", "int8", fill_value=-128)])
    assert t["v"].read().tolist() == [-127, 3]


# indexes


def indexed(spark, where):
    rng = np.random.default_rng(7)
    x = [None if k % 9 == 0 else int(v) for k, v in enumerate(rng.integers(0, 50, 100))]
    f = [float("nan") if k % 7 == 0 else None if k % 11 == 0 else float(v) for k, v in enumerate(rng.normal(20, 5, 100))]
    specs = [ColumnSpec("x", "int64", fill_value=-1), ColumnSpec("f", "float64"), ColumnSpec("ok", "bool"), ColumnSpec("c", None, categories=["a", "b", "z"]), ListColumnSpec("l", LeafValues("int8"))]
    data = {"x": x, "f": f, "ok": [k % 3 == 0 for k in range(100)], "c": [None if k % 10 == 0 else "ab"[k % 2] for k in range(100)], "l": [[]] * 100}
    return Table.from_arrays(spark, where, data, specs, chunk_rows=16), data


def test_index_primitives(spark, where):
    t, data = indexed(spark, where)
    zones, order, bits = t.add_search_index("x"), t.build_index("x", "SORTED_ROWS", name="by_x", description="d"), t.add_search_index("x", "BITMAP")
    assert (zones.kind, zones.name, zones.n_chunks, zones.chunk_len, zones.chunk_row_range(6)) == ("CHUNK_MINMAX", "x__chunk_minmax", 7, 16, (96, 100)) and t.generation == 1 and order.description == "d"
    here = [(k, v) for k, v in enumerate(data["x"]) if v is not None]
    entries = zones.entries().collect()
    for c, e in enumerate(entries):
        some = [v for k, v in here if k // 16 == c]
        assert (e["min"], e["max"], e["fill_count"], e["n"]) == (min(some), max(some), len(data["x"][c * 16 : c * 16 + 16]) - len(some), len(data["x"][c * 16 : c * 16 + 16]))
    import operator as o

    for op, f in (("<", o.lt), ("<=", o.le), (">", o.gt), (">=", o.ge), ("==", o.eq)):
        for v in (-5, 0, 17, 24.5, 49, 99):
            want = [k for k, x in sorted(here, key=lambda p: (p[1], p[0])) if f(x, v)]
            assert order.rows(op, v).tolist() == want
            assert set(zones.prune(op, v).tolist()) >= {k // 16 for k in want}
    assert order.rows("between", (10, 20)).tolist() == [k for k, x in sorted(here, key=lambda p: (p[1], p[0])) if 10 <= x <= 20] and order.rows("between", (20, 10)).tolist() == [] and zones.prune("between", (20, 10)).tolist() == []
    assert bits.rows(17).tolist() == [k for k, x in here if x == 17] and bits.isin([3, 4, 999]).tolist() == [k for k, x in here if x in (3, 4)] and bits.rows(-1).tolist() == [] and bits.exhaustive
    assert bits.values() == sorted({x for _, x in here}) and (order.fill_tail_length, order.nan_tail_length) == (12, 0)
    perm = [r["position"] for r in order.permutation().orderBy("rank").collect()]
    assert perm == [k for k, _ in sorted(here, key=lambda p: (p[1], p[0]))] + [k for k, x in enumerate(data["x"]) if x is None]
    with pytest.raises(SchemaError):
        zones.prune("!=", 3)
    t.validate(deep=True)


def test_index_kinds(spark, where):
    t, data = indexed(spark, where)
    assert t.add_search_index("ok").kind == "BITMAP" and t.add_search_index("c").kind == "BITMAP"
    f_bits, f_order = t.add_search_index("f", "BITMAP"), t.add_search_index("f", "SORTED_ROWS")
    assert not f_bits.exhaustive and f_bits.rows(1e9) is None and (f_order.nan_tail_length, f_order.fill_tail_length) == (15, 8)
    c = t.search_indexes["c__bitmap"]
    assert c.rows("b").tolist() == [k for k, v in enumerate(data["c"]) if v == "b"] and c.rows(0).tolist() == [k for k, v in enumerate(data["c"]) if v == "a"] and c.rows("nope").tolist() == [] and c.values() == [0, 1]
    assert str(t.select(field("c") == "?").explain().leaves[0].access) == "no such label" and t.select(field("c") == "b").explain().leaves[0].access == "BITMAP" and t.select(~(field("c") == "b")).explain().leaves[0].access == "scan"
    assert t.select(field("f").isin([1.0])).explain().leaves[0].access == "scan" and t.select(field("f") > 3).explain().leaves[0].access == "SORTED_ROWS"
    for col, kind in (("x", "CHUNK_BLOOM"), ("l", None), ("x", "nope")):
        with pytest.raises(SchemaError):
            t.add_search_index(col, kind)
    with pytest.raises(SchemaError):
        t.add_search_index("ok")
    t.validate(deep=True)


def test_stale_indexes(spark, where):
    t, data = indexed(spark, where)
    ix = t.add_search_index("x")
    more = {"x": [1000], "f": [1.0], "ok": [True], "c": ["a"], "l": [[1]]}
    t.append(more)
    assert t.generation == 2 and not t.search_indexes["x__chunk_minmax"].is_valid and not t.index_is_valid("x__chunk_minmax")
    with pytest.raises(StaleIndexError):
        t.search_indexes["x__chunk_minmax"].prune("==", 1000)
    assert t.select(field("x") == 1000).row_positions.tolist() == [100] and t.select(field("x") == 1000).explain().leaves[0].access == "scan" and t.select(field("x") == 1000).pruned().count() == 1
    assert t.refresh_indexes() == 1 and t.refresh_indexes() == 0 and t.search_indexes["x__chunk_minmax"].prune("==", 1000).tolist() == [6]
    t.append(more, maintain_indexes=True)
    assert t.generation == 3 and t.search_indexes["x__chunk_minmax"].is_valid and t.search_indexes["x__chunk_minmax"].prune(">", 999).tolist() == [6]
    t.truncate(10, maintain_indexes=True)
    assert t.generation == 4 and t.search_indexes["x__chunk_minmax"].n_chunks == 1
    t.add_column(ColumnSpec("later", "int8"))
    assert t.generation == 4 and t.search_indexes["x__chunk_minmax"].is_valid
    t.validate(deep=True)
    assert ix.source_generation == 1 and ix.column_name == "x"


def test_validation_finds(spark, where):
    t, _ = indexed(spark, where)
    t.add_search_index("x")
    t.add_search_index("x", "SORTED_ROWS")
    t.add_search_index("ok")
    good = json.loads(json.dumps(t.manifest))
    path = f"{where}/{good['indexes']['x__chunk_minmax']['dir']}"
    for change in ({"nrows": 99}, {"generation": "x"}, {"parts": []}):
        with pytest.raises(ConformanceError):
            Table(spark, where, t.number, good | change).validate()
    spark.read.parquet(path).withColumn("max", F.col("max") + 1).write.parquet(path + "2")
    broken = json.loads(json.dumps(good))
    broken["indexes"]["x__chunk_minmax"]["dir"] += "2"
    Table(spark, where, t.number, broken).validate()
    with pytest.raises(ConformanceError, match="does not say"):
        Table(spark, where, t.number, broken).validate(deep=True)
    broken["indexes"]["x__chunk_minmax"]["generation"] = 7  # stale: says nothing
    Table(spark, where, t.number, broken).validate(deep=True)
    part = good["parts"][0]["dir"]
    spark.read.parquet(f"{where}/{part}").withColumn("__pos", F.when(F.col("__pos") == 5, 6).otherwise(F.col("__pos")).cast("long")).write.parquet(f"{where}/{part}p")
    with pytest.raises(ConformanceError, match="repeat"):
        Table(spark, where, t.number, good | {"parts": [good["parts"][0] | {"dir": part + "p"}]}).validate()
    spark.read.parquet(f"{where}/{part}").withColumn("x", F.lit(-1).cast("long")).write.parquet(f"{where}/{part}x")
    with pytest.raises(ConformanceError, match="fills stored"):
        Table(spark, where, t.number, good | {"parts": [good["parts"][0] | {"dir": part + "x"}]}).validate()


# streams


def test_stream(spark, where, tmp_path):
    from granary.streaming import append_stream

    t = Table.create(spark, where, [ColumnSpec("id", "int64"), ColumnSpec("v", "float64")])
    source = str(tmp_path / "in")
    spark.range(0, 50, 1, 2).selectExpr("id", "CAST(id / 2 AS double) AS v").write.parquet(source)
    stream = lambda: spark.readStream.schema("id long, v double").parquet(source)
    append_stream(stream(), t, str(tmp_path / "check")).awaitTermination()
    spark.range(50, 60).selectExpr("id", "CAST(id / 2 AS double) AS v").write.mode("append").parquet(source)
    append_stream(stream(), t, str(tmp_path / "check")).awaitTermination()
    append_stream(stream(), t, str(tmp_path / "check")).awaitTermination()
    assert sorted(t.refresh()["id"].read().tolist()) == list(range(60)) and sorted(r[0] for r in t.rows.select("__pos").collect()) == list(range(60))

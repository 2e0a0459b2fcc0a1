"""Predicates against a plain reading of their meaning, with and without indexes, fresh and stale."""

from __future__ import annotations

import math
import random
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pytest
from granary import ColumnSpec, FixedString, LeafValues, ListColumnSpec, SchemaError, Table, TableSpec, field, over
from granary.plans import expr

GRADES = ["waste", "feed", "mill", "seed"]
NAN = float("nan")
SPECS = [
    ColumnSpec("tons", "int32", fill_value=-500), ColumnSpec("wet", "float32", fill_value=-8.0), ColumnSpec("silo", FixedString(7)), ColumnSpec("sold", "bool"),
    ColumnSpec("grade", None, categories=GRADES, ordered=True), ColumnSpec("price", "float64"),
]
TONS, WET, SILO, SOLD, GRADE, PRICE = (field(c.name) for c in SPECS)
# what rows have, and what predicates ask for besides
POOLS = {
    "tons": [-70, -3, 0, 1, 12, 13, 40, 2**31 - 1], "wet": [-0.5, 0.25, 14.0, 14.5, 90.0], "silo": ["", "east", "east 2", "north", "süd", "zz"],
    "sold": [False, True], "grade": GRADES, "price": [-2.0, 0.0, 17.5, 18.0, 1e300, NAN],
}
ASKED = {
    "tons": [-70.5, 12.5, 2**40, -(2**90), math.inf, -math.inf, Decimal("13"), Fraction(25, 2), 2**31], "wet": [14.25, 0.1, 10**60, math.inf, Fraction(1, 4)], "silo": ["east 1", "eastern", b"north", b"\xff", "a long name"],
    "sold": [0, 1, 2, 0.5], "grade": [], "price": [17.75, 2**60, math.inf, -math.inf, Decimal("17.5")],
}


def harvest(n, seed=29):
    rng = random.Random(seed)
    return {c: [None if c not in ("sold", "price") and rng.random() < 0.2 else rng.choice(pool) for _ in range(n)] for c, pool in POOLS.items()}


N = 48
DATA = harvest(N) | {"silo": [x or None for x in harvest(N)["silo"]]}


def predicate(rng, depth):
    """A predicate from a grammar: comparisons, memberships, null tests, and what joins them."""
    if depth and rng.random() < 0.6:
        kind = rng.choice("&|~")
        left = predicate(rng, depth - 1)
        return ~left if kind == "~" else left & predicate(rng, depth - 1) if kind == "&" else left | predicate(rng, depth - 1)
    name = rng.choice(list(POOLS))
    c, known = field(name), [x for x in POOLS[name] if x == x]
    some = known + ASKED[name]
    kind = rng.choice(["null", "valid", "in", *["order"] * 6])
    if kind == "null":
        return c.is_null()
    if kind == "valid":
        return c.is_valid()
    if kind == "in":
        return c.isin(rng.sample(some, rng.randint(0, min(4, len(some)))) + (["no grade"] if name == "grade" else []))
    if name == "grade" and rng.random() < 0.2:
        return rng.choice([c == "no grade", c != "no grade"])
    value = rng.choice(some)
    return rng.choice([c == value, c != value, c < value, c <= value, c > value, c >= value])


PREDICATES = [predicate(random.Random(seed), seed % 4) for seed in range(260)]


def truth(value, column, op, other):
    """Three-valued: None where the row is missing."""
    if op in ("null", "valid"):
        return (value is None) == (op == "null")
    if value is None:
        return None
    if op == "in":
        return any(truth(value, column, "==", o) for o in other)
    other = other.decode("latin1") if isinstance(other, bytes) and not other.isascii() else other.decode() if isinstance(other, bytes) else other
    if column == "grade":
        if other not in GRADES:
            return False
        value, other = GRADES.index(value), GRADES.index(other)
    if isinstance(value, str):
        value, other = value.encode(), other.encode("latin1") if other == "\xff" else other.encode()
    if isinstance(value, float) and math.isnan(value):
        return False
    return {"==": value == other, "<": value < other, "<=": value <= other, ">": value > other, ">=": value >= other}[op]


def holds(e, row):
    if isinstance(e, expr.Leaf):
        return truth(row[e.name], e.name, e.op, e.value)
    if isinstance(e, expr.Not):
        x = holds(e.part, row)
        return None if x is None else not x
    got = [holds(x, row) for x in e.parts]
    if isinstance(e, expr.And):
        return False if False in got else None if None in got else True
    return True if True in got else None if None in got else False


def expected(e, data=DATA):
    return [k for k in range(len(data["tons"])) if holds(e, {c: v[k] for c, v in data.items()})]


KINDS = {"none": {}, "bounds": dict.fromkeys(("tons", "wet", "grade", "price", "sold", "silo"), "CHUNK_MINMAX"), "sorted": dict.fromkeys(("tons", "wet", "silo", "grade", "price"), "SORTED_ROWS"), "bitmap": dict.fromkeys(("tons", "silo", "sold", "grade", "price"), "BITMAP")}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = {}
    for name, kinds in KINDS.items():
        t = Table.from_arrays(spark, str(tmp_path_factory.mktemp("t") / name), DATA, SPECS, chunk_rows=5)
        for c, kind in kinds.items():
            t.add_search_index(c, kind)
        out[name] = t
    stale = Table.from_arrays(spark, str(tmp_path_factory.mktemp("t") / "stale"), {c: v[:31] for c, v in DATA.items()}, SPECS, chunk_rows=5)
    for c, kind in KINDS["bounds"].items():
        stale.add_search_index(c, kind)
    stale.append({c: v[31:] for c, v in DATA.items()})
    out["stale"] = stale
    return out


@pytest.mark.parametrize("name", [*KINDS, "stale"])
def test_predicates(tables, name):
    from granary.plans import compile as compiler

    t = tables[name]
    # one scan answers all predicates
    cols = [compiler.column(compiler.validated(e, t.specs), t.specs).alias(f"e{k}") for k, e in enumerate(PREDICATES)]
    rows = t.rows.select("__pos", *cols).orderBy("__pos").collect()
    assert len(rows) == N
    for k, e in enumerate(PREDICATES):
        assert [r["__pos"] for r in rows if r[f"e{k}"]] == expected(e), repr(e)
    if name in ("bounds", "stale"):
        for e in [p for p in PREDICATES if isinstance(p, expr.Leaf | expr.And)][:12] + [(TONS > 0) & (WET < 20)]:
            got = [r[0] for r in t.select(e).pruned().select("__pos").orderBy("__pos").collect()]
            assert got == expected(e), repr(e)


@pytest.mark.parametrize("name", ["sorted", "bitmap", "bounds", "stale"])
def test_selections_by_index(tables, name):
    """Counts and positions are the same where indexes answer, and where they cannot."""
    from granary.operators import indexes

    t, known = tables[name], 0
    chosen = [e for e in PREDICATES if isinstance(e, expr.Leaf) and e.op not in ("null", "valid")][:14] + [(TONS > 0) & (SILO == "zz"), (TONS.isin([1, 12])) | (GRADE == "mill"), (PRICE > 17) & (PRICE < 18.5)]
    for e in chosen:
        known += indexes.answered(t, t.select(e).expression) is not None
        s = t.select(e)
        assert s.row_positions.tolist() == expected(e) and s.count() == len(expected(e)), repr(e)
    assert (known >= 3) == (name in ("sorted", "bitmap"))
    if name == "bounds":
        runs = t.search_indexes["tons__chunk_minmax"].ranges(">", 5, 64)
        held = {p // 5 for p in expected(TONS > 5)}
        assert held <= {c for lo, hi in runs for c in range(lo, hi + 1)} and all(a[1] + 1 < b[0] for a, b in zip(runs, runs[1:], strict=False))
        assert t.search_indexes["tons__chunk_minmax"].ranges(">", 5, 1) == [(runs[0][0], runs[-1][1])]


def foreign(spark):
    """The same rows as another input has them: fills and labels as values, null bytes after text."""
    from pyspark.sql import types as T

    given = [(k, -500 if DATA["tons"][k] is None and k % 2 else DATA["tons"][k], -8.0 if DATA["wet"][k] is None and k % 3 else DATA["wet"][k], None if DATA["silo"][k] is None else DATA["silo"][k] + "\0" * (k % 3), *(DATA[c][k] for c in ("sold", "grade", "price"))) for k in range(N)]
    kinds = [("row", T.LongType()), ("tons", T.LongType()), ("wet", T.FloatType()), ("silo", T.StringType()), ("sold", T.BooleanType()), ("grade", T.StringType()), ("price", T.DoubleType())]
    return spark.createDataFrame(given, T.StructType([T.StructField(n, k) for n, k in kinds]))


def test_predicates_over_other_inputs(spark):
    """On the columns as they come, predicates say what they say on stored ones."""
    from granary.plans import compile as compiler

    t = over(foreign(spark), SPECS, "row")
    cols = [compiler.over_source(compiler.validated(e, t.specs), t.specs, t._source).alias(f"e{k}") for k, e in enumerate(PREDICATES)]
    rows = t._given.select("row", *cols).orderBy("row").collect()
    for k, e in enumerate(PREDICATES):
        assert [r["row"] for r in rows if r[f"e{k}"]] == expected(e), repr(e)
    for e in (PREDICATES[3], (TONS > 0) & ~(GRADE == "mill")):
        assert t.select(e).row_positions.tolist() == expected(e)
    assert t.read(["silo", "tons"])["silo"].tolist() == DATA["silo"]


def test_known_answers(tables):
    t = tables["none"]
    for e in (~(TONS > 10), (GRADE >= "mill") & SOLD.is_valid(), WET.is_null() | (PRICE > 17)):
        assert t.select(e).row_positions.tolist() == expected(e)
    s = t.select([("tons", ">=", 12), ("tons", "<=", 13)])
    want = [k for k, x in enumerate(DATA["tons"]) if x in (12, 13)]
    assert want and (s.count(), len(s), s.row_positions.tolist()) == (len(want), len(want), want)
    got, plan = t.read(["silo", "tons", "silo"], where=[[("tons", "=", 40)], [("silo", "in", {"zz"}), ("sold", "!=", True)]], explain=True)
    want = [k for k in range(N) if DATA["tons"][k] == 40 or DATA["silo"][k] == "zz" and not DATA["sold"][k]]
    assert list(got) == ["silo", "tons"] and got["silo"].tolist() == [DATA["silo"][k] for k in want] and got["tons"].tolist() == [DATA["tons"][k] for k in want]
    assert plan.rows == len(want) and plan.terms == 2 and "scan" in str(plan)
    assert t.count() == N and t.count([]) == N and t.count(None) == N
    assert t.count(("tons", "not in", [1, 12])) == sum(x not in (None, 1, 12) for x in DATA["tons"])


def test_tuples():
    assert repr(expr.normalised(("x", "!=", 1))) == "~x == 1"
    assert repr(expr.normalised([[("x", "<", 1), ("y", "in", (1,))], [("x", ">", 2)]])) == "((x < 1 & y in [1]) | x > 2)"
    for bad in (field("x"), "x", [("x", "~", 1)], [("x", 1)], [("x", "in", 3)], [("x", "in", "abc")], [[]], [("x", "<", 1), [("x", ">", 1)]], {"x": 1}):
        with pytest.raises(SchemaError):
            expr.normalised(bad)
    for bad in (lambda: bool(TONS > 1), lambda: bool(TONS), lambda: (TONS > 1) & 3, lambda: TONS.isin(3), lambda: TONS.isin("ab")):
        with pytest.raises(SchemaError):
            bad()
    with pytest.raises(TypeError):
        hash(TONS)


def test_eager_errors(spark, tmp_path):
    specs = [*SPECS, ListColumnSpec("l", LeafValues("int32")), ColumnSpec("o", "V4")]
    t = Table.create(spark, str(tmp_path / "t"), specs)  # no rows: errors do not depend on them
    for bad in (TONS > "a", SILO > 3, GRADE < "?", TONS > NAN, TONS == None, TONS.isin([1, None]), GRADE == None, GRADE > None, field("l") == 1, field("l").is_null(), field("o") == b"abcd", SOLD == "a", (TONS > 100) & (SILO > 3)):  # noqa: E711
        with pytest.raises(SchemaError):
            t.select(bad).count()
    with pytest.raises(KeyError):
        t.select(field("nope") == 1).count()
    assert t.select(field("o").is_valid()).count() == 0 and t.select(GRADE.isin(["feed", None])).count() == 0


def test_cap_on_terms():
    pair = (TONS > 1) | (TONS < 0)
    many = pair
    for _ in range(9):
        many = many & pair
    assert expr.terms(many) == 1024 and expr.terms(~many) == 10
    with pytest.raises(SchemaError):
        expr.terms(many & pair)
    long = TONS == 0
    for k in range(3000 // 10):
        long = long | (TONS == k)
    assert expr.terms(long) == 301


@pytest.mark.parametrize("dtype", ["int8", "int32", "int64", "uint16", "uint32", "uint64", "float32", "float64"])
def test_exact_numbers(spark, tmp_path, dtype):
    """Comparisons across types and at the limits, as Python makes them."""
    if dtype.startswith("f"):
        big = float(np.finfo(dtype).max)
        values = [-1.5, 0.0, 1.5, 2.25, 16777216.0, float("inf"), float("-inf"), big, float("nan")] + ([2.0**53, 2.0**53 + 2] if dtype == "float64" else [float(np.float32(0.1))])
        probes = [0, 2, 2.25, 0.1, 2**53 + 1, 2**53, 16777217, 10**400, -(10**400), math.inf, -math.inf, big, Fraction(9, 4), Decimal("0.1"), 1e300, True]
    else:
        info = np.iinfo(dtype)
        values = sorted({max(int(info.min), -100), 0, 1, 42, 126, int(info.max) - 1, int(info.min) + 1} | ({2**53, 2**53 + 1} if info.max > 2**53 else set()))
        probes = [0, 1, 41.5, 42.0, -0.5, float(2**53), 2.0**63, 2**63, 2**64, -(2**64), int(info.min), int(info.max), int(info.max) + 1, math.inf, -math.inf, Fraction(85, 2), Decimal("42.0"), True, np.float32(1), np.uint64(2**63)]
    spec = ColumnSpec("v", dtype, fill_value=-9.5 if dtype.startswith("f") else None if dtype.startswith("u") else int(np.iinfo(dtype).min) + 7)
    t = Table.from_arrays(spark, str(tmp_path / "t"), {"v": values}, [spec])
    from granary.plans import compile as compiler

    asked = [(op, p) for p in probes for op in ("==", "<", "<=", ">", ">=")]
    cols = [compiler.leaf_column(t.rows["v"], spec, op, p).alias(f"c{k}") for k, (op, p) in enumerate(asked)]
    rows = t.rows.select("v", *cols).orderBy("__pos").collect()
    for k, (op, p) in enumerate(asked):
        plain = p.item() if isinstance(p, np.generic) else p
        for v, r in zip(values, rows, strict=True):
            assert bool(r[f"c{k}"]) == bool(truth(v, "v", op, plain)), (dtype, v, op, p)


def pushed(df):
    """What the scans of a plan are asked to leave out."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.maxMetadataStringLength")
    return " ".join(x.split("], ReadSchema")[0] for x in plan.split("PushedFilters: [")[1:])


def test_pushdown(tables):
    t = tables["none"]
    said = pushed(t.select((TONS > 2.5) & (GRADE == "feed") & (WET >= 3) & SILO.isin(["east", "zz"])).rows)
    for part in ("GreaterThanOrEqual(tons,3)", "EqualTo(grade,1)", "GreaterThanOrEqual(wet,3.0)"):
        assert part in said
    read = t.select(TONS > 3).rows.select("tons")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<tons:int>" in read
    spec = TableSpec(SPECS)
    assert spec.column("tons").resolved_dtype() == "int32" and spec.ordered_names[0] == "tons"


def test_pushdown_over_other_inputs(spark, tmp_path):
    foreign(spark).write.parquet(str(tmp_path / "p"))
    t = over(spark.read.parquet(str(tmp_path / "p")), SPECS, "row")
    for e, parts in (
        ((TONS > 2.5) & (WET < 3), ["GreaterThanOrEqual(tons,3)", "LessThan(wet,3.0)"]),
        (TONS.isin([1, 12, 2**70]) & ~(SOLD == True), ["In(tons, [1,12])"]),  # noqa: E712
        ((GRADE > "feed") | (TONS < 0), ["Or("]),
        (~(TONS > 5), ["LessThanOrEqual(tons,5)"]),
        (SILO == "zz", ["GreaterThanOrEqual(silo,zz)", "LessThanOrEqual(silo,zz"]),
        (PRICE.is_valid() & (PRICE >= 18), ["GreaterThanOrEqual(price,18.0)"]),
    ):
        said = pushed(t.select(e).rows)
        assert all(x in said for x in parts), (repr(e), said)
    from granary import queries

    for name in ("flagship", "filter_eq", "filter_ne", "filter_range", "filter_or_not", "filter_isin", "filter_not_isin", "int_vs_float", "categorical_isin", "categorical_order", "dnf_tuples", "string_bytewise", "count_where"):
        assert pushed(queries.QUERIES[name](spark, "/root/testdata/sf0.001")), name


def test_fractions_are_no_integers(spark, tmp_path):
    for dtype, value in (("int64", 1.0000001), ("int32", 2**31 * 1.0), ("uint8", -1.0), ("int8", NAN), ("int64", 2.0**63)):
        t = Table.create(spark, str(tmp_path / f"{dtype}{value}"), [ColumnSpec("v", dtype)])
        with pytest.raises(SchemaError):
            t.append(spark.createDataFrame([(1.0,), (value,)], "v double"))
    t = Table.create(spark, str(tmp_path / "fine"), [ColumnSpec("v", "uint64"), ColumnSpec("w", "int16")])
    t.append(spark.createDataFrame([(2.0**63, 5), (0.0, -7)], "v double, w long"))
    assert [int(x) for x in t["v"].read()] == [2**63, 0] and t["w"].read().tolist() == [5, -7]
    with pytest.raises(SchemaError):
        t.append(spark.createDataFrame([(40000,)], "w long"))
    with pytest.raises(SchemaError):
        t.append(spark.sql("SELECT CAST('1.0000000001' AS DECIMAL(20,10)) AS w"))

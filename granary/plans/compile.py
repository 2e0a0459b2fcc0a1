"""From a predicate and a schema to one Spark column.

Nulls are missing values, so Spark's three-valued logic is the table's. What Spark does otherwise
is said differently here: NaN is present but satisfies no comparison; integers and floats compare as
the numbers they are, at any size; labels compare by code; a value that no row can have is never matched by
a row that is present, and unknown for one that is missing. Everything stays an expression on the bare
column, so that Parquet filters are still pushed down. Over other inputs, whose fills and labels are not
nulls and codes, ``over_source`` says when a predicate is true on the columns as they come.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from decimal import Decimal
from fractions import Fraction
from numbers import Integral, Real
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from ..functions import types as t
from ..functions.specs import ColumnSpec, ListColumnSpec, Spec
from .expr import And, Expression, Leaf, Not, leaves, normalised, terms


def constant(c: Column, truth: bool) -> Column:
    """An answer that is the same for all rows that are present; unknown for the others."""
    return F.when(c.isNotNull(), F.lit(truth))


def _number(name: str, value: Any) -> int | float | Fraction:
    if isinstance(value, bool | np.bool_):
        return int(value)
    if isinstance(value, Integral):
        return int(value)
    if isinstance(value, Decimal):
        if not value.is_finite():
            return _number(name, float(value))
        return Fraction(value)
    if isinstance(value, Real):
        value = float(value) if not isinstance(value, Fraction) else value
        if isinstance(value, float) and math.isnan(value):
            raise SchemaError(f"NaN is not comparable; no row of {name!r} could match")
        return value
    raise SchemaError(f"{name!r} holds numbers; it cannot be compared with {value!r}")


def _compare(c: Column, op: str, value: Column) -> Column:
    return {"==": c == value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op]


def _integers(c: Column, op: str, value: int | float | Fraction, dtype: str) -> Column:
    lo, hi = t.limits(dtype)
    if value in (math.inf, -math.inf):
        return constant(c, op in ("<", "<=") if value > 0 else op in (">", ">="))
    whole = math.floor(value)
    if whole != value:  # between two integers
        if op == "==":
            return constant(c, False)
        op, whole = ("<=", whole) if op in ("<", "<=") else (">=", whole + 1)
    if whole < lo or whole > hi:
        return constant(c, op in (">", ">=") if whole < lo else op in ("<", "<="))
    return _compare(c, op, t.constant(dtype, whole))


def _floats(c: Column, op: str, value: int | float | Fraction, dtype: str) -> Column:
    kind = np.float32 if dtype != "float64" else np.float64
    most = float(np.finfo(kind).max)
    exact = value if isinstance(value, float) and math.isinf(value) else Fraction(value)
    if isinstance(exact, Fraction):
        if abs(exact) > Fraction(most):
            near = most if exact > 0 else -most  # the last number before it; infinities lie beyond
        else:
            with np.errstate(over="ignore"):
                near = float(kind(float(exact)))
            near = near if math.isfinite(near) else most if exact > 0 else -most
        if Fraction(near) != exact:  # between two floats: near is one of them
            if op == "==":
                return constant(c, False)
            below = Fraction(near) < exact
            op = ("<=" if below else "<") if op in ("<", "<=") else (">" if below else ">=")
    else:
        near = exact
    out = _compare(c, op, t.constant("float32" if kind is np.float32 else "float64", near))
    return out & ~F.isnan(c) if op in (">", ">=") else out


def _text(c: Column, op: str, value: Any, name: str) -> Column:
    if isinstance(value, np.generic):
        value = value.item()
    if isinstance(value, bytes | bytearray):
        try:
            value = bytes(value).rstrip(b"\0").decode()
        except UnicodeDecodeError:
            return _compare(c.cast("binary"), op, F.lit(bytearray(value)))
    if not isinstance(value, str):
        raise SchemaError(f"{name!r} holds text; it cannot be compared with {value!r}")
    return _compare(c, op, F.lit(value))


def _boolean(c: Column, op: str, value: Any, name: str) -> Column:
    number = _number(name, value)
    if op == "==" and number in (0, 1):
        return c == F.lit(bool(number))
    return _integers(c.cast("int"), op, number, "int32")


def code_of(spec: ColumnSpec, label: Any) -> int | None:
    if isinstance(label, np.generic):
        label = label.item()
    if isinstance(label, bytes):
        label = label.decode("utf-8", "replace")
    return next((k for k, x in enumerate(spec.categories or ()) if x == label and isinstance(x, str) == isinstance(label, str)), None)


def _one(c: Column, spec: ColumnSpec, op: str, value: Any) -> Column:
    if value is None:
        raise SchemaError(f"{spec.name!r} cannot be compared with None; ask is_null() or is_valid()")
    if spec.is_categorical:
        code = code_of(spec, value)
        if code is None:
            if op != "==":
                raise SchemaError(f"{value!r} is no label of {spec.name!r}, so nothing is before or after it")
            return constant(c, False)
        return _compare(c, op, t.constant(spec.dtype, code))
    if spec.is_string:
        return _text(c, op, value, spec.name)
    if spec.is_boolean:
        return _boolean(c, op, value, spec.name)
    number = _number(spec.name, value)
    return _floats(c, op, number, spec.dtype) if t.is_float(spec.dtype) else _integers(c, op, number, spec.dtype)


def _any_of(c: Column, spec: ColumnSpec, values: tuple[Any, ...]) -> Column:
    if spec.is_categorical:
        values = tuple(v for v in values if v is not None)
    # those that some row could have become one list of constants, which Spark pushes down as such
    plain: list[Any] = []
    other: list[Column] = []
    for v in values:
        if v is None:
            raise SchemaError(f"None is no value that {spec.name!r} could have; ask is_null()")
        if spec.is_categorical:
            code = code_of(spec, v)
            plain += [] if code is None else [t.constant(spec.dtype, code)]
        elif spec.is_string and isinstance(v, str):
            plain.append(F.lit(str(v)))
        elif t.is_integer(spec.dtype):
            n = _number(spec.name, v)
            lo, hi = t.limits(spec.dtype)
            plain += [t.constant(spec.dtype, int(n))] if n not in (math.inf, -math.inf) and n == math.floor(n) and lo <= n <= hi else []
        else:
            other.append(_one(c, spec, "==", v))
    out = c.isin(plain) if plain else constant(c, False)
    for x in other:
        out = out | x
    return out


def leaf_column(c: Column, spec: Spec, op: str, value: Any) -> Column:
    if isinstance(spec, ListColumnSpec):
        raise SchemaError(f"{spec.name!r} holds lists; predicates are on single values")
    if op == "null":
        return c.isNull() if spec.nullable else F.lit(False)
    if op == "valid":
        return c.isNotNull() if spec.nullable else F.lit(True)
    if t.is_opaque(spec.dtype):
        raise SchemaError(f"{spec.name!r} holds opaque bytes, which have no order or equality")
    return _any_of(c, spec, value) if op == "in" else _one(c, spec, op, value)


def validated(where: Any, specs: Mapping[str, Spec]) -> Expression | None:
    """The predicate as one expression. Every leaf is compiled once for its errors, whatever the data;
    an unknown column is a KeyError."""
    e = normalised(where)
    if e is not None:
        for leaf, _ in leaves(e):
            leaf_column(F.col("x"), specs[leaf.name], leaf.op, leaf.value)
        terms(e)
    return e


def column(e: Expression | None, specs: Mapping[str, Spec]) -> Column | None:
    """The Spark column that is true for the rows that match."""
    if e is None:
        return None
    if isinstance(e, Leaf):
        return leaf_column(F.col(f"`{e.name.replace('`', '``')}`"), specs[e.name], e.op, e.value)
    if isinstance(e, Not):
        return ~column(e.part, specs)
    parts = [column(x, specs) for x in e.parts]
    while len(parts) > 1:  # balanced, so that long chains stay shallow
        it = iter(parts)
        parts = [x if (y := next(it, None)) is None else x & y if isinstance(e, And) else x | y for x in it]
    return parts[0]


def _labels_that(spec: ColumnSpec, op: str, value: Any) -> list[Any]:
    """The labels that a comparison holds for."""
    labels = list(spec.categories or ())
    if op == "in":
        wanted = {code_of(spec, v) for v in value if v is not None}
        return [x for k, x in enumerate(labels) if k in wanted]
    code = code_of(spec, value)
    if code is None:
        return []
    holds: Callable[[int], bool] = {"==": code.__eq__, "<": code.__gt__, "<=": code.__ge__, ">": code.__lt__, ">=": code.__le__}[op]
    return [x for k, x in enumerate(labels) if holds(k)]


def _near(c: Column, spec: ColumnSpec, op: str, value: Any) -> Column | None:
    """For text that may have null bytes at its end, bounds on the bare column that a comparison implies."""
    given = list(value) if op == "in" else [value]
    given = [bytes(v).rstrip(b"\0").decode("utf-8", "replace") if isinstance(v, bytes | bytearray) else str(v) for v in given]
    if not given or any("\ufffd" in v for v in given):
        return None
    low, high = (f(given, key=lambda v: v.encode()) for f in (min, max))
    out = [c >= F.lit(low)] if op in ("==", "in", ">", ">=") else []
    out += [c <= F.lit(high + "\0" * spec.dtype.nbytes)] if op in ("==", "in", "<", "<=") else []  # type: ignore[union-attr]
    return out[0] if len(out) == 1 else out[0] & out[1]


def _source_leaf(leaf: Leaf, negated: bool, spec: Spec, c: Column, given: T.DataType, stored: Column) -> Column:
    """When a comparison, or its opposite, is true of a column as it comes; stored: the column as it would be stored."""
    leaf_column(stored, spec, leaf.op, leaf.value)  # for its errors
    whole = isinstance(given, T.ByteType | T.ShortType | T.IntegerType | T.LongType)
    text = isinstance(given, T.StringType)
    if spec.is_categorical and text and all(isinstance(x, str) for x in spec.categories or ()):
        if leaf.op in ("null", "valid"):
            return c.isNull() if (leaf.op == "null") != negated else c.isNotNull()
        hold = _labels_that(spec, leaf.op, leaf.value)
        some = [x for x in spec.categories or () if (x in hold) != negated]
        return c.isin(some) if some else F.lit(False)
    fixed = isinstance(spec.dtype, t.FixedString)
    if spec.is_categorical or t.is_opaque(spec.dtype) or not (t.is_integer(spec.dtype) and spec.dtype != "uint64" and whole or given == t.stored(spec.dtype)) or t.is_float(spec.dtype) and given != t.stored(spec.dtype):
        out = leaf_column(stored, spec, leaf.op, leaf.value)
        return ~out if negated else out
    bare, near = c, None
    if fixed:
        bare = F.rtrim(c, F.lit("\0"))
        near = None if negated or leaf.op in ("null", "valid") else _near(c, spec, leaf.op, leaf.value)
    there = c.isNotNull()
    if spec.fill_value is not None and not spec.is_boolean:
        # a literal of the wider type: Spark takes the cast off the column again
        there = there & (~F.isnan(bare) if t.is_nan(spec.fill_value) else bare != t.constant(spec.dtype, spec.fill_value))
    if leaf.op in ("null", "valid"):
        if not spec.nullable:
            return F.lit((leaf.op == "valid") != negated)
        return there if (leaf.op == "valid") != negated else ~there
    out = leaf_column(bare, spec, leaf.op, leaf.value)
    out = (~out if negated else out) & there
    return out if near is None else near & out


def over_source(e: Expression, specs: Mapping[str, Spec], source: Mapping[str, tuple[Column, T.DataType, Column]], negated: bool = False) -> Column:
    """A column that is true for the rows that match, on the columns as they come: of each its bare column, its type,
    and how it would be stored. Negations are taken down to the comparisons, of which the truth of either side is
    said for rows that are present, so that no third value is needed and nothing hides the column from the scan."""
    if isinstance(e, Leaf):
        return _source_leaf(e, negated, specs[e.name], *source[e.name])
    if isinstance(e, Not):
        return over_source(e.part, specs, source, not negated)
    parts = [over_source(x, specs, source, negated) for x in e.parts]
    both = isinstance(e, And) != negated
    while len(parts) > 1:
        it = iter(parts)
        parts = [x if (y := next(it, None)) is None else x & y if both else x | y for x in it]
    return parts[0]

"""From given values to stored ones: checks, codes for labels, nulls for fills.

Checks are expressions in the projection that writes, so that they cost no pass of their own; the first row that
breaks one fails the write before anything is committed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConformanceError, OversizedStringError, SchemaError
from ..functions import types as t
from ..functions.specs import ColumnSpec, LeafValues, ListColumnSpec, NestedList, Spec, StringValues, TableSpec

# Checks put these marks into Spark's error, by which the error is told again on the driver.
_KINDS: dict[str, type[Exception]] = {"granary-size": OversizedStringError, "granary-schema": SchemaError, "granary-code": ConformanceError}


def refuse(kind: str, text: str) -> Column:
    return F.raise_error(F.lit(f"[{kind}] {text}"))


def retold(error: Exception) -> Exception:
    """The error that a failed check stands for."""
    import re

    for kind, cls in _KINDS.items():
        if m := re.search(rf"\[{kind}\] ([^\n]*)", str(error)):
            return cls(m[1])
    return error


def _checked(ok: Column, c: Column, kind: str, text: str) -> Column:
    return F.when(c.isNull() | ok, c).otherwise(refuse(kind, text))


_WHOLE = {T.ByteType(): 7, T.ShortType(): 15, T.IntegerType(): 31, T.LongType(): 63}  # bits beside the sign


def _integer(c: Column, dtype: str, given: T.DataType | None, text: str) -> Column:
    """An integer column, with no more checks than the type that it comes as leaves open."""
    kind, (lo, hi) = t.stored(dtype), t.limits(dtype)
    if given in _WHOLE:
        least, most = -(1 << _WHOLE[given]), (1 << _WHOLE[given]) - 1
        if lo <= least and most <= hi:
            return c.cast(kind)
        ok = c.between(F.lit(max(lo, least)).cast(given), F.lit(min(hi, most)).cast(given))
    elif isinstance(given, T.FloatType | T.DoubleType):
        wide = c.cast("double")  # the limits are powers of two, or lie between them and the last double before
        ok = (wide >= float(lo)) & ((wide < float(hi + 1)) if hi + 1 == int(float(hi + 1)) else (wide <= float(hi))) & (wide == F.floor(wide).cast("double"))
        sound = _checked(F.coalesce(ok, F.lit(False)), wide, "granary-schema", text)
        if dtype != "uint64":
            return sound.cast(kind)
        half = 1 << 63  # Spark makes decimals of a double's digits; integers it makes exactly
        upper = (sound - F.lit(float(half))).cast("long").cast(kind) + F.lit(str(half)).cast(kind)
        return F.when(sound < float(half), sound.cast("long").cast(kind)).otherwise(upper.cast(kind))
    else:
        wide = c if isinstance(given, T.DecimalType) else c.cast("decimal(38,18)")
        ok = wide.between(F.lit(str(lo)).cast("decimal(20,0)"), F.lit(str(hi)).cast("decimal(20,0)")) & (wide % 1 == 0)
    return _checked(F.coalesce(ok, F.lit(False)), c, "granary-schema", text).cast(kind)


def _leaf(c: Column, dtype: t.Logical, fill: Any, where: str, given: T.DataType | None = None) -> Column:
    kind = t.stored(dtype)
    if dtype == "bool":
        if isinstance(given, T.BooleanType):
            return c
        return _checked(c.cast("double").isin(0.0, 1.0), c, "granary-schema", f"{where} takes true and false, 0 and 1").cast("boolean")
    if isinstance(dtype, t.FixedString):
        c = F.rtrim(c, F.lit("\0"))
        c = _checked(F.octet_length(c) <= dtype.nbytes, c, "granary-size", f"{where} has {dtype.nbytes} bytes")
        if dtype.encoding == "ascii":
            c = _checked(F.octet_length(c) == F.length(c), c, "granary-schema", f"{where} takes ascii")
    elif t.is_opaque(dtype):
        c = _checked(F.octet_length(c.cast("binary")) == dtype.nbytes, c.cast("binary"), "granary-schema", f"{where} takes {dtype.nbytes} bytes")
    elif t.is_integer(dtype):
        lo, hi = t.limits(dtype)
        c = _integer(c, dtype, given, f"{where} takes integers from {lo} to {hi}")
    else:
        c = c.cast(kind)
    return t.missing_to_null(c, dtype, fill)


def _elements(c: Column, values: Any, where: str, given: T.DataType | None = None) -> Column:
    given = given.elementType if isinstance(given, T.ArrayType) else None
    if isinstance(values, NestedList):
        inner = F.transform(c, lambda x: _elements(x, values.values, where, given))
        ok = F.lit(True) if values.nullable else ~F.coalesce(F.exists(c, lambda x: x.isNull()), F.lit(False))
        return _checked(ok, inner, "granary-schema", f"{where} has no room for a list that is missing")
    if isinstance(values, StringValues):
        ok = F.lit(True) if values.nullable else ~F.coalesce(F.exists(c, lambda x: x.isNull()), F.lit(False))
        return _checked(ok, c, "granary-schema", f"{where} has no room for text that is missing")
    if given == t.stored(values.dtype) and values.fill_value is None and not t.is_opaque(values.dtype) and not isinstance(values.dtype, t.FixedString) and values.dtype != "bool" and _bare(values.dtype, given):
        return c
    out = F.transform(c, lambda x: _leaf(x, values.dtype, values.fill_value, where, given))
    if values.dtype == "bool":
        out = _checked(~F.coalesce(F.exists(c, lambda x: x.isNull()), F.lit(False)), out, "granary-schema", f"{where} takes true and false, never missing")
    return out


def _bare(dtype: t.Logical, given: T.DataType | None) -> bool:
    """Whether every value of a given type is one of the logical type, as it is."""
    if t.is_integer(dtype):
        lo, hi = t.limits(dtype)  # type: ignore[arg-type]
        return given in _WHOLE and lo <= -(1 << _WHOLE[given]) and (1 << _WHOLE[given]) - 1 <= hi
    return given == t.stored(dtype) and (t.is_float(dtype) or dtype in ("bool", "string"))


def stored_column(spec: Spec, c: Column, codes: bool = False, given: T.DataType | None = None) -> Column:
    """A given column as it is stored; codes: whether labels come as codes already; given: the type that it has, if known."""
    where = f"column {spec.name!r}"
    if isinstance(spec, ListColumnSpec):
        out = _elements(c, spec.values, where, given)
        return out if spec.nullable else F.when(c.isNotNull(), out).otherwise(refuse("granary-schema", f"{where} has no room for a row that is missing"))
    if spec.is_categorical and not codes:
        labels = spec.categories or []
        if not labels:
            return F.when(c.isNotNull(), refuse("granary-schema", f"{where} has no labels")).otherwise(F.lit(None).cast(spec.stored()))
        table = F.create_map(*(x for k, label in enumerate(labels) for x in (F.lit(label), F.lit(k).cast(spec.stored()))))
        code = F.try_element_at(table, c)
        return F.when(c.isNull(), F.lit(None).cast(spec.stored())).when(code.isNotNull(), code).otherwise(F.raise_error(F.concat(F.lit(f"[granary-schema] {where} has no label "), c.cast("string"))))
    if spec.is_categorical:
        n = len(spec.categories or [])
        gone = t.missing_to_null(c.cast(spec.stored()), spec.dtype, spec.fill_value)
        return _checked(gone.between(0, n - 1), gone, "granary-code", f"{where} has {n} labels")
    out = _leaf(c, spec.dtype, spec.fill_value, where, given)
    if spec.is_boolean:
        return F.when(c.isNotNull(), out).otherwise(refuse("granary-schema", f"{where} is boolean and never missing"))
    return out


def absent(spec: Spec) -> Column:
    """What rows have in a column that was not given."""
    if isinstance(spec, ListColumnSpec) and not spec.nullable or isinstance(spec, ColumnSpec) and spec.is_boolean:
        raise SchemaError(f"column {spec.name!r} has no missing values and must be given")
    return F.lit(None).cast(spec.stored())


def incoming(spec: TableSpec, df: DataFrame) -> DataFrame:
    """A DataFrame of given values as stored columns in the table's order."""
    names = [c.name for c in spec.ordered()]
    if unknown := [c for c in df.columns if c not in names]:
        raise SchemaError(f"there are no columns {unknown}")
    given = {f.name: f.dataType for f in df.schema.fields}
    quoted = {c: F.col(f"`{c.replace('`', '``')}`") for c in names}
    return df.select(*((stored_column(c, quoted[c.name], given=given[c.name]) if c.name in given else absent(c)).alias(c.name) for c in spec.ordered()))


def _plain(x: Any) -> Any:
    if x is np.ma.masked or x is None:
        return None
    if isinstance(x, np.ndarray | list | tuple):
        return [_plain(y) for y in x]
    if isinstance(x, np.void):
        return x.tobytes()
    return x.item() if isinstance(x, np.generic) else x


def _given_type(spec: Spec, values: list[Any]) -> pa.DataType:
    """How values come to Spark: wide enough that the checks see what was given."""

    def leaf(dtype: t.Logical, some: Any) -> pa.DataType:
        if t.is_text(dtype):
            return pa.string()
        if t.is_opaque(dtype):
            return pa.binary()
        if dtype == "bool":
            return pa.float64() if not isinstance(some, bool) else pa.bool_()
        if t.is_float(dtype):
            return pa.float64()
        return pa.float64() if isinstance(some, float) else pa.decimal128(20, 0) if dtype == "uint64" else pa.int64()

    if isinstance(spec, ListColumnSpec):

        def nested(v: Any, some: list[Any]) -> pa.DataType:
            flat = [y for x in some if x is not None for y in x]
            if isinstance(v, NestedList):
                return pa.list_(nested(v.values, flat))
            return pa.list_(pa.string() if isinstance(v, StringValues) else leaf(v.dtype, next((x for x in flat if x is not None), None)))

        return nested(spec.values, values)
    some = next((x for x in values if x is not None), None)
    if spec.is_categorical:
        first = (spec.categories or [""])[0]
        return pa.string() if isinstance(first, str) else pa.float64() if isinstance(first, float) else pa.int64()
    kinds = {type(x) for x in values if x is not None}
    if spec.is_boolean:
        return pa.bool_() if kinds <= {bool} else pa.float64()
    return leaf(spec.dtype, next((x for x in values if isinstance(x, float)), some))


def from_values(spark: SparkSession, spec: TableSpec, data: Mapping[str, Sequence[Any]]) -> DataFrame:
    """Columns of values on the driver as a DataFrame of one partition, in order."""
    specs = {c.name: c for c in spec.ordered()}
    if unknown := [c for c in data if c not in specs]:
        raise SchemaError(f"there are no columns {unknown}")
    lists = {name: [_plain(x) for x in values] for name, values in data.items()}
    if len({len(v) for v in lists.values()}) > 1:
        raise SchemaError(f"columns differ in length: { {k: len(v) for k, v in lists.items()} }")
    for name, values in lists.items():
        c = specs[name]
        if isinstance(c, ColumnSpec) and not c.is_categorical:
            for x in values:
                if x is None:
                    continue
                if isinstance(c.dtype, t.FixedString) and isinstance(x, str):
                    c.dtype.encode(x.rstrip("\0"))
                if c.is_string != isinstance(x, str) and not (c.is_string and isinstance(x, bytes)) or t.is_integer(c.dtype) and isinstance(x, int) and not t.limits(c.dtype)[0] <= x <= t.limits(c.dtype)[1]:
                    raise SchemaError(f"column {name!r} cannot hold {x!r}")
        if isinstance(c, ColumnSpec) and c.is_categorical:
            for x in values:
                if x is not None and not any(x == y for y in c.categories or ()):
                    raise SchemaError(f"column {name!r} has no label {x!r}")
    try:
        arrays = {k: pa.array([x.decode() if isinstance(x, bytes) and not isinstance(specs[k], ListColumnSpec) and specs[k].is_string else x for x in v], _given_type(specs[k], v)) for k, v in lists.items()}
    except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError, UnicodeDecodeError) as e:
        raise SchemaError(str(e)) from e
    table = pa.table(arrays)
    schema = T.StructType([T.StructField(k, _spark_type(a.type), True) for k, a in arrays.items()])
    return spark.createDataFrame(table, schema).coalesce(1)


def _spark_type(a: pa.DataType) -> T.DataType:
    if pa.types.is_list(a):
        return T.ArrayType(_spark_type(a.value_type), True)
    if pa.types.is_decimal(a):
        return T.DecimalType(a.precision, a.scale)
    return {pa.string(): T.StringType(), pa.binary(): T.BinaryType(), pa.bool_(): T.BooleanType(), pa.float64(): T.DoubleType(), pa.int64(): T.LongType()}[a]

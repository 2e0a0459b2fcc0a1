"""Logical column types, how Spark stores them, and the fill that stands for a missing value.

A stored null is a missing value: what equals the fill becomes null when it is written, so that
Spark's own null tests and three-valued logic are those of the table.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FillValueError, OversizedStringError, ReservedNameError, SchemaError

# The recommended fills.
FILLS: dict[str, Any] = {
    "int8": -127, "int16": -32767, "int32": -2147483647, "int64": -9223372036854775807,
    "uint8": 255, "uint16": 65535, "uint32": 4294967295, "uint64": 18446744073709551615,
    "float32": 9.969209968386869e36, "float64": 9.969209968386869e36,
}

_STORED: dict[str, T.DataType] = {
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(), "bool": T.BooleanType(), "string": T.StringType(),
}

POSITION = "__pos"


@dataclass(frozen=True)
class FixedString:
    """Text with a budget of UTF-8 (or ASCII) bytes; more raises."""

    nbytes: int
    encoding: str = "utf-8"

    def __post_init__(self) -> None:
        if not isinstance(self.nbytes, int) or self.nbytes < 1 or self.encoding not in ("utf-8", "ascii"):
            raise SchemaError(f"a fixed string needs at least one byte of utf-8 or ascii, not {self.nbytes!r} of {self.encoding!r}")

    def encode(self, value: str) -> bytes:
        try:
            out = value.encode(self.encoding)
        except UnicodeEncodeError as e:
            raise SchemaError(f"{value!r} is not {self.encoding}") from e
        if len(out) > self.nbytes:
            raise OversizedStringError(f"{value!r} takes {len(out)} bytes; there are {self.nbytes}")
        return out.ljust(self.nbytes, b"\0")

    def decode(self, value: bytes) -> str:
        return value.rstrip(b"\0").decode(self.encoding)


@dataclass(frozen=True)
class Opaque:
    """A number of bytes without order or meaning."""

    nbytes: int

    def __post_init__(self) -> None:
        if not isinstance(self.nbytes, int) or self.nbytes < 1:
            raise SchemaError("opaque values need at least one byte")


Logical = str | FixedString | Opaque


def logical(dtype: Any) -> Logical:
    """The logical type that a name, a NumPy type or one of the above stands for."""
    if isinstance(dtype, FixedString | Opaque):
        return dtype
    if dtype in (bool, "bool", "boolean"):
        return "bool"
    if dtype in (str, "string"):
        return "string"
    try:
        d = np.dtype(dtype)
    except TypeError as e:
        raise SchemaError(f"no column type {dtype!r}") from e
    if d.kind == "S":
        return FixedString(d.itemsize)
    if d.kind == "V" and d.names is None and d.itemsize:
        return Opaque(d.itemsize)
    if d.kind == "b":
        return "bool"
    if d.name not in _STORED:
        raise SchemaError(f"no column type {dtype!r}")
    return d.name


def stored(dtype: Logical) -> T.DataType:
    if isinstance(dtype, FixedString):
        return T.StringType()
    return T.BinaryType() if isinstance(dtype, Opaque) else _STORED[dtype]


def is_float(dtype: Logical) -> bool:
    return dtype in ("float16", "float32", "float64")


def is_integer(dtype: Logical) -> bool:
    return isinstance(dtype, str) and "int" in dtype


def is_text(dtype: Logical) -> bool:
    return isinstance(dtype, FixedString) or dtype == "string"


def is_opaque(dtype: Logical) -> bool:
    return isinstance(dtype, Opaque)


def limits(dtype: str) -> tuple[int, int]:
    info = np.iinfo(dtype)
    return int(info.min), int(info.max)


def opaque_fill_bytes(nbytes: int) -> bytes:
    """FILL, then 1, 2, ...; its beginning where there is less room."""
    return (b"FILL" + bytes(k % 256 for k in range(1, nbytes + 1)))[:nbytes]


def recommended_fill(dtype: Any) -> Any:
    kind = logical(dtype)
    if is_text(kind):
        return ""
    if is_opaque(kind):
        return opaque_fill_bytes(kind.nbytes)
    if kind == "bool" or kind not in FILLS:
        raise FillValueError(f"there is no recommended fill for {kind}; give one")
    return FILLS[kind]


def is_nan(value: Any) -> bool:
    return isinstance(value, float | np.floating) and math.isnan(value)


def is_missing(values: Any, fill: Any) -> np.ndarray:
    """Which values equal the fill; a fill of NaN is equalled by NaN, any other by itself."""
    got = np.asarray(values)
    if fill is None:
        return np.zeros(got.shape, bool)
    if is_nan(fill):
        return np.isnan(got) if got.dtype.kind == "f" else np.zeros(got.shape, bool)
    return np.asarray(got == fill) & np.ones(got.shape, bool)


def missing_to_null(c: Column, dtype: Logical, fill: Any) -> Column:
    """A column as it is stored: null in place of its fill."""
    if fill is None or dtype == "bool":
        return c
    if is_nan(fill):
        return F.when(~F.isnan(c), c)
    return F.when(c != constant(dtype, fill), c)


def constant(dtype: Logical, value: Any) -> Column:
    if isinstance(value, np.generic):
        value = value.item()
    if is_opaque(dtype):
        return F.lit(bytearray(value))
    if dtype == "uint64":
        return F.lit(str(int(value))).cast("decimal(20,0)")
    return F.lit(value).cast(stored(dtype))


def checked_fill(dtype: Logical, fill: Any) -> Any:
    """The fill as a value of the type, or an error."""
    if isinstance(fill, np.generic):
        fill = fill.item()
    ok = False
    if is_integer(dtype):
        ok = isinstance(fill, int | float) and not isinstance(fill, bool) and float(fill).is_integer() and limits(dtype)[0] <= int(fill) <= limits(dtype)[1]
        fill = int(fill) if ok else fill
    elif is_float(dtype):
        ok = isinstance(fill, int | float) and not isinstance(fill, bool)
        fill = float(np.dtype(dtype).type(fill)) if ok else fill
    elif is_text(dtype):
        ok = isinstance(fill, str)
        if ok and isinstance(dtype, FixedString):
            dtype.encode(fill)
    elif is_opaque(dtype):
        ok = isinstance(fill, bytes | bytearray) and len(fill) == dtype.nbytes
        fill = bytes(fill) if ok else fill
    if not ok:
        raise FillValueError(f"{fill!r} cannot be the fill of {dtype}")
    return fill


def validate_fill_outside_range(fill: Any, valid_min: Any, valid_max: Any) -> None:
    """A fill that is a valid value would hide it."""
    if fill is None or is_nan(fill) or isinstance(fill, str | bytes) or valid_min is None and valid_max is None:
        return
    if (valid_min is None or fill >= valid_min) and (valid_max is None or fill <= valid_max):
        raise FillValueError(f"the fill {fill!r} lies within the valid range {valid_min!r} to {valid_max!r}")


def choose_code_dtype(n: int) -> str:
    """The smallest signed type that holds the codes of n labels beside a fill."""
    return next(d for d in ("int8", "int16", "int32", "int64") if n <= limits(d)[1] + 1)


def default_categorical_fill(dtype: str) -> int:
    return limits(dtype)[1] if dtype.startswith("u") else -1


# What the format keeps for itself.
RESERVED = frozenset({POSITION, "_index", "CLASS", "VERSION", "NROWS", "GENERATION", "TITLE", "INDEX_COLUMNS", "SEARCH_INDEXES", "CATEGORIES", "OFFSETS", "VALUES", "STRING_VALUES", "CHARS", "MASK", "KIND", "column-order", "encoding-type", "encoding-version"})
ANNOTATIONS = frozenset({"units", "units_vocabulary", "description", "valid_min", "valid_max", "fill_value", "categories", "ordered"})


def validate_name(name: Any, reserved: bool = True) -> str:
    if not isinstance(name, str) or not name or re.search(r"[/\0]", name) or name in (".", ".."):
        raise SchemaError(f"{name!r} cannot be a name")
    if reserved and (name in RESERVED or name.startswith("__")):
        raise ReservedNameError(f"{name!r} is kept for the format")
    return name


def validate_attributes(attributes: dict[str, Any]) -> None:
    for name in attributes:
        validate_name(name)
        if name in ANNOTATIONS:
            raise ReservedNameError(f"{name!r} is an annotation of its own, not an attribute")

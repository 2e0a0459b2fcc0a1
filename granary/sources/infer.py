"""Specifications from values."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import numpy as np

from ..errors import SchemaError
from ..functions import types as t
from ..functions.specs import ColumnSpec, LeafValues, ListColumnSpec, NestedList, Spec, StringValues
from .encode import _plain


def _kind(flat: list[Any]) -> Any:
    if all(isinstance(x, bool) for x in flat):
        return "bool"
    if all(isinstance(x, int) and not isinstance(x, bool) for x in flat):
        return "int64" if max(flat, default=0) <= t.limits("int64")[1] else "uint64"
    if all(isinstance(x, int | float) and not isinstance(x, bool) for x in flat):
        return "float64"
    if all(isinstance(x, str) for x in flat):
        return t.FixedString(max(1, *(len(x.encode()) for x in flat)) if flat else 1)
    if all(isinstance(x, bytes) for x in flat) and len({len(x) for x in flat}) == 1 and flat[0]:
        return t.Opaque(len(flat[0]))
    raise SchemaError(f"no column type holds {flat[:3]!r}")


def from_values(name: str, values: Sequence[Any]) -> Spec:
    if isinstance(values, np.ndarray) and values.dtype.kind in "biufSV" and values.ndim == 1 and values.dtype.names is None:
        return ColumnSpec(name, values.dtype)
    plain = [_plain(x) for x in values]
    flat = [x for x in plain if x is not None]
    if flat and all(isinstance(x, list) for x in flat):
        return ListColumnSpec(name, _list_values(flat), nullable=len(flat) < len(plain))
    return ColumnSpec(name, _kind(flat) if flat else "float64")


def _list_values(lists: list[list[Any]]) -> Any:
    flat = [y for x in lists for y in x]
    some = [y for y in flat if y is not None]
    if some and all(isinstance(y, list) for y in some):
        return NestedList(_list_values(some), nullable=len(some) < len(flat))
    kind = _kind(some) if some else "float64"
    return StringValues(nullable=len(some) < len(flat)) if isinstance(kind, t.FixedString) else LeafValues(kind)

"""Single values and small arrays on the driver: truth values, order, labels."""

from __future__ import annotations

from typing import Any

import numpy as np

from ..errors import ConformanceError, SchemaError
from . import types as t


def is_bool_dtype(dtype: Any) -> bool:
    try:
        return t.logical(dtype) == "bool"
    except SchemaError:
        return False


def is_opaque_dtype(dtype: Any) -> bool:
    try:
        return t.is_opaque(t.logical(dtype))
    except SchemaError:
        return False


def is_fixed_string(dtype: Any) -> bool:
    try:
        return isinstance(t.logical(dtype), t.FixedString)
    except SchemaError:
        return False


def encode_bool(values: Any) -> np.ndarray:
    """Truth values as 0 and 1; anything that is not exactly one of them is refused, missing ones too."""
    got = np.ma.asarray(values)
    if np.ma.getmaskarray(got).any() or got.dtype.kind not in "biuf" or not np.isin(got.data, (0, 1)).all():
        raise SchemaError("truth values are true and false, 0 and 1, and never missing")
    return got.data.astype(np.int8)


def decode_bool(codes: Any) -> np.ndarray:
    got = np.asarray(codes)
    if not np.isin(got, (0, 1)).all():
        raise ConformanceError("a stored truth value is neither 0 nor 1")
    return got.astype(bool)


def is_orderable(dtype: Any) -> bool:
    """Whether values have an order: all but opaque bytes and what has no column type."""
    try:
        return not t.is_opaque(t.logical(dtype))
    except SchemaError:
        return False


def normalize_strings(values: Any, spacepad: bool = False) -> list[bytes]:
    """Text as the bytes by which it is ordered: without padding zeros, and without trailing spaces where those pad."""
    out = [(v.encode() if isinstance(v, str) else bytes(v)).rstrip(b"\0") for v in values]
    return [v.rstrip(b" ") for v in out] if spacepad else out


def min_max(values: Any, fill: Any = None) -> tuple[Any, Any] | None:
    """The bounds of what is present and ordered, or None if nothing is."""
    got = np.ma.asarray(values)
    kept = got.data[~np.ma.getmaskarray(got) & ~t.is_missing(got.data, fill)]
    if kept.dtype.kind == "f":
        kept = kept[~np.isnan(kept)]
    if not len(kept):
        return None
    if kept.dtype.kind in "USO":
        order = sorted(range(len(kept)), key=normalize_strings(kept).__getitem__)
        return kept[order[0]], kept[order[-1]]
    return kept.min(), kept.max()


def n_categories(spec: Any) -> int:
    return len(spec.categories or ())


def is_ordered(spec: Any) -> bool:
    return bool(spec.ordered)

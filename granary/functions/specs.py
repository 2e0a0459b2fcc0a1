"""Declared schemas: columns, lists and tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from ..errors import FilterError, SchemaError
from . import types as t

_UNSET: Any = type("Unset", (), {"__repr__": lambda self: "<recommended>"})()


@dataclass(frozen=True)
class Deflate:
    level: int = 5

    def __post_init__(self) -> None:
        if not 0 <= self.level <= 9:
            raise FilterError("deflate levels go from 0 to 9")


@dataclass(frozen=True)
class Shuffle:
    pass


@dataclass(frozen=True)
class Fletcher32:
    pass


def codec(filters: tuple[Any, ...]) -> str:
    """The Parquet codec that stands for a pipeline of filters."""
    if len({type(f) for f in filters}) < len(filters):
        raise FilterError("a filter is given twice")
    for f in filters:
        if not isinstance(f, Deflate | Shuffle | Fletcher32):
            raise FilterError(f"no filter {f!r}")
    return "zstd" if any(isinstance(f, Deflate) for f in filters) else "snappy"


@dataclass
class ColumnSpec:
    """One value in each row. A categorical column is stored by code and read by label."""

    name: str
    dtype: Any
    fill_value: Any = _UNSET
    categories: list[Any] | None = None
    ordered: bool = False
    units: str | None = None
    units_vocabulary: str | None = None
    description: str | None = None
    valid_min: Any = None
    valid_max: Any = None
    attributes: dict[str, Any] = field(default_factory=dict)
    filters: tuple[Any, ...] = ()
    chunks: int | None = None

    def __post_init__(self) -> None:
        t.validate_name(self.name)
        t.validate_attributes(self.attributes)
        codec(self.filters)
        if self.categories is not None:
            labels = list(self.categories)
            if len(set(labels)) < len(labels) or any(x is None for x in labels):
                raise SchemaError(f"the labels of {self.name!r} must be unique and none missing")
            if len({isinstance(x, str) for x in labels}) > 1:
                raise SchemaError(f"the labels of {self.name!r} must be all text or all numbers")
            self.categories = labels
            self.dtype = t.choose_code_dtype(len(labels)) if self.dtype is None else t.logical(self.dtype)
            if not t.is_integer(self.dtype):
                raise SchemaError(f"codes are integers, not {self.dtype}")
            if self.fill_value is _UNSET:
                self.fill_value = t.default_categorical_fill(self.dtype)
            self.fill_value = t.checked_fill(self.dtype, self.fill_value)
            if 0 <= self.fill_value < len(labels) or len(labels) - 1 > t.limits(self.dtype)[1]:
                raise SchemaError(f"the codes of {self.name!r} need room for {len(labels)} labels beside the fill {self.fill_value}")
            return
        if self.ordered:
            raise SchemaError(f"{self.name!r} has no labels that could be ordered")
        self.dtype = t.logical(self.dtype)
        if self.dtype == "bool":
            if self.fill_value not in (_UNSET, None) or self.valid_min is not None or self.valid_max is not None:
                raise SchemaError(f"{self.name!r} is boolean: never missing, without a fill or a range")
            self.fill_value = None
            return
        self.fill_value = t.recommended_fill(self.dtype) if self.fill_value is _UNSET else self.fill_value
        if self.fill_value is not None:
            self.fill_value = t.checked_fill(self.dtype, self.fill_value)
        t.validate_fill_outside_range(self.fill_value, self.valid_min, self.valid_max)

    @property
    def is_categorical(self) -> bool:
        return self.categories is not None

    @property
    def is_boolean(self) -> bool:
        return self.dtype == "bool"

    @property
    def is_string(self) -> bool:
        return t.is_text(self.dtype)

    @property
    def nullable(self) -> bool:
        return not self.is_boolean

    def resolved_dtype(self) -> t.Logical:
        return self.dtype

    def stored(self) -> T.DataType:
        return t.stored(self.dtype)


@dataclass
class LeafValues:
    """Elements of a list that are single values."""

    dtype: Any
    fill_value: Any = _UNSET

    def __post_init__(self) -> None:
        self.dtype = t.logical(self.dtype)
        if self.dtype == "bool":
            if self.fill_value not in (_UNSET, None):
                raise SchemaError("boolean elements are never missing")
            self.fill_value = None
        else:
            fill = t.recommended_fill(self.dtype) if self.fill_value is _UNSET else self.fill_value
            self.fill_value = None if fill is None else t.checked_fill(self.dtype, fill)

    def stored(self) -> T.DataType:
        return t.stored(self.dtype)


@dataclass
class StringValues:
    """Elements of a list that are text of any length; missing ones only if nullable."""

    nullable: bool = False

    def stored(self) -> T.DataType:
        return T.StringType()


@dataclass
class NestedList:
    """Elements of a list that are lists."""

    values: Any
    nullable: bool = False

    def __post_init__(self) -> None:
        if not isinstance(self.values, LeafValues | StringValues | NestedList):
            raise SchemaError("list values are leaves, strings or lists")

    def stored(self) -> T.DataType:
        return T.ArrayType(self.values.stored(), True)


@dataclass
class ListColumnSpec:
    """A list in each row; a null row only if nullable, which an empty list is not."""

    name: str
    values: Any
    nullable: bool = False
    units: str | None = None
    units_vocabulary: str | None = None
    description: str | None = None
    attributes: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        t.validate_name(self.name)
        t.validate_attributes(self.attributes)
        if not isinstance(self.values, LeafValues | StringValues | NestedList):
            raise SchemaError("list values are leaves, strings or lists")

    def stored(self) -> T.DataType:
        return T.ArrayType(self.values.stored(), True)


Spec = ColumnSpec | ListColumnSpec


@dataclass
class TableSpec:
    columns: list[Spec]
    title: str | None = None
    description: str | None = None
    index_columns: list[str] = field(default_factory=list)
    column_order: list[str] | None = None
    units_vocabulary: str | None = None
    encoding_type: str | None = None
    encoding_version: str | None = None
    chunk_rows: int = 65536
    default_chunk_bytes: int | None = None
    attributes: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        names = [c.name for c in self.columns]
        if len({n.lower() for n in names}) < len(names):
            raise SchemaError("column names repeat (in Spark, also where only their case differs)")
        if self.column_order is not None and sorted(self.column_order) != sorted(names):
            raise SchemaError("the column order is not a permutation of the columns")
        for n in self.index_columns:
            if n not in names or isinstance(self.column(n), ListColumnSpec):
                raise SchemaError(f"{n!r} cannot be an index column")
        if self.chunk_rows < 1 or self.default_chunk_bytes is not None and self.default_chunk_bytes < 1024:
            raise SchemaError("chunks have at least one row and 1024 bytes")
        t.validate_attributes(self.attributes)

    @property
    def ordered_names(self) -> list[str]:
        return list(self.column_order or [c.name for c in self.columns])

    def column(self, name: str) -> Spec:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(name)

    def ordered(self) -> list[Spec]:
        return [self.column(n) for n in self.ordered_names]

    def with_column(self, spec: Spec) -> TableSpec:
        order = None if self.column_order is None else [*self.column_order, spec.name]
        return replace(self, columns=[*self.columns, spec], column_order=order)

    def schema(self) -> T.StructType:
        """How Spark stores it, position first."""
        return T.StructType([T.StructField(t.POSITION, T.LongType(), False), *(T.StructField(c.name, c.stored(), True) for c in self.ordered())])


# JSON forms, for manifests and field metadata


def _value(x: Any) -> Any:
    if t.is_nan(x):
        return {"nan": True}
    if isinstance(x, float) and x in (float("inf"), float("-inf")):
        return {"inf": x > 0}
    if isinstance(x, bytes):
        return {"hex": x.hex()}
    return x.item() if hasattr(x, "item") else x


def _unvalue(x: Any) -> Any:
    if isinstance(x, dict):
        return float("nan") if "nan" in x else (float("inf") if x["inf"] else float("-inf")) if "inf" in x else bytes.fromhex(x["hex"])
    return x


def _dtype(d: t.Logical) -> Any:
    return {"text": d.nbytes, "encoding": d.encoding} if isinstance(d, t.FixedString) else {"opaque": d.nbytes} if isinstance(d, t.Opaque) else d


def _undtype(d: Any) -> t.Logical:
    if isinstance(d, dict):
        return t.FixedString(d["text"], d["encoding"]) if "text" in d else t.Opaque(d["opaque"])
    return d


def _values(v: Any) -> dict[str, Any]:
    if isinstance(v, LeafValues):
        return {"leaf": _dtype(v.dtype), "fill": _value(v.fill_value)}
    if isinstance(v, StringValues):
        return {"strings": v.nullable}
    return {"list": _values(v.values), "nullable": v.nullable}


def _unvalues(v: dict[str, Any]) -> Any:
    if "leaf" in v:
        return LeafValues(_undtype(v["leaf"]), _unvalue(v["fill"]))
    return StringValues(v["strings"]) if "strings" in v else NestedList(_unvalues(v["list"]), v["nullable"])


_TEXTS = ("units", "units_vocabulary", "description")


def to_json(c: Spec) -> dict[str, Any]:
    out: dict[str, Any] = {"name": c.name, **{k: getattr(c, k) for k in _TEXTS}, "attributes": {k: _value(v) for k, v in c.attributes.items()}}
    if isinstance(c, ListColumnSpec):
        return out | {"values": _values(c.values), "nullable": c.nullable}
    filters = [{"deflate": f.level} if isinstance(f, Deflate) else type(f).__name__.lower() for f in c.filters]
    return out | {
        "dtype": _dtype(c.dtype), "fill": _value(c.fill_value), "categories": None if c.categories is None else [_value(x) for x in c.categories],
        "ordered": c.ordered, "valid_min": _value(c.valid_min), "valid_max": _value(c.valid_max), "filters": filters, "chunks": c.chunks,
    }


def from_json(j: dict[str, Any]) -> Spec:
    same = {"name": j["name"], **{k: j[k] for k in _TEXTS}, "attributes": {k: _unvalue(v) for k, v in j["attributes"].items()}}
    if "values" in j:
        return ListColumnSpec(values=_unvalues(j["values"]), nullable=j["nullable"], **same)
    filters = tuple(Deflate(f["deflate"]) if isinstance(f, dict) else Shuffle() if f == "shuffle" else Fletcher32() for f in j["filters"])
    return ColumnSpec(
        dtype=_undtype(j["dtype"]), fill_value=_unvalue(j["fill"]), categories=None if j["categories"] is None else [_unvalue(x) for x in j["categories"]],
        ordered=j["ordered"], valid_min=_unvalue(j["valid_min"]), valid_max=_unvalue(j["valid_max"]), filters=filters, chunks=j["chunks"], **same,
    )


_TABLE = ("title", "description", "index_columns", "column_order", "units_vocabulary", "encoding_type", "encoding_version", "chunk_rows", "default_chunk_bytes")


def table_to_json(s: TableSpec) -> dict[str, Any]:
    return {"columns": [to_json(c) for c in s.columns], **{k: getattr(s, k) for k in _TABLE}, "attributes": {k: _value(v) for k, v in s.attributes.items()}}


def table_from_json(j: dict[str, Any]) -> TableSpec:
    return TableSpec(columns=[from_json(c) for c in j["columns"]], **{k: j[k] for k in _TABLE}, attributes={k: _unvalue(v) for k, v in j["attributes"].items()})

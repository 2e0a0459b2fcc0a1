"""Search indexes: sidecar tables beside the rows, valid while generation and row count are what they were built for.

CHUNK_MINMAX has the bounds of each chunk of positions, SORTED_ROWS the positions in order of value (missing values,
then NaN, last), BITMAP a bitmap of positions for each value. An index never changes an answer: a stale one refuses to
be asked, and queries do without it.
"""

from __future__ import annotations

import uuid
from typing import TYPE_CHECKING, Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConformanceError, SchemaError, StaleIndexError
from ..functions import types as t
from ..functions.specs import ColumnSpec, ListColumnSpec, Spec
from ..plans import compile as compiler
from ..plans.expr import And, Expression, Leaf, Not
from ..plans.plan import LeafPlan
from . import positions

if TYPE_CHECKING:
    from ..sources.frame import Reader
    from ..sources.store import Table

KINDS = ("CHUNK_MINMAX", "SORTED_ROWS", "BITMAP")
ORDERS = ("<", "<=", ">", ">=", "==")


def default_kind(spec: Spec) -> str:
    return "BITMAP" if isinstance(spec, ColumnSpec) and (spec.is_boolean or spec.is_categorical) else "CHUNK_MINMAX"


def check_kind(spec: Spec, kind: str) -> None:
    if kind not in KINDS:
        raise SchemaError(f"no index of kind {kind!r} can be built")
    if isinstance(spec, ListColumnSpec):
        raise SchemaError(f"{spec.name!r} holds lists, which have no order")
    if t.is_opaque(spec.dtype) or spec.dtype == "string" and kind != "BITMAP":
        raise SchemaError(f"{spec.name!r} holds {spec.dtype}, of which no {kind} is built")


def _value(spec: ColumnSpec) -> Column:
    return F.col(f"`{spec.name.replace('`', '``')}`")


def _nan(spec: ColumnSpec, c: Column) -> Column:
    return F.coalesce(F.isnan(c), F.lit(False)) if t.is_float(spec.dtype) else F.lit(False)


def chunk_bounds(rows: DataFrame, spec: ColumnSpec, chunk: int) -> DataFrame:
    """chunk, min and max of what is present and ordered, and how many are NaN, missing, and there at all."""
    c = _value(spec)
    nan = _nan(spec, c)
    ordered = F.when(~nan, c)
    return rows.groupBy(F.floor(F.col(t.POSITION) / chunk).cast("long").alias("chunk")).agg(
        F.min(ordered).alias("min"), F.max(ordered).alias("max"), F.count_if(nan).alias("nan_count"),
        F.count_if(c.isNull()).alias("fill_count"), F.count("*").alias("n"),
    )


def sorted_rows(rows: DataFrame, spec: ColumnSpec) -> DataFrame:
    """rank, value, position, in order of value, then position; tail: 0, missing 1, NaN 2."""
    c = _value(spec)
    tail = F.when(c.isNull(), 1).when(_nan(spec, c), 2).otherwise(0)
    order = rows.select(tail.alias("tail"), c.alias("value"), F.col(t.POSITION).alias("position")).orderBy("tail", "value", "position")
    return order


def bitmaps(rows: DataFrame, spec: ColumnSpec) -> DataFrame:
    """value, bucket, bits: for each value that is present, its positions as bits; bit functions count from one."""
    c = _value(spec)
    at = F.col(t.POSITION) + 1
    here = rows.where(c.isNotNull() & ~_nan(spec, c))
    return here.groupBy(c.alias("value"), F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def built(table: Table, column: str, kind: str, description: str | None, generation: int | None) -> dict[str, Any]:
    """Write a sidecar; its manifest entry."""
    spec = table.specs[column]
    check_kind(spec, kind)
    place = f"index/{uuid.uuid4().hex}"
    to = f"{table.path}/{place}"
    entry = {"column": column, "kind": kind, "dir": place, "description": description, "generation": generation, "nrows": table.nrows, "chunk_rows": table.spec.chunk_rows}
    if kind == "CHUNK_MINMAX":
        chunk_bounds(table.rows, spec, table.spec.chunk_rows).write.parquet(to)
    elif kind == "SORTED_ROWS":
        from ..sources import paths

        ranked, _ = positions.numbered(sorted_rows(table.rows, spec), 0, f"{to}/sorted", "rank")
        ranked.write.parquet(f"{to}/ranked")
        paths.remove(table.spark, f"{to}/sorted")
        counts = {r["tail"]: r["count"] for r in table.spark.read.parquet(f"{to}/ranked").groupBy("tail").count().collect()}
        entry |= {"body": counts.get(0, 0), "fill_tail": counts.get(1, 0), "nan_tail": counts.get(2, 0)}
    else:
        bitmaps(table.rows, spec).write.parquet(to)
        nans = t.is_float(spec.dtype) and not table.rows.where(_nan(spec, _value(spec))).isEmpty()
        entry |= {"exhaustive": not nans}
    return entry


def valid(manifest: dict[str, Any], entry: dict[str, Any]) -> bool:
    g, n = entry.get("generation"), entry.get("nrows")
    return isinstance(g, int) and not isinstance(g, bool) and g == manifest["generation"] and n == manifest["nrows"]


class SearchIndex:
    """What all kinds have. Asking a stale index is an error."""

    def __init__(self, table: Table, name: str, entry: dict[str, Any]):
        self.table, self.name, self.entry = table, name, entry
        self.kind, self.description, self.column_name = entry.get("kind"), entry.get("description"), entry.get("column")
        self.source_generation, self.source_nrows = entry.get("generation"), entry.get("nrows")

    def __repr__(self) -> str:
        return f"<{self.kind} index {self.name!r} of {self.column_name!r}>"

    @property
    def spec(self) -> ColumnSpec:
        return self.table.specs[self.column_name]  # type: ignore[return-value,index]

    @property
    def column(self) -> Any:
        return self.table[self.column_name]

    @property
    def is_valid(self) -> bool:
        return valid(self.table.manifest, self.entry)

    @property
    def ordered(self) -> bool:
        return True

    def _fresh(self) -> None:
        if not self.is_valid:
            raise StaleIndexError(f"index {self.name!r} is of generation {self.source_generation} and {self.source_nrows} rows; refresh_indexes() builds it anew")

    def _path(self) -> str:
        return f"{self.table.path}/{self.entry['dir']}"

    @property
    def data(self) -> DataFrame:
        """The sidecar as it is."""
        return self.table.spark.read.parquet(self._path())

    def _of(self, value: Any) -> Any:
        """A value as it is stored: a label becomes its code, a code stays one."""
        if self.spec.is_categorical and isinstance(value, str):
            code = compiler.code_of(self.spec, value)
            if code is None:
                raise SchemaError(f"{value!r} is no label of {self.column_name!r}")
            return code
        return value

    def _plain(self) -> ColumnSpec:
        """The column by code, for comparisons of what is stored."""
        s = self.spec
        return ColumnSpec(s.name, s.dtype, fill_value=None) if s.is_categorical else s

    def _holds(self, c: Column, op: str, value: Any) -> Column:
        return compiler.leaf_column(c, self._plain(), op, value)

    def _bounds(self, op: str, value: Any) -> list[tuple[str, Any]]:
        """An operator as comparisons that must all hold."""
        if op == "between":
            lo, hi = value
            return [(">=", self._of(lo)), ("<=", self._of(hi))]
        if op not in ORDERS:
            raise SchemaError(f"no operator {op!r}; there are {', '.join(ORDERS)} and between")
        return [("==" if op == "==" else op, self._of(value))]


class ChunkMinMax(SearchIndex):
    @property
    def chunk_len(self) -> int:
        return self.entry["chunk_rows"]

    @property
    def n_chunks(self) -> int:
        return -(-self.source_nrows // self.chunk_len)

    def entries(self) -> DataFrame:
        self._fresh()
        return self.data.orderBy("chunk")

    def chunk_row_range(self, chunk: int) -> tuple[int, int]:
        if not 0 <= chunk < self.n_chunks:
            raise IndexError(f"chunk {chunk} is not among {self.n_chunks}")
        return chunk * self.chunk_len, min(self.source_nrows, (chunk + 1) * self.chunk_len)

    def pruned(self, op: str, value: Any) -> DataFrame:
        """The chunks that could hold a match."""
        self._fresh()
        low, high = F.col("min"), F.col("max")
        out = F.lit(True)
        for o, v in self._bounds(op, value):
            if o in ("<", "<=", "=="):
                out = out & self._holds(low, "<" if o == "<" else "<=", v)
            if o in (">", ">=", "=="):
                out = out & self._holds(high, ">" if o == ">" else ">=", v)
        if op == "between" and _reversed(*value):
            out = F.lit(False)
        return self.data.where(out).select("chunk")

    def ranges(self, op: str, value: Any, most: int) -> list[tuple[int, int]]:
        """The first and last chunk of each run of chunks that could hold a match. Runs are found by Spark, and no more than
        ``most`` of them reach the driver: of more, what comes back is one from the first chunk to the last."""
        chunks = self.pruned(op, value)

        def ends(step: int) -> list[int]:
            beside = chunks.select((F.col("chunk") + step).alias("chunk"))
            return [r[0] for r in chunks.join(beside, "chunk", "left_anti").orderBy("chunk").limit(most + 1).collect()]

        first = ends(1)
        if len(first) > most:
            low, high = chunks.agg(F.min("chunk"), F.max("chunk")).first()
            return [(low, high)]
        return list(zip(first, ends(-1), strict=True))

    def prune(self, op: str, value: Any) -> np.ndarray:
        """The numbers of those chunks, on the driver."""
        return np.array([r[0] for r in self.pruned(op, value).orderBy("chunk").collect()], np.int64)


def _reversed(lo: Any, hi: Any) -> bool:
    try:
        return lo > hi
    except TypeError:
        return False


class SortedRows(SearchIndex):
    @property
    def data(self) -> DataFrame:
        return self.table.spark.read.parquet(f"{self._path()}/ranked")

    @property
    def nan_tail_length(self) -> int:
        return self.entry["nan_tail"]

    @property
    def fill_tail_length(self) -> int:
        return self.entry["fill_tail"]

    def permutation(self) -> DataFrame:
        """rank, position of all rows, tails last."""
        self._fresh()
        return self.data.select("rank", "position")

    def found(self, op: str, value: Any) -> DataFrame:
        """rank, position of the rows that match."""
        self._fresh()
        c, out = F.col("value"), F.col("tail") == 0
        for o, v in self._bounds(op, value):
            out = out & self._holds(c, o, v)
        return self.data.where(out).select("rank", "position")

    def rows(self, op: str, value: Any) -> np.ndarray:
        """Positions in order of value."""
        return np.array([r[0] for r in self.found(op, value).orderBy("rank").select("position").collect()], np.int64)


class Bitmap(SearchIndex):
    @property
    def exhaustive(self) -> bool:
        """Whether every row that is present has its bit: not so if some are NaN."""
        return bool(self.entry["exhaustive"])

    def values(self) -> list[Any]:
        """The distinct values that are present, as stored, in order."""
        self._fresh()
        return [r[0] for r in self.data.select("value").distinct().orderBy("value").collect()]

    def _places(self, where: Column) -> DataFrame:
        # a row of the result is a position: bytes without a bit are passed over within their bitmap
        byte = F.transform(F.sequence(F.lit(1), F.octet_length("bits")), lambda i: F.struct(i.alias("at"), F.hex(F.substring("bits", i, F.lit(1))).alias("hex")))
        lit = F.filter(byte, lambda x: x["hex"] != "00")
        each = F.transform(lit, lambda x: F.struct(((x["at"] - 1) * 8).alias("at"), F.conv(x["hex"], 16, 10).cast("int").alias("byte")))
        bits = F.flatten(F.transform(each, lambda x: F.transform(F.filter(F.array(*map(F.lit, range(8))), lambda b: F.call_function("shiftright", x["byte"], b).bitwiseAND(1) == 1), lambda b: x["at"] + b)))
        # buckets hold 32768 positions and count from one, as positions here do from one
        return self.data.where(where).select("bucket", F.explode(bits).alias("bit")).select(((F.col("bucket") - 1) * 32768 + F.col("bit")).cast("long").alias("position"))

    def found(self, values: list[Any]) -> DataFrame:
        self._fresh()
        known = []
        for v in values:
            if self.spec.is_categorical and isinstance(v, str):
                v = compiler.code_of(self.spec, v)
                if v is None:
                    continue
            known.append(v)
        if not known:
            return self._places(F.lit(False))
        return self._places(compiler.leaf_column(F.col("value"), self._plain(), "in", tuple(known)))

    def rows(self, value: Any) -> np.ndarray | None:
        """Ascending positions of a value; None if the index cannot know, since it is not exhaustive and has no such value."""
        return self.isin([value])

    def isin(self, values: Any) -> np.ndarray | None:
        got = np.array([r[0] for r in self.found(list(values)).orderBy("position").collect()], np.int64)
        return None if not len(got) and not self.exhaustive else got


_CLASSES = {"CHUNK_MINMAX": ChunkMinMax, "SORTED_ROWS": SortedRows, "BITMAP": Bitmap}


def opened(table: Table, name: str, entry: dict[str, Any]) -> SearchIndex:
    if entry.get("column") not in table.specs:
        raise ConformanceError(f"index {name!r} is of no column")
    return _CLASSES.get(entry.get("kind"), SearchIndex)(table, name, entry)


def access(table: Reader, leaf: Leaf, negated: bool) -> LeafPlan:
    """How one comparison would be answered."""
    spec, text = table.specs[leaf.name], repr(leaf)
    if isinstance(spec, ColumnSpec) and spec.is_categorical and leaf.op in ("==", "in"):
        labels = leaf.value if leaf.op == "in" else (leaf.value,)
        if not negated and all(compiler.code_of(spec, x) is None for x in labels):
            return LeafPlan(text, negated, "no such label")
    have = table.valid_indexes(leaf.name)
    order = {"in": ("BITMAP",), "==": ("SORTED_ROWS", "BITMAP", "CHUNK_MINMAX"), "null": (), "valid": ()}.get(leaf.op, ("SORTED_ROWS", "CHUNK_MINMAX"))
    if not negated:
        for kind in order:
            if kind in have and not (kind == "BITMAP" and not have[kind].exhaustive):
                return LeafPlan(text, negated, kind, have[kind].name)
    return LeafPlan(text, negated, "scan")


def answered(table: Reader, e: Expression | None) -> DataFrame | None:
    """The positions that match, from sidecars alone; None if some comparison has no valid index that could say."""
    if e is None or isinstance(e, Not):
        return None
    if not isinstance(e, Leaf):
        parts = [answered(table, x) for x in e.parts]
        if any(x is None for x in parts):
            return None
        out = parts[0]
        for x in parts[1:]:
            out = out.join(x, "position", "left_semi") if isinstance(e, And) else out.unionByName(x).distinct()
        return out
    spec, have = table.specs[e.name], table.valid_indexes(e.name)
    if isinstance(spec, ListColumnSpec) or e.op in ("null", "valid"):
        return None
    holds = compiler.leaf_column(F.col("value"), spec, e.op, e.value)
    if e.op in ("==", "in") and "BITMAP" in have and have["BITMAP"].exhaustive:
        return have["BITMAP"]._places(holds)
    if "SORTED_ROWS" in have:
        return have["SORTED_ROWS"].data.where((F.col("tail") == 0) & holds).select("position")
    return None


#: More runs of chunks than this make a predicate that costs more than it saves; it then has their bounds alone.
MOST_RANGES = 64


def candidates(table: Reader, e: Expression | None) -> Column | None:
    """The ranges of positions in which chunk bounds allow all the comparisons that must hold; None if they say nothing."""
    must = [] if e is None else list(e.parts) if isinstance(e, And) else [e]
    out = None
    for leaf in must:
        if not isinstance(leaf, Leaf) or leaf.op not in ORDERS:
            continue
        index = table.valid_indexes(leaf.name).get("CHUNK_MINMAX")
        if index is None or index.spec.is_categorical:
            continue
        near = F.lit(False)
        for lo, hi in index.ranges(leaf.op, leaf.value, MOST_RANGES):
            near = near | F.col(t.POSITION).between(lo * index.chunk_len, (hi + 1) * index.chunk_len - 1)
        out = near if out is None else out & near
    return out

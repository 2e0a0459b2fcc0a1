"""Reading: a schema over rows with positions, its columns, and selections of its rows.

Everything is a lazy DataFrame until ``read``, ``count``, ``row_positions`` or ``to_arrow`` asks for it. Only what is
asked for by position is sorted. Any DataFrame with a column of positions can be read this way.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Mapping
from typing import TYPE_CHECKING, Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConformanceError, SchemaError
from ..functions import types as t
from ..functions.specs import ColumnSpec, ListColumnSpec, Spec, TableSpec, to_json
from ..operators import positions
from ..plans import compile as compiler
from ..plans.expr import Expression, leaves, terms
from ..plans.plan import LeafPlan, QueryPlan

if TYPE_CHECKING:
    from . import arrow_io


def quoted(name: str) -> SparkColumn:
    return F.col(f"`{name.replace('`', '``')}`")


def decoded(spec: Spec) -> SparkColumn:
    """A column as users see it: labels in place of codes; a code without a label is an error."""
    c = quoted(spec.name)
    if isinstance(spec, ColumnSpec) and spec.is_categorical:
        labels, code = spec.categories or [], c.cast("int")
        bad = F.raise_error(F.concat(F.lit(f"{spec.name}: no label for code "), code.cast("string")))
        label = F.element_at(F.array(*map(F.lit, labels)), code + 1) if labels else F.lit(None).cast("string")
        return F.when(code.between(0, len(labels) - 1), label).when(c.isNotNull(), bad).alias(spec.name)
    return c.alias(spec.name)


def filled(spec: Spec) -> SparkColumn:
    """As decoded, with the fill in place of missing values; labels stay missing."""
    if isinstance(spec, ColumnSpec) and not spec.is_categorical and spec.fill_value is not None:
        return F.coalesce(quoted(spec.name), t.constant(spec.dtype, spec.fill_value)).alias(spec.name)
    return decoded(spec)


def described(df: DataFrame, specs: Mapping[str, Spec]) -> DataFrame:
    """df with each column's specification in its metadata."""
    return df.select(*(quoted(c).alias(c, metadata={"granary": to_json(specs[c])}) if c in specs else quoted(c) for c in df.columns))


def masked_array(values: pa.ChunkedArray, spec: Spec, masked: bool) -> Any:
    """Values on the driver: a masked array, lists of lists, or plain arrays with fills."""
    if isinstance(spec, ListColumnSpec):
        return values.to_pylist()
    gone = values.is_null().to_numpy().astype(bool)
    if spec.is_categorical or spec.is_string or t.is_opaque(spec.dtype):
        out = np.empty(len(values), object)
        out[:] = values.to_pylist()
    else:
        kind = np.dtype("bool" if spec.is_boolean else spec.dtype)
        fill = 0 if spec.fill_value is None or spec.is_boolean else spec.fill_value
        if pa.types.is_decimal(values.type):  # unsigned 64-bit integers
            out = np.array([fill if x is None else int(x) for x in values.to_pylist()], kind)
        else:
            out = values.fill_null(False if spec.is_boolean else 0).to_numpy().astype(kind)
            out[gone] = fill
    return np.ma.MaskedArray(out, mask=gone) if masked else out


class Reader:
    """Rows with positions from 0 to nrows - 1 under a schema."""

    def __init__(self, spark: SparkSession, spec: TableSpec, rows: DataFrame, nrows: int | None = None):
        self.spark, self.spec, self._rows, self._nrows = spark, spec, rows, nrows

    # catalogue

    @property
    def rows(self) -> DataFrame:
        """All rows as stored, with their positions."""
        return self._rows

    @property
    def nrows(self) -> int:
        if self._nrows is None:
            self._nrows = self.rows.count()
        return self._nrows

    @property
    def specs(self) -> dict[str, Spec]:
        return {c.name: c for c in self.spec.ordered()}

    @property
    def column_names(self) -> list[str]:
        return self.spec.ordered_names

    @property
    def columns(self) -> list[Column | ListColumn]:
        return [self[c] for c in self.column_names]

    def __getitem__(self, name: str) -> Column | ListColumn:
        spec = self.specs[name]
        return ListColumn(self, spec) if isinstance(spec, ListColumnSpec) else Column(self, spec)

    def __contains__(self, name: object) -> bool:
        return name in self.specs

    def __iter__(self) -> Iterator[str]:
        return iter(self.column_names)

    def __len__(self) -> int:
        return len(self.column_names)

    def __repr__(self) -> str:
        return f"<{type(self).__name__} {self.spec.title or ''!r}: {', '.join(self.column_names)}>"

    @property
    def title(self) -> str | None:
        return self.spec.title

    @property
    def description(self) -> str | None:
        return self.spec.description

    @property
    def index_columns(self) -> list[str]:
        return list(self.spec.index_columns)

    @property
    def units_vocabulary(self) -> str | None:
        return self.spec.units_vocabulary

    @property
    def encoding(self) -> tuple[str | None, str | None]:
        """The type and the version of the encoding that the table says it has."""
        return self.spec.encoding_type, self.spec.encoding_version

    @property
    def attributes(self) -> dict[str, Any]:
        return dict(self.spec.attributes)

    # reading

    def names(self, columns: list[str] | None) -> list[str]:
        wanted = list(dict.fromkeys(self.column_names if columns is None else columns))
        for c in wanted:
            if c not in self.specs:
                raise KeyError(c)
        return wanted

    def project(self, df: DataFrame, columns: list[str] | None = None, masked: bool = True, position: bool = False) -> DataFrame:
        wanted = [(decoded if masked else filled)(self.specs[c]) for c in self.names(columns)]
        return df.select(*([F.col(t.POSITION)] if position else []), *wanted)

    @property
    def df(self) -> DataFrame:
        """All rows as users see them, with each column's specification as metadata."""
        return described(self.project(self.rows), self.specs)

    def select(self, where: Any = None) -> Selection:
        return Selection(self, where)

    def read(self, columns: list[str] | None = None, where: Any = None, explain: bool = False, masked: bool = True) -> Any:
        s = self.select(where)
        out = s.read(columns, masked)
        return (out, s.explain()) if explain else out

    def count(self, where: Any = None) -> int:
        return self.nrows if where is None else self.select(where).count()

    def to_arrow(self, columns: list[str] | None = None, where: Any = None) -> pa.Table:
        return self.select(where).to_arrow(columns)

    def to_arrow_batches(self, columns: list[str] | None = None, where: Any = None) -> arrow_io.Batches:
        """As ``to_arrow``, for tables of any size: the rows stay with the executors."""
        return self.select(where).to_arrow_batches(columns)

    def read_rows(self, rows: Any, columns: list[str] | None = None, masked: bool = True) -> dict[str, Any]:
        return self.collected(*positions.chosen(self.rows, rows, self.nrows), columns, masked)

    def rows_at(self, rows: Any, columns: list[str] | None = None) -> DataFrame:
        """As ``read_rows``, but as a DataFrame in the order asked for."""
        df, order = positions.chosen(self.rows, rows, self.nrows)
        return df.orderBy(*order).select(*(decoded(self.specs[c]) for c in self.names(columns)))

    def collected(self, df: DataFrame, order: list[SparkColumn], columns: list[str] | None, masked: bool) -> dict[str, Any]:
        wanted = self.names(columns)
        got = df.orderBy(*order).select(*((decoded if masked else filled)(self.specs[c]) for c in wanted)).toArrow()
        return {c: masked_array(got.column(k), self.specs[c], masked) for k, c in enumerate(wanted)}

    def matching(self, e: Expression) -> DataFrame:
        """The rows that match a validated predicate."""
        return self.rows.where(compiler.column(e, self.specs))

    # what indexes know, for those that have any

    def valid_indexes(self, name: str) -> dict[str, Any]:
        return {}


class Selection:
    """The rows that match, decided when first asked for; a query, not a snapshot."""

    def __init__(self, table: Reader, where: Any):
        from ..plans.expr import normalised

        self.table, self.where = table, normalised(where)

    @functools.cached_property
    def expression(self) -> Expression | None:
        return compiler.validated(self.where, self.table.specs)

    @functools.cached_property
    def rows(self) -> DataFrame:
        """Matching rows as stored, with positions, in no order."""
        e = self.expression
        return self.table.rows if e is None else self.table.matching(e)

    @property
    def df(self) -> DataFrame:
        return described(self.table.project(self.rows), self.table.specs)

    def pruned(self) -> DataFrame:
        """As ``rows``, asking valid indexes first which chunks could match; the answer is the same."""
        from ..operators import indexes

        near = indexes.candidates(self.table, self.expression)
        return self.rows if near is None else self.rows.where(near)

    @functools.cached_property
    def positions(self) -> DataFrame:
        """The positions that match, in no order: from indexes alone where they know, else from the rows."""
        from ..operators import indexes

        known = indexes.answered(self.table, self.expression)
        return self.pruned().select(F.col(t.POSITION).alias("position")) if known is None else known

    @functools.cached_property
    def row_positions(self) -> np.ndarray:
        return self.positions.orderBy("position").toArrow().column(0).to_numpy().astype(np.int64)

    @functools.cached_property
    def _count(self) -> int:
        return self.table.nrows if self.expression is None else self.positions.count()

    def count(self) -> int:
        return self._count

    def __len__(self) -> int:
        return self._count

    def __repr__(self) -> str:
        return f"<Selection of {self.table!r} where {self.where!r}>"

    def read(self, columns: list[str] | None = None, masked: bool = True) -> dict[str, Any]:
        return self.table.collected(self.pruned(), [F.col(t.POSITION)], columns, masked)

    def to_arrow(self, columns: list[str] | None = None) -> pa.Table:
        from . import arrow_io

        wanted = self.table.names(columns)
        got = self.pruned().orderBy(t.POSITION).select(*(quoted(c) for c in wanted)).toArrow()
        return arrow_io.exported(got, [self.table.specs[c] for c in wanted], self.table.spec)

    def to_arrow_batches(self, columns: list[str] | None = None) -> arrow_io.Batches:
        from . import arrow_io

        wanted, rows = self.table.names(columns), self.pruned()
        stored = [quoted(c) for c in wanted]
        return arrow_io.Batches(rows.select(*stored), rows.orderBy(t.POSITION).select(*stored), [self.table.specs[c] for c in wanted], self.table.spec)

    def explain(self) -> QueryPlan:
        from ..operators import indexes

        e = self.expression
        plans = [] if e is None else [indexes.access(self.table, leaf, negated) for leaf, negated in leaves(e)]
        spark = self.rows._jdf.queryExecution().simpleString() if e is not None else ""
        return QueryPlan(tuple(plans), 1 if e is None else terms(e), self.count(), None, spark)


class _Named:
    def __init__(self, table: Reader, spec: Any):
        self.table, self.spec = table, spec
        self.name, self.units, self.units_vocabulary, self.description = spec.name, spec.units, spec.units_vocabulary, spec.description
        self.attributes = dict(spec.attributes)

    def __len__(self) -> int:
        return self.table.nrows

    def __repr__(self) -> str:
        return f"<{type(self).__name__} {self.name!r}>"

    def read(self, masked: bool = True) -> Any:
        return self.table.read([self.name], masked=masked)[self.name]

    def __iter__(self) -> Iterator[Any]:
        # rows come in ranges of positions, each sorted on its own: one partition at a time reaches the driver
        rows = self.table.rows.select(t.POSITION, decoded(self.spec)).orderBy(t.POSITION)
        return (r[1] for r in rows.toLocalIterator())

    def read_rows(self, rows: Any, masked: bool = True) -> Any:
        return self.table.read_rows(rows, [self.name], masked)[self.name]

    def __getitem__(self, key: Any) -> Any:
        if isinstance(key, slice) or not isinstance(key, tuple) and np.ndim(key) == 1:
            return self.read_rows(key)
        at = positions.row_number(key, self.table.nrows)
        return self.read_rows([at])[0]

    def is_missing(self) -> np.ndarray:
        got = self.table.rows.select(t.POSITION, quoted(self.name).isNull().alias("gone")).orderBy(t.POSITION).toArrow()
        return np.array(got.column(1).to_pylist(), bool)

    def to_arrow(self, rows: Any = None) -> pa.ChunkedArray:
        from . import arrow_io

        df, order = (self.table.rows, [F.col(t.POSITION)]) if rows is None else positions.chosen(self.table.rows, rows, self.table.nrows)
        got = df.orderBy(*order).select(quoted(self.name)).toArrow()
        return arrow_io.exported(got, [self.spec], None).column(0)


class Column(_Named):
    """One value in each row."""

    def __init__(self, table: Reader, spec: ColumnSpec):
        super().__init__(table, spec)
        self.dtype, self.ordered, self.valid_min, self.valid_max = spec.dtype, spec.ordered, spec.valid_min, spec.valid_max
        self.is_boolean, self.is_string, self.is_categorical = spec.is_boolean, spec.is_string, spec.is_categorical
        self.categories = None if spec.categories is None else list(spec.categories)
        self.fill_value = spec.fill_value

    @property
    def search_indexes(self) -> dict[str, Any]:
        """The indexes of this column, stale ones too, by name."""
        return {name: x for name, x in getattr(self.table, "search_indexes", {}).items() if x.column_name == self.name}

    def add_search_index(self, kind: str | None = None, name: str | None = None, description: str | None = None) -> Any:
        return self.table.add_search_index(self.name, kind, name, description)  # type: ignore[attr-defined]

    build_index = add_search_index

    @property
    def codes(self) -> np.ndarray:
        """Codes in place of labels; the fill where missing."""
        if not self.is_categorical:
            raise SchemaError(f"{self.name!r} has no codes")
        got = self.table.rows.orderBy(t.POSITION).select(F.coalesce(quoted(self.name), t.constant(self.dtype, self.fill_value))).toArrow()
        return np.array([int(x) for x in got.column(0).to_pylist()], self.dtype)


class ListColumn(_Named):
    """A list in each row."""

    def __init__(self, table: Reader, spec: ListColumnSpec):
        super().__init__(table, spec)
        self.nullable = spec.nullable


class Foreign(Reader):
    """Rows of any DataFrame. Predicates are on its columns as they come, so that its scan sees them."""

    def __init__(self, spec: TableSpec, df: DataFrame, position: str):
        from . import encode

        given = {f.name: f.dataType for f in df.schema.fields}
        self._given = df
        self._source = {c.name: (quoted(c.name), given[c.name], encode.stored_column(c, quoted(c.name), given=given[c.name])) for c in spec.ordered()}
        self._stored = [quoted(position).cast("long").alias(t.POSITION), *(x[2].alias(name) for name, x in self._source.items())]
        super().__init__(df.sparkSession, spec, df.select(*self._stored))

    def matching(self, e: Expression) -> DataFrame:
        return self._given.where(compiler.over_source(e, self.specs, self._source)).select(*self._stored)


def over(df: DataFrame, specs: list[Spec] | TableSpec, position: str) -> Reader:
    """A reader of any DataFrame whose column ``position`` numbers its rows from 0 on. Categorical columns hold
    labels, which become codes; what equals a fill becomes missing. A value that its column cannot hold is an error
    wherever the column is read; rows that a predicate leaves out are not."""
    spec = specs if isinstance(specs, TableSpec) else TableSpec(list(specs))
    for c in spec.ordered():
        if c.name not in df.columns:
            raise ConformanceError(f"there is no column {c.name!r}")
    return Foreign(spec, df, position)

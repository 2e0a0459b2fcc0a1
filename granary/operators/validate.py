"""Whether a stored table keeps the rules of the format; deep: whether its indexes say what its rows say."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConformanceError
from ..functions import types as t
from ..functions.specs import ColumnSpec, ListColumnSpec
from . import indexes

if TYPE_CHECKING:
    from ..sources.store import Table


def _need(ok: bool, text: str) -> None:
    if not ok:
        raise ConformanceError(text)


def _manifest(table: Table) -> None:
    m = table.manifest
    _need(isinstance(m["nrows"], int) and m["nrows"] >= 0, "the number of rows is no number")
    _need(m["generation"] is None or isinstance(m["generation"], int) and m["generation"] >= 1, "the generation is no number")
    at = 0
    for p in m["parts"]:
        _need(p["start"] == at and p["start"] <= p["stop"] <= p["end"], f"part {p['dir']} does not follow position {at}")
        at = p["stop"]
    _need(at == m["nrows"], f"the parts hold {at} rows, not {m['nrows']}")
    for name in table.spec.index_columns:
        _need(isinstance(table.specs.get(name), ColumnSpec), f"{name!r} cannot be an index column")
    for name, x in m["indexes"].items():
        _need(x.get("column") in table.specs, f"index {name!r} is of no column")
        _need(not isinstance(table.specs[x["column"]], ListColumnSpec), f"index {name!r} is of a list column")
        _need(isinstance(x.get("nrows"), int) and isinstance(x.get("generation"), int), f"index {name!r} has no tokens")


def _repeated(rows: DataFrame, column: str) -> bool:
    return not rows.groupBy(column).count().where("count > 1").isEmpty()


def _rows(table: Table, deep: bool) -> None:
    """One pass: positions, codes, truth values, fills that were not made missing, text that is too long. Positions by their
    number, bounds, sum and parity, which most damage changes; deep: that none is there twice, which settles it."""
    n = table.nrows
    parity = [n - 1, 1, n, 0][(n - 1) % 4] if n else 0
    total = F.sum(F.col(t.POSITION).cast("decimal(38,0)"))
    tests = {
        "positions beyond the rows": F.count_if(~F.col(t.POSITION).between(0, n - 1)),
        "positions that repeat": ((total != F.lit(str(n * (n - 1) // 2)).cast("decimal(38,0)")) | (F.bit_xor(t.POSITION) != parity)).cast("int"),
    }
    for c in table.spec.columns:
        if isinstance(c, ListColumnSpec):
            if not c.nullable:
                tests[f"missing lists in {c.name!r}"] = F.count_if(F.col(f"`{c.name}`").isNull())
            continue
        col = F.col(f"`{c.name}`")
        if c.is_boolean:
            tests[f"missing truth values in {c.name!r}"] = F.count_if(col.isNull())
        elif c.is_categorical:
            tests[f"codes without labels in {c.name!r}"] = F.count_if(~col.between(0, len(c.categories or []) - 1))
        elif c.fill_value is not None:
            gone = t.missing_to_null(col, c.dtype, c.fill_value)
            tests[f"fills stored as values in {c.name!r}"] = F.count_if(col.isNotNull() & gone.isNull())
        if isinstance(c.dtype, t.FixedString):
            tests[f"text beyond its budget in {c.name!r}"] = F.count_if(F.octet_length(col) > c.dtype.nbytes)
        if t.is_opaque(c.dtype):
            tests[f"bytes of another length in {c.name!r}"] = F.count_if(F.octet_length(col) != c.dtype.nbytes)
    got = table.rows.agg(F.count("*").alias("n"), *(v.alias(f"t{k}") for k, v in enumerate(tests.values()))).first()
    _need(got["n"] == table.nrows, f"there are {got['n']} rows, not {table.nrows}")
    for k, what in enumerate(tests):
        _need(not got[f"t{k}"], f"{what}: {got[f't{k}']}")
    _need(not deep or not _repeated(table.rows, t.POSITION), "positions that repeat")


def _same(name: str, a, b) -> None:
    _need(a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), f"index {name!r} does not say what the rows say")


def _index(table: Table, index: indexes.SearchIndex, deep: bool) -> None:
    if not index.is_valid or index.kind not in indexes.KINDS:
        return  # what is stale or of another kind says nothing
    spec = index.spec
    if isinstance(index, indexes.ChunkMinMax):
        got = index.data.agg(F.count("*"), F.count_distinct("chunk"), F.sum("n")).first()
        _need(got[0] == got[1] == index.n_chunks and (got[2] or 0) == table.nrows, f"index {index.name!r} does not have a row for each chunk")
        if deep:
            names = ["chunk", "min", "max", "nan_count", "fill_count", "n"]
            _same(index.name, index.data.select(names), indexes.chunk_bounds(table.rows, spec, index.chunk_len).select(names))
    elif isinstance(index, indexes.SortedRows):
        got = index.data.agg(F.count("*"), F.max("rank"), F.sum("position"), F.bit_xor("position")).first()
        want = table.rows.agg(F.count("*"), F.max(t.POSITION), F.sum(t.POSITION), F.bit_xor(t.POSITION)).first()
        _need(got[0] == table.nrows and (got[1] or 0) == max(0, table.nrows - 1) and tuple(got)[2:] == tuple(want)[2:], f"index {index.name!r} is no permutation")
        if deep:
            _need(not _repeated(index.data, "position"), f"index {index.name!r} is no permutation")
            _same(index.name, index.data.select("tail", "value", "position"), indexes.sorted_rows(table.rows, spec))
            # ranks follow (tail, value, position): each differs from the one before it in the right way
            both = index.data.alias("a").join(index.data.alias("b"), F.expr("a.rank + 1 = b.rank"))
            after = F.expr("struct(a.tail, a.value, a.position) < struct(b.tail, b.value, b.position)")
            _need(both.where(~after).isEmpty(), f"index {index.name!r} is out of order")
    elif isinstance(index, indexes.Bitmap):
        got = index.data.agg(F.sum(F.bitmap_count("bits"))).first()[0] or 0
        col = F.col(f"`{spec.name}`")
        present = col.isNotNull() & ~indexes._nan(spec, col)
        _need(got == table.rows.where(present).count(), f"index {index.name!r} does not have a bit for each row")
        if deep:
            _same(index.name, index.data.select("value", "bucket", "bits"), indexes.bitmaps(table.rows, spec))


def validate(table: Table, deep: bool = False) -> None:
    _manifest(table)
    _rows(table, deep)
    for index in table.search_indexes.values():
        _index(table, index, deep)

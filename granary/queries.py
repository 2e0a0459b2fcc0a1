"""The library's operators over the driver's tables, and the same in SQL.

``events`` numbers its rows by event_id, so it stands for a table with positions. Missing values and NaN are made
from it by the same rule on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ColumnSpec, FixedString, LeafValues, ListColumnSpec, Table, field, over
from .functions import types as t
from .operators import indexes, positions
from .sources import paths
from .sources.frame import Reader

NAN = float("nan")
LEVELS = ["4-NOT SPECIFIED", "5-LOW", "3-MEDIUM", "2-HIGH", "1-URGENT"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Tables that are only filtered have no use for positions: a constant stands in their place and is pruned.


def _lineitem(spark: SparkSession, sf: str) -> Reader:
    numbers = [ColumnSpec(c, "float64") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    keys = [ColumnSpec(c, "int64") for c in ("l_orderkey", "l_partkey", "l_suppkey")]
    rest = [ColumnSpec("l_linenumber", "int32"), ColumnSpec("l_returnflag", "string"), ColumnSpec("l_linestatus", "string")]
    return over(_read(spark, sf, "lineitem").withColumn("__p", F.lit(0)), [*keys, *rest, *numbers], "__p")


def _orders(spark: SparkSession, sf: str) -> Reader:
    specs = [ColumnSpec("o_orderkey", "int64"), ColumnSpec("o_custkey", "int64"), ColumnSpec("o_totalprice", "float64"), ColumnSpec("o_orderstatus", None, categories=["F", "O", "P"]), ColumnSpec("o_orderpriority", None, categories=LEVELS, ordered=True)]
    return over(_read(spark, sf, "orders").withColumn("__p", F.lit(0)), specs, "__p")


def _events(spark: SparkSession, sf: str, value: F.Column | None = None, fill: Any = NAN) -> Reader:
    df = _read(spark, sf, "events")
    df = df if value is None else df.withColumn("value", value)
    return over(df, [ColumnSpec("event_id", "int64"), ColumnSpec("user_id", "int64"), ColumnSpec("value", "float64", fill_value=fill), ColumnSpec("event_type", FixedString(16))], "event_id")


def _holed() -> F.Column:
    """Every tenth value is missing."""
    return F.when(F.col("event_id") % 10 == 0, F.lit(NAN)).otherwise(F.col("value"))


HOLED = "SELECT event_id, user_id, event_type, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS value FROM events"
#: Present NaN: the fill is another value.
NANNED = "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE ELSE value END AS value FROM events"


def _nanned(spark: SparkSession, sf: str) -> Reader:
    return _events(spark, sf, F.when(F.col("event_id") % 7 == 0, F.lit(NAN)).otherwise(F.col("value")), -1e300)


def _where(table: Reader, where: Any, *columns: str) -> DataFrame:
    return table.project(table.select(where).rows, list(columns))


# scans and projections


@_query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return _where(_lineitem(spark, sf), (field("l_quantity") >= 45) & (field("l_discount") < 0.03), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@_query("SELECT o_orderkey, o_totalprice FROM orders")
def scan_project(spark: SparkSession, sf: str) -> DataFrame:
    return _where(_orders(spark, sf), None, "o_orderkey", "o_totalprice", "o_orderkey")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'")
def filter_eq(spark: SparkSession, sf: str) -> DataFrame:
    return _where(_lineitem(spark, sf), field("l_returnflag") == "R", "l_orderkey", "l_linenumber")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R'")
def filter_ne(spark: SparkSession, sf: str) -> DataFrame:
    return _where(_lineitem(spark, sf), field("l_returnflag") != "R", "l_orderkey", "l_linenumber")


@_query("SELECT l_orderkey, l_linenumber, l_tax FROM lineitem WHERE l_tax > 0.02 AND l_tax <= 0.06")
def filter_range(spark: SparkSession, sf: str) -> DataFrame:
    return _where(_lineitem(spark, sf), (field("l_tax") > 0.02) & (field("l_tax") <= 0.06), "l_orderkey", "l_linenumber", "l_tax")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 2 OR NOT (l_returnflag = 'N')")
def filter_or_not(spark: SparkSession, sf: str) -> DataFrame:
    return _where(_lineitem(spark, sf), (field("l_quantity") < 2) | ~(field("l_returnflag") == "N"), "l_orderkey", "l_linenumber")


@_query("SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 2, 3, 5, 8, 13, 21)")
def filter_isin(spark: SparkSession, sf: str) -> DataFrame:
    return _where(_orders(spark, sf), field("o_custkey").isin([1, 2, 3, 5.0, 8, 13, 21, 2.5, 2**80]), "o_orderkey")


@_query(f"SELECT event_id FROM ({HOLED}) WHERE event_type NOT IN ('view', 'click')")
def filter_not_isin(spark: SparkSession, sf: str) -> DataFrame:
    return _where(_events(spark, sf, _holed()), ("event_type", "not in", ["view", "click"]), "event_id")


@_query("SELECT event_id FROM events WHERE FALSE")
def isin_empty(spark: SparkSession, sf: str) -> DataFrame:
    return _where(_events(spark, sf, _holed()), field("value").isin([]), "event_id")


@_query(f"SELECT event_id FROM ({HOLED}) WHERE value IS NOT NULL")
def not_isin_empty(spark: SparkSession, sf: str) -> DataFrame:
    return _where(_events(spark, sf, _holed()), ~field("value").isin([]), "event_id")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity < 3 AND l_returnflag IN ('A', 'R')) OR (l_discount = 0.1 AND l_linestatus <> 'F')")
def dnf_tuples(spark: SparkSession, sf: str) -> DataFrame:
    where = [[("l_quantity", "<", 3), ("l_returnflag", "in", ("A", "R"))], [("l_discount", "=", 0.1), ("l_linestatus", "!=", "F")]]
    return _where(_lineitem(spark, sf), where, "l_orderkey", "l_linenumber")


@_query(f"SELECT event_id FROM ({HOLED}) WHERE NOT (value > 50 AND event_type = 'view')")
def de_morgan(spark: SparkSession, sf: str) -> DataFrame:
    return _where(_events(spark, sf, _holed()), ~((field("value") > 50) & (field("event_type") == "view")), "event_id")


# missing values


@_query(f"SELECT event_id FROM ({HOLED}) WHERE value > 20 OR event_type = 'error'")
def missing_kleene(spark: SparkSession, sf: str) -> DataFrame:
    return _where(_events(spark, sf, _holed()), (field("value") > 20) | (field("event_type") == "error"), "event_id")


@_query(f"SELECT event_id FROM ({HOLED}) WHERE NOT (value <= 20)")
def missing_negated(spark: SparkSession, sf: str) -> DataFrame:
    return _where(_events(spark, sf, _holed()), ~(field("value") <= 20), "event_id")


@_query(f"SELECT event_id FROM ({HOLED}) WHERE value IS NULL")
def is_null(spark: SparkSession, sf: str) -> DataFrame:
    return _where(_events(spark, sf, _holed()), field("value").is_null(), "event_id")


@_query(f"SELECT event_id, value FROM ({HOLED}) WHERE value IS NOT NULL")
def is_valid(spark: SparkSession, sf: str) -> DataFrame:
    return _where(_events(spark, sf, _holed()), field("value").is_valid(), "event_id", "value")


@_query("SELECT event_id, NULLIF(user_id, 7) AS user_id FROM events")
def fill_sentinel(spark: SparkSession, sf: str) -> DataFrame:
    table = over(_read(spark, sf, "events"), [ColumnSpec("event_id", "int64"), ColumnSpec("user_id", "int64", fill_value=7)], "event_id")
    return table.project(table.rows)


@_query(f"SELECT event_id, COALESCE(value, -1.0) AS value FROM ({HOLED})")
def unmasked_read(spark: SparkSession, sf: str) -> DataFrame:
    table = _events(spark, sf, F.when(F.col("event_id") % 10 == 0, F.lit(-1.0)).otherwise(F.col("value")), -1.0)
    return table.project(table.rows, ["event_id", "value"], masked=False)


@_query(f"SELECT event_type, count(*) FILTER (value IS NULL) AS missing FROM ({HOLED}) GROUP BY event_type")
def missing_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf, _holed()).df.groupBy("event_type").agg(F.count_if(F.col("value").isNull()).alias("missing"))


# numbers, text, labels


@_query(f"SELECT event_id FROM ({NANNED}) WHERE value > 50 AND NOT isnan(value)")
def nan_guard(spark: SparkSession, sf: str) -> DataFrame:
    return _where(_nanned(spark, sf), field("value") > 50, "event_id")


@_query(f"SELECT event_id FROM ({NANNED}) WHERE NOT (value > 50 AND NOT isnan(value))")
def nan_negated(spark: SparkSession, sf: str) -> DataFrame:
    return _where(_nanned(spark, sf), ~(field("value") > 50), "event_id")


@_query(f"SELECT event_id FROM ({NANNED}) WHERE NOT (value <= 50 AND NOT isnan(value)) ")
def nan_negated_low(spark: SparkSession, sf: str) -> DataFrame:
    return _where(_nanned(spark, sf), ~(field("value") <= 50), "event_id")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber >= 3")
def int_vs_float(spark: SparkSession, sf: str) -> DataFrame:
    return _where(_lineitem(spark, sf), field("l_linenumber") > 2.5, "l_orderkey", "l_linenumber")


@_query("SELECT event_id FROM events WHERE event_id + 9007199254740992 = 9007199254740993")
def int_beyond_float(spark: SparkSession, sf: str) -> DataFrame:
    df = _read(spark, sf, "events").withColumn("big", F.col("event_id") + 2**53)
    table = over(df, [ColumnSpec("event_id", "int64"), ColumnSpec("big", "int64")], "event_id")
    return _where(table, (field("big") == 2**53 + 1) & (field("big") > float(2**53)), "event_id")


@_query("SELECT o_orderkey FROM orders")
def constant_folded(spark: SparkSession, sf: str) -> DataFrame:
    return _where(_orders(spark, sf), (field("o_custkey") < 2**70) & ~(field("o_custkey") == 0.5) & (field("o_totalprice") < 10**400), "o_orderkey")


@_query("SELECT event_id FROM events WHERE event_type >= 'click' AND event_type < 'signup'")
def string_bytewise(spark: SparkSession, sf: str) -> DataFrame:
    return _where(_events(spark, sf), (field("event_type") >= b"click") & (field("event_type") < "signup"), "event_id")


_CODE = "CASE o_orderpriority " + " ".join(f"WHEN '{x}' THEN {k}" for k, x in enumerate(LEVELS)) + " END"


@_query(f"SELECT o_orderkey, o_orderpriority FROM orders WHERE {_CODE} < 2")
def categorical_order(spark: SparkSession, sf: str) -> DataFrame:
    return _where(_orders(spark, sf), field("o_orderpriority") < "3-MEDIUM", "o_orderkey", "o_orderpriority")


@_query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
def categorical_isin(spark: SparkSession, sf: str) -> DataFrame:
    return _where(_orders(spark, sf), field("o_orderstatus").isin(["F", "P", "no such label", None]), "o_orderkey")


@_query(f"SELECT o_orderkey, {_CODE} AS code FROM orders")
def categorical_codes(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).rows.select("o_orderkey", F.col("o_orderpriority").cast("int").alias("code"))


@_query("SELECT event_id FROM events WHERE (event_id % 3 = 0) AND event_type <> 'view'")
def boolean_column(spark: SparkSession, sf: str) -> DataFrame:
    df = _read(spark, sf, "events").withColumn("third", F.col("event_id") % 3 == 0)
    table = over(df, [ColumnSpec("event_id", "int64"), ColumnSpec("third", "bool"), ColumnSpec("event_type", FixedString(16))], "event_id")
    return _where(table, (field("third") == 1) & (field("third") != False) & field("third").is_valid() & (field("event_type") != "view"), "event_id")  # noqa: E712


@_query("SELECT l_orderkey, l_linenumber, epoch(l_shipdate)::BIGINT AS shipped FROM lineitem WHERE epoch(l_shipdate) >= 820454400")
def datetime_codec(spark: SparkSession, sf: str) -> DataFrame:
    seconds = F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    df = _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", seconds.alias("shipped"), F.lit(0).alias("__p"))
    specs = [ColumnSpec("l_orderkey", "int64"), ColumnSpec("l_linenumber", "int32"), ColumnSpec("shipped", "int64", units="seconds since 1970-01-01")]
    return _where(over(df, specs, "__p"), field("shipped") >= 820454400, "l_orderkey", "l_linenumber", "shipped")


# counts and positions


@_query("SELECT count(*) AS n FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'A'")
def count_where(spark: SparkSession, sf: str) -> DataFrame:
    return _lineitem(spark, sf).select((field("l_quantity") > 30) & (field("l_returnflag") == "A")).rows.agg(F.count("*").alias("n"))


@_query(f"SELECT event_id AS position FROM ({HOLED}) WHERE value < 5")
def row_positions(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf, _holed()).select(field("value") < 5).rows.select(F.col(t.POSITION).alias("position"))


def _at(spark: SparkSession, sf: str, rows: Any) -> DataFrame:
    table = _events(spark, sf)
    df, _ = positions.chosen(table.rows, rows, table.nrows)
    return df


@_query("SELECT event_id, value FROM events WHERE event_id BETWEEN 100 AND 299")
def rows_slice(spark: SparkSession, sf: str) -> DataFrame:
    return _at(spark, sf, slice(100, 300)).select("event_id", "value")


@_query("SELECT event_id, value FROM events WHERE event_id >= 5 AND (event_id - 5) % 7 = 0")
def rows_strided(spark: SparkSession, sf: str) -> DataFrame:
    return _at(spark, sf, slice(5, None, 7)).select("event_id", "value")


@_query("SELECT event_id FROM events WHERE event_id >= 500 AND ((SELECT count(*) FROM events) - 1 - event_id) % 3 = 0")
def rows_reversed(spark: SparkSession, sf: str) -> DataFrame:
    return _at(spark, sf, slice(None, 499, -3)).select("event_id")


@_query("SELECT event_id, ord, value FROM events JOIN (VALUES (7, 0), (3, 1), (7, 2), (0, 3)) v(p, ord) ON event_id = p")
def rows_repeated(spark: SparkSession, sf: str) -> DataFrame:
    return _at(spark, sf, [7, 3, 7, 0]).select("event_id", F.col("__ord").alias("ord"), "value")


@_query("SELECT event_id FROM events WHERE event_id = (SELECT count(*) FROM events) - 2")
def rows_negative(spark: SparkSession, sf: str) -> DataFrame:
    return _at(spark, sf, [-2]).select("event_id")


# stored tables

_STORED = [ColumnSpec("event_id", "int64"), ColumnSpec("user_id", "int64"), ColumnSpec("value", "float64"), ColumnSpec("event_type", FixedString(16))]


def _stored(spark: SparkSession, sf: str, **kw: Any) -> Table:
    """Events written as a table, in order of event_id, so that positions are the ids."""
    df = _read(spark, sf, "events").select("event_id", "user_id", "value", "event_type")
    return Table.from_dataframe(spark, paths.scratch(spark, "events"), df.orderBy("event_id"), _STORED, **kw)


@_query("SELECT event_id, user_id, value, event_type, event_id AS position FROM events")
def stored_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    table = _stored(spark, sf)
    return table.project(table.rows, position=True).withColumnRenamed(t.POSITION, "position")


HALF = "(SELECT count(*) // 2 FROM events)"


@_query(f"SELECT event_id, value FROM events WHERE event_id < {HALF}")
def truncated(spark: SparkSession, sf: str) -> DataFrame:
    table = _stored(spark, sf)
    table.truncate(table.nrows // 2)
    return table.project(table.rows, ["event_id", "value"])


@_query(f"SELECT event_id, event_id AS position, value FROM events WHERE event_id < {HALF} UNION ALL SELECT event_id, {HALF} + event_id, value FROM events")
def append_truncate_append(spark: SparkSession, sf: str) -> DataFrame:
    table = _stored(spark, sf)
    table.truncate(table.nrows // 2)
    table.append(_read(spark, sf, "events").select("event_id", "user_id", "value", "event_type").orderBy("event_id"))
    return table.project(table.rows, ["event_id", "value"], position=True).withColumnRenamed(t.POSITION, "position")


@_query("SELECT event_id, NULL::DOUBLE AS later FROM events UNION ALL SELECT 1000000000 + event_id, value FROM events")
def add_column_backfill(spark: SparkSession, sf: str) -> DataFrame:
    table = _stored(spark, sf)
    table.add_column(ColumnSpec("later", "float64"))
    table.append(_read(spark, sf, "events").select((F.col("event_id") + 1000000000).alias("event_id"), F.col("value").alias("later")))
    return table.project(table.rows, ["event_id", "later"])


@_query("SELECT event_id, user_id, value FROM events WHERE value > 90 AND event_type IN ('click', 'purchase')")
def stored_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _where(_stored(spark, sf), (field("value") > 90) & field("event_type").isin(["click", "purchase"]), "event_id", "user_id", "value")


@_query("SELECT event_id, user_id, value, event_type FROM events")
def arrow_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    out = _events(spark, sf).to_arrow_batches()
    table = Table.from_arrow(spark, paths.scratch(spark, "arrow"), out)
    return table.project(table.rows)


# indexes


@_query("SELECT event_id // 1024 AS chunk, min(value) AS min, max(value) AS max, 0::BIGINT AS nan_count, count(*) FILTER (value IS NULL) AS fill_count, count(*) AS n FROM (" + HOLED + ") GROUP BY 1")
def zonemap_entries(spark: SparkSession, sf: str) -> DataFrame:
    table = _events(spark, sf, _holed())
    return indexes.chunk_bounds(table.rows, table.specs["value"], 1024)


@_query("SELECT event_id // 64 AS chunk FROM events GROUP BY 1 HAVING min(event_id) <= 700 AND max(event_id) >= 200")
def zonemap_prune(spark: SparkSession, sf: str) -> DataFrame:
    table = _stored(spark, sf, chunk_rows=64)
    return table.add_search_index("event_id").pruned("between", (200, 700.5))


@_query("SELECT event_id, value FROM events WHERE event_id >= 200 AND event_id < 333 AND value > 10")
def zonemap_selection(spark: SparkSession, sf: str) -> DataFrame:
    table = _stored(spark, sf, chunk_rows=64)
    table.add_search_index("event_id")
    return table.project(table.select((field("event_id") >= 200) & (field("event_id") < 333) & (field("value") > 10)).pruned(), ["event_id", "value"])


@_query("SELECT row_number() OVER (ORDER BY value, event_id) - 1 AS rank, event_id AS position FROM events")
def sorted_rows_permutation(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf).add_search_index("value", "SORTED_ROWS").permutation()


@_query("SELECT rank, event_id AS position FROM (SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) - 1 AS rank FROM events) WHERE value BETWEEN 10 AND 20")
def sorted_rows_range(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf).add_search_index("value", "SORTED_ROWS").found("between", (10, 20))


@_query("SELECT DISTINCT event_type AS value FROM events")
def bitmap_values(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf).add_search_index("event_type", "BITMAP").data.select("value").distinct()


@_query("SELECT event_id AS position FROM events WHERE event_type IN ('signup', 'error')")
def bitmap_isin(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf).add_search_index("event_type", "BITMAP").found(["signup", "error", "none such"])


@_query("SELECT event_id AS position FROM events WHERE event_type = 'purchase'")
def bitmap_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _stored(spark, sf).add_search_index("event_type", "BITMAP").found(["purchase"])


def _again(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "events").select("event_id", "user_id", "value", "event_type")


def _told(table: Table, rebuilt: int) -> DataFrame:
    """What a zone map over value says of its rows, and the tokens of table and index."""
    index = table.search_indexes["value__chunk_minmax"]
    table.validate(deep=True)
    return index.data.agg(F.sum("n").alias("n"), F.lit(table.generation).cast("long").alias("generation"), F.lit(rebuilt).cast("long").alias("rebuilt"), F.lit(index.is_valid).alias("valid"))


@_query("SELECT 2 * count(*) AS n, 2::BIGINT AS generation, 1::BIGINT AS rebuilt, TRUE AS valid FROM events")
def index_refresh(spark: SparkSession, sf: str) -> DataFrame:
    table = _stored(spark, sf, chunk_rows=256)
    table.add_search_index("value")
    table.append(_again(spark, sf))
    return _told(table, table.refresh_indexes())


@_query("SELECT 2 * count(*) AS n, 2::BIGINT AS generation, 0::BIGINT AS rebuilt, TRUE AS valid FROM events")
def index_maintained(spark: SparkSession, sf: str) -> DataFrame:
    table = _stored(spark, sf, chunk_rows=256)
    table.add_search_index("value")
    table.append(_again(spark, sf), maintain_indexes=True)
    return _told(table, table.refresh_indexes())


@_query("SELECT 2 * count(*) AS n, 6::BIGINT AS generation, 1::BIGINT AS rebuilt, TRUE AS valid FROM events")
def generation_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens that are no numbers are passed over, and one that is ahead of the table's is not used again."""
    table = _stored(spark, sf, chunk_rows=256)
    table.add_search_index("value")
    entry = table.manifest["indexes"]["value__chunk_minmax"]
    table._commit(indexes={"value__chunk_minmax": entry | {"generation": "torn"}, "event_id__chunk_minmax": entry | {"column": "event_id", "generation": 5, "kind": "LATER_KIND"}}, generation=None)
    table.append(_again(spark, sf))
    return _told(table, table.refresh_indexes())


@_query("SELECT (SELECT count(*) FROM events WHERE value >= 10 AND value < 40) AS n_range, (SELECT count(*) FROM events WHERE event_type IN ('view', 'error')) AS n_types, (SELECT count(*) FROM events WHERE value > 80 AND event_type = 'click') AS n_both, 3::BIGINT AS from_indexes")
def indexed_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts that sorted rows and bitmaps answer without the rows."""
    table = _stored(spark, sf)
    table.add_search_index("value", "SORTED_ROWS")
    table.add_search_index("event_type", "BITMAP")
    asked = {"n_range": (field("value") >= 10) & (field("value") < 40), "n_types": field("event_type").isin(["view", "error"]), "n_both": (field("value") > 80) & (field("event_type") == "click")}
    known = sum(indexes.answered(table, table.select(e).expression) is not None for e in asked.values())
    return spark.createDataFrame([(*(table.count(e) for e in asked.values()), known)], ", ".join(f"{c} long" for c in (*asked, "from_indexes")))


@_query(f"SELECT event_id AS position FROM ({NANNED}) WHERE (value > 50 AND NOT isnan(value)) OR value < 1.5")
def nan_in_sorted_rows(spark: SparkSession, sf: str) -> DataFrame:
    """NaN is present, but neither above nor below a number, in an index too."""
    df = _nanned(spark, sf).df.select("event_id", "value").orderBy("event_id")
    table = Table.from_dataframe(spark, paths.scratch(spark, "nans"), df, [ColumnSpec("event_id", "int64"), ColumnSpec("value", "float64", fill_value=-1e300)])
    table.add_search_index("value", "SORTED_ROWS")
    return table.select((field("value") > 50) | (field("value") < 1.5)).positions


@_query("SELECT event_id, value FROM events WHERE event_id % 3 = 1")
def rows_masked(spark: SparkSession, sf: str) -> DataFrame:
    table = _events(spark, sf)
    df, _ = positions.chosen(table.rows, np.arange(table.nrows) % 3 == 1, table.nrows)
    return df.select("event_id", "value")


@_query("SELECT event_id, event_type, value FROM events WHERE value > 60 AND event_type <> 'view'")
def selection_to_arrow(spark: SparkSession, sf: str) -> DataFrame:
    out = _events(spark, sf).select((field("value") > 60) & (field("event_type") != "view")).to_arrow_batches(["event_id", "event_type", "value"])
    return out.df


# lists

#: All elements in their order, exactly: whole millionths as text.
_ELEMENTS = "md5(array_to_string(list_transform(embedding, lambda x: floor(x::DOUBLE * 1000000)::BIGINT::VARCHAR), ','))"


def _elements(c: str) -> F.Column:
    return F.md5(F.array_join(F.transform(c, lambda x: F.floor(x.cast("double") * 1000000).cast("string")), ","))


@_query(f"SELECT vec_id, {_ELEMENTS} AS elements, len(embedding) AS n FROM embeddings")
def list_read(spark: SparkSession, sf: str) -> DataFrame:
    df = _read(spark, sf, "embeddings")
    table = over(df, [ColumnSpec("vec_id", "int64"), ListColumnSpec("embedding", LeafValues("float32"))], "vec_id")
    return table.project(table.rows).select("vec_id", _elements("embedding").alias("elements"), F.size("embedding").cast("long").alias("n"))


@_query(f"SELECT vec_id, {_ELEMENTS} AS elements FROM embeddings UNION ALL SELECT 1000000000 + vec_id, {_ELEMENTS} FROM (SELECT vec_id, list_reverse(embedding) AS embedding FROM embeddings)")
def list_append(spark: SparkSession, sf: str) -> DataFrame:
    df = _read(spark, sf, "embeddings").select("vec_id", "embedding")
    table = Table.from_dataframe(spark, paths.scratch(spark, "lists"), df, [ColumnSpec("vec_id", "int64"), ListColumnSpec("embedding", LeafValues("float32"))])
    table.append(df.select((F.col("vec_id") + 1000000000).alias("vec_id"), F.reverse("embedding").alias("embedding")))
    return table.project(table.rows).select("vec_id", _elements("embedding").alias("elements"))


@_query(f"SELECT vec_id, {_ELEMENTS} AS elements, 'large_list' AS kind FROM embeddings")
def large_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Lists leave as lists with wide offsets and come back whole."""
    df = _read(spark, sf, "embeddings").select("vec_id", "embedding")
    out = over(df, [ColumnSpec("vec_id", "int64"), ListColumnSpec("embedding", LeafValues("float32"))], "vec_id").to_arrow_batches()
    kind = str(out.schema.field("embedding").type).partition("<")[0]
    table = Table.from_arrow(spark, paths.scratch(spark, "lists"), out)
    return table.project(table.rows).select("vec_id", _elements("embedding").alias("elements"), F.lit(kind).alias("kind"))


@_query("SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN NULL WHEN vec_id % 3 = 0 THEN 0 ELSE 2 END::BIGINT AS n, CASE WHEN vec_id % 5 <> 0 AND vec_id % 3 <> 0 THEN (label = 0)::INT ELSE 0 END::BIGINT AS gone FROM embeddings")
def list_null_empty(spark: SparkSession, sf: str) -> DataFrame:
    """Null rows, empty rows and missing elements stay three different things."""
    lists = F.when(F.col("vec_id") % 5 == 0, F.lit(None)).when(F.col("vec_id") % 3 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(9), F.col("label")))
    df = _read(spark, sf, "embeddings").select("vec_id", lists.alias("l"))
    table = over(df, [ColumnSpec("vec_id", "int64"), ListColumnSpec("l", LeafValues("int32", 0), nullable=True)], "vec_id")
    gone = F.size(F.filter(F.coalesce("l", F.array().cast("array<int>")), lambda x: x.isNull())).cast("long")
    return table.project(table.rows).select("vec_id", F.when(F.col("l").isNotNull(), F.size("l")).cast("long").alias("n"), gone.alias("gone"))


# what users of the library get from Spark on a selection


@_query("SELECT c_mktsegment, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R' GROUP BY c_mktsegment")
def selection_joined(spark: SparkSession, sf: str) -> DataFrame:
    items = _where(_lineitem(spark, sf), field("l_returnflag") == "R", "l_orderkey", "l_quantity")
    orders = _where(_orders(spark, sf), None, "o_orderkey", "o_custkey")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(_read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))

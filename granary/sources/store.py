"""Stored tables: Parquet parts under a path, and manifests that say which rows of them count.

A manifest is written whole under the next number and never changed; the one with the highest number is the
table. So an append, a truncation, a new column or an index takes effect at once or not at all, and of two writers
one is told that the other was first. Parts are immutable; rows that a truncation cut stay cut when their positions are
used again, since each part says up to which position it counts.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Mapping, Sequence
from typing import TYPE_CHECKING, Any

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConformanceError, GranaryError, SchemaError, VersionError
from ..functions import types as t
from ..functions.specs import ColumnSpec, Fletcher32, ListColumnSpec, Spec, TableSpec, codec, table_from_json, table_to_json
from ..operators import indexes, positions
from . import encode, paths
from .frame import Reader

if TYPE_CHECKING:
    from .arrow_io import Batches

VERSION = "1.0"
KIND = "granary-table"


class Table(Reader):
    """A table under a path of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, number: int, manifest: dict[str, Any]):
        self.path = path.rstrip("/")
        self._load(spark, number, manifest)

    def _load(self, spark: SparkSession, number: int, manifest: dict[str, Any]) -> None:
        self.number, self.manifest = number, manifest
        self.__dict__.pop("rows", None)
        super().__init__(spark, table_from_json(manifest["spec"]), None, manifest["nrows"])  # type: ignore[arg-type]

    # opening

    @staticmethod
    def is_table(spark: SparkSession, path: str) -> bool:
        """Whether a table could be opened there; never raises."""
        try:
            number = _last(spark, path)
            return number is not None and json.loads(paths.read_text(spark, _name(path, number))).get("kind") == KIND
        except Exception:  # noqa: BLE001  a lenient test by contract
            return False

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Table:
        number = _last(spark, path)
        if number is None:
            raise ConformanceError(f"there is no table at {path}")
        manifest = json.loads(paths.read_text(spark, _name(path, number)))
        if manifest.get("kind") != KIND or not isinstance(manifest.get("nrows"), int):
            raise ConformanceError(f"{path} is not a table")
        if int(str(manifest.get("version", "0")).split(".")[0]) > int(VERSION.split(".")[0]):
            raise VersionError(f"{path} is of version {manifest['version']}; this library knows {VERSION}")
        return cls(spark, path, number, manifest)

    @classmethod
    def create(cls, spark: SparkSession, path: str, columns: TableSpec | Sequence[Spec], **kw: Any) -> Table:
        """A new empty table. With a TableSpec, keywords are ignored."""
        spec = columns if isinstance(columns, TableSpec) else TableSpec(list(columns), **kw)
        if _last(spark, path) is not None:
            raise SchemaError(f"there is a table at {path} already")
        manifest = {"kind": KIND, "version": VERSION, "spec": table_to_json(spec), "nrows": 0, "generation": None, "parts": [], "indexes": {}}
        if not paths.create_text(spark, _name(path, 1), json.dumps(manifest)):
            raise SchemaError(f"another writer was first at {path}")
        return cls(spark, path, 1, manifest)

    @classmethod
    def from_arrays(cls, spark: SparkSession, path: str, arrays: Mapping[str, Sequence[Any]], specs: Sequence[Spec] | None = None, **kw: Any) -> Table:
        from . import infer

        given = {s.name: s for s in specs or ()}
        chosen = [given.get(name) or infer.from_values(name, values) for name, values in arrays.items()]
        return cls._filled(spark, path, chosen, arrays, kw)

    @classmethod
    def from_arrow(cls, spark: SparkSession, path: str, table: pa.Table | Batches, specs: Sequence[Spec] | None = None, **kw: Any) -> Table:
        from . import arrow_io

        return cls._filled(spark, path, arrow_io.prepared(table.digest(specs) if isinstance(table, arrow_io.Batches) else table, specs), table, kw)

    @classmethod
    def from_dataframe(cls, spark: SparkSession, path: str, df: DataFrame, specs: Sequence[Spec], **kw: Any) -> Table:
        return cls._filled(spark, path, list(specs), df, kw)

    @classmethod
    def _filled(cls, spark: SparkSession, path: str, specs: list[Spec], data: Any, kw: dict[str, Any]) -> Table:
        out = cls.create(spark, path, specs, **kw)
        try:
            out.append(data)
        except Exception:
            paths.remove(spark, path)
            raise
        return out

    # state

    @property
    def version(self) -> str:
        return self.manifest["version"]

    @property
    def generation(self) -> int | None:
        return self.manifest["generation"]

    def refresh(self) -> Table:
        """The table as it is now."""
        fresh = Table.open(self.spark, self.path)
        self._load(self.spark, fresh.number, fresh.manifest)
        return self

    @functools.cached_property
    def rows(self) -> DataFrame:  # type: ignore[override]
        schema = self.spec.schema()
        # parts that a truncation cut are read apart; all others as one scan
        whole = [p["dir"] for p in self.manifest["parts"] if p["stop"] == p["end"]]
        cut = [p for p in self.manifest["parts"] if p["stop"] < p["end"] and p["stop"] > p["start"]]
        frames = [self.spark.read.schema(schema).parquet(*(f"{self.path}/{d}" for d in whole))] if whole else []
        frames += [self.spark.read.schema(schema).parquet(f"{self.path}/{p['dir']}").where(F.col(t.POSITION) < p["stop"]) for p in cut]
        if not frames:
            return self.spark.createDataFrame([], schema)
        return functools.reduce(DataFrame.unionByName, frames)

    def _commit(self, **changes: Any) -> None:
        manifest = self.manifest | changes
        if not paths.create_text(self.spark, _name(self.path, self.number + 1), json.dumps(manifest)):
            raise GranaryError(f"another writer changed {self.path} first; refresh() and try again")
        self._load(self.spark, self.number + 1, manifest)

    def _bumped(self) -> int | None:
        """The next generation, if there is any index that it could make stale."""
        g = self.manifest["generation"]
        if g is None and not self.manifest["indexes"]:
            return None
        # tokens that are no numbers say nothing, and are left behind by the next refresh
        known = [x for x in (g, *(i.get("generation") for i in self.manifest["indexes"].values())) if isinstance(x, int) and not isinstance(x, bool) and x > 0]
        return max(known, default=0) + 1

    # changing

    def append(self, data: Mapping[str, Sequence[Any]] | DataFrame | pa.Table | Batches, maintain_indexes: bool = False) -> int:
        """Rows at the end, all or none; a column that is not given is missing in them. Returns how many."""
        from . import arrow_io

        if isinstance(data, pa.Table | arrow_io.Batches):
            data = arrow_io.frame_of(self.spark, data) if isinstance(data, pa.Table) else data.df
        given = data if isinstance(data, DataFrame) else encode.from_values(self.spark, self.spec, data)
        ready = encode.incoming(self.spec, given)
        part = f"data/{uuid.uuid4().hex}"
        to, stage = f"{self.path}/{part}", f"{self.path}/stage/{uuid.uuid4().hex}"
        try:
            numbered, n = positions.numbered(ready, self.nrows, stage)
            if n == 0:
                return 0
            self._write(numbered, to)
            got = self.spark.read.schema(self.spec.schema()).parquet(to).agg(F.count("*"), F.min(t.POSITION), F.max(t.POSITION)).first()
            if tuple(got) != (n, self.nrows, self.nrows + n - 1):
                raise GranaryError("the rows to append changed while they were read")
        except PySparkException as e:
            paths.remove(self.spark, to)
            if (told := encode.retold(e)) is not e:
                raise told from e
            raise
        except Exception:
            paths.remove(self.spark, to)
            raise
        finally:
            paths.remove(self.spark, stage)
        stop = self.nrows + n
        parts = [*self.manifest["parts"], {"dir": part, "start": self.nrows, "stop": stop, "end": stop}]
        self._advance({"parts": parts, "nrows": stop}, maintain_indexes)
        return n

    def _write(self, df: DataFrame, to: str) -> None:
        filters = [c for c in self.spec.columns if isinstance(c, ColumnSpec) and c.filters]
        pressed = "zstd" if not filters or any(codec(c.filters) == "zstd" for c in filters) else "snappy"
        writer = df.write.option("compression", pressed)
        if any(isinstance(f, Fletcher32) for c in filters for f in c.filters):
            writer = writer.option("parquet.page.write-checksum.enabled", "true")
        if self.spec.default_chunk_bytes:
            # a row group holds a chunk of every column, and is what a filter on positions skips
            writer = writer.option("parquet.block.size", str(self.spec.default_chunk_bytes * max(1, len(self.spec.columns))))
        for c in self.spec.columns:
            if isinstance(c, ColumnSpec) and c.is_string:
                writer = writer.option(f"parquet.enable.dictionary#{c.name}", "true")
        writer.parquet(to)

    def _advance(self, changes: dict[str, Any], maintain: bool) -> None:
        generation = self._bumped()
        changes = changes | {"generation": generation}
        if maintain and self.manifest["indexes"]:
            # sidecars are built on the table as it will be, and committed with it
            future = Table(self.spark, self.path, self.number, self.manifest | changes)
            changes["indexes"] = {name: indexes.built(future, x["column"], x["kind"], x.get("description"), generation) for name, x in self.manifest["indexes"].items()}
        self._commit(**changes)

    def truncate(self, nrows: int, maintain_indexes: bool = False) -> None:
        """Only the first rows count from now on."""
        if isinstance(nrows, bool) or not isinstance(nrows, int) or not 0 <= nrows <= self.nrows:
            raise SchemaError(f"{self.nrows} rows cannot be cut to {nrows!r}")
        if nrows == self.nrows:
            return
        parts = [p | {"stop": min(p["stop"], nrows)} for p in self.manifest["parts"] if p["start"] < nrows]
        self._advance({"parts": parts, "nrows": nrows}, maintain_indexes)

    def add_column(self, spec: Spec) -> None:
        """A further column, missing in all rows that there are."""
        if spec.name in self.specs:
            raise SchemaError(f"there is a column {spec.name!r} already")
        if self.nrows and (isinstance(spec, ListColumnSpec) or spec.is_boolean):
            raise SchemaError(f"column {spec.name!r} cannot be missing in the rows that there are")
        self._commit(spec=table_to_json(self.spec.with_column(spec)))

    # indexes

    def add_search_index(self, column: str, kind: str | None = None, name: str | None = None, description: str | None = None) -> indexes.SearchIndex:
        """Build an index of a column; no mutation of the table. Without a kind, BITMAP for labels and truth values, else CHUNK_MINMAX."""
        spec = self.specs[column]
        kind = kind or indexes.default_kind(spec)
        indexes.check_kind(spec, kind)
        name = t.validate_name(name or f"{column}__{kind.lower()}", reserved=False)
        if name in self.manifest["indexes"]:
            raise SchemaError(f"there is an index {name!r} already")
        generation = self.manifest["generation"] or 1
        entry = indexes.built(self, column, kind, description, generation)
        self._commit(indexes=self.manifest["indexes"] | {name: entry}, generation=generation)
        return self.search_indexes[name]

    build_index = add_search_index

    @property
    def search_indexes(self) -> dict[str, indexes.SearchIndex]:
        return {name: indexes.opened(self, name, x) for name, x in self.manifest["indexes"].items()}

    def index_is_valid(self, index: indexes.SearchIndex | str) -> bool:
        name = index if isinstance(index, str) else index.name
        return indexes.valid(self.manifest, self.manifest["indexes"].get(name, {}))

    def valid_indexes(self, name: str) -> dict[str, Any]:
        return {x.kind: x for x in self.search_indexes.values() if x.column_name == name and x.is_valid and x.kind in indexes.KINDS}

    def refresh_indexes(self) -> int:
        """Build anew what is stale. Returns how many."""
        stale = [name for name, x in self.manifest["indexes"].items() if x.get("kind") in indexes.KINDS and not indexes.valid(self.manifest, x)]
        if stale:
            generation = self._bumped() if not isinstance(self.manifest["generation"], int) else self.manifest["generation"]
            fresh = {n: indexes.built(self, (x := self.manifest["indexes"][n])["column"], x["kind"], x.get("description"), generation) for n in stale}
            self._commit(indexes=self.manifest["indexes"] | fresh, generation=generation)
        return len(stale)

    def validate(self, deep: bool = False) -> None:
        from ..operators import validate

        validate.validate(self, deep)

    def vacuum(self) -> int:
        """Remove files that no row and no index of the present table is in. Returns how many folders went. Readers of earlier manifests lose theirs."""
        used = {p["dir"].split("/")[-1] for p in self.manifest["parts"]} | {x["dir"].split("/")[-1] for x in self.manifest["indexes"].values()}
        gone = 0
        for top in ("data", "index"):
            for name in paths.names(self.spark, f"{self.path}/{top}"):
                if name not in used:
                    paths.remove(self.spark, f"{self.path}/{top}/{name}")
                    gone += 1
        for name in paths.names(self.spark, f"{self.path}/manifest"):
            if name.endswith(".json") and name < f"{self.number:010d}.json":
                paths.remove(self.spark, f"{self.path}/manifest/{name}")
        return gone


def _name(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/manifest/{number:010d}.json"


def _last(spark: SparkSession, path: str) -> int | None:
    found = [int(n[:10]) for n in paths.names(spark, f"{path.rstrip('/')}/manifest") if len(n) == 15 and n[:10].isdigit()]
    return max(found, default=None)

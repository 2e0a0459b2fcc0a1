"""What the operators share: row keys, scratch tables, packed texts, worker memos.

Rows are keyed by ``did`` (doc_id, with null as the smallest long) and ``h``
(xxhash64 of the text), so that rows that repeat an id with another text stay
apart. Rows that repeat both are the same document and get the same result.
Only the named columns of an input are read; any others cannot clash.
"""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need not have the library: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])

NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(df: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """did, h, text of a documents table, and columns to carry along as x_<name>; a null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    return df.select(did.alias("did"), F.xxhash64(text).alias("h"), text.alias("text"), *(F.col(c).alias(f"x_{c}") for c in carry))


def doc_id(col: str = "did") -> F.Column:
    """The id that ``keyed`` hid: null again where it was null."""
    return F.when(F.col(col) != NULL_ID, F.col(col)).alias("doc_id")


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; it goes with the JVM. Only where all is one
    machine may it be a folder of that machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not (spark.sparkContext.master or "").startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="granary-"))
        base = spark.sparkContext.getCheckpointDir()
    path = f"{base}/granary-{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends here, lost executors cost nothing. An aggregate that is
    joined back to its rows is settled first, for Spark only splits hot keys of a join whose sides it shuffles itself."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """As ``settle``, in buckets by key: a later join on the keys does not move these rows.
    Each bucket is one file where df already comes dealt by the keys, as from a join on them."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    to = f"granary_{name}_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, *keys).saveAsTable(to)
    return resolved(spark, to)


def resolved(spark: SparkSession, name: str) -> DataFrame:
    """A table of the catalog that is needed no longer by its name; its files stay."""
    out = spark.table(name)
    out.schema  # noqa: B018  looked up now
    spark.sql(f"DROP TABLE {name}")
    return out


class Commits:
    """Batches of tables under a path, each there once all of it is written. A batch that is written again, after
    a failure or a lost driver, is another attempt; rows of attempts that no commit names are not seen."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path}/_commits"

    def _at(self, path: str):
        out = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return out, out.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def done(self) -> dict[str, str]:
        """The attempt of each batch."""
        path, fs = self._at(self.path)
        if not fs.exists(path):
            return {}
        return dict(x.getPath().getName().rsplit(".", 1) for x in fs.listStatus(path))

    def commit(self, batch: str, attempt: str) -> None:
        path, fs = self._at(f"{self.path}/{batch}.{attempt}")
        fs.create(path, False).close()

    def note(self, name: str, value: str) -> str:
        """A value that stays as it was first set."""
        path, fs = self._at(f"{self.path[: -len('_commits')]}_{name}")
        if not fs.exists(path):
            out = fs.create(path, False)
            out.writeBytes(value)
            out.close()
        held = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
        finally:
            held.close()


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
SLICE = 4 << 20  # bytes of a batch that work sees at once
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def over(df: DataFrame, work: Work, schema: str | T.StructType, keeps: str = "") -> DataFrame:
    """mapInArrow by work, which sees batches in slices of a few MB; keeps: the memo that it uses. Workers outlive
    their tasks, so each begins by forgetting what other operators kept and ends by giving free memory back. Where the
    session sets no size for Arrow's batches, they end at a slice, or rows of long texts would take what they like."""
    if df.sparkSession.conf.get(BATCH, None) is None:
        df.sparkSession.conf.set(BATCH, str(SLICE))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        try:
            yield from work(sliced(batches))
        finally:
            trim()

    return df.mapInArrow(lean, schema)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = max(1, int(b.num_rows * SLICE / max(SLICE, b.nbytes)))
        for k in range(0, b.num_rows, n):
            yield b.slice(k, n)


def trim() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def raw(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes, without decoding."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def packed(df: DataFrame) -> DataFrame:
    """Keyed rows with the text compressed as z, for shuffles that must carry it."""
    rest = [f for f in df.schema.fields if f.name != "text"]
    names = [f.name for f in rest]

    def pack(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            z = pa.array([press.compress(t) for t in raw(b)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), z], [*names, "z"])

    return over(df, pack, T.StructType([*rest, T.StructField("z", T.BinaryType())]))


def unpacker() -> Callable[[bytes], bytes]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress


def memo(name: str, make: Callable[[], object]) -> object:
    """A value that a Python worker keeps between its tasks."""
    kept = sys.modules.setdefault("_granary_memo", types.ModuleType("_granary_memo"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)


def forget(but: str = "") -> None:
    """Drop all memos but one."""
    kept = sys.modules.get("_granary_memo")
    gone = [k for k in vars(kept) if k != but and not k.startswith("__")] if kept else []
    for k in gone:
        delattr(kept, k)
    if gone:
        trim()


def rows(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in columns.values()], list(columns))

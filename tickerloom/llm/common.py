"""Shared plumbing: input projection, the shared work folder, and Arrow batch limits."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch sent to Python; keeps a batch of long documents within a worker's memory.
BATCH_ROWS = 512
#: Texts that whole-array code takes at once.
SLICE_ROWS = 128
#: Rows of a few numbers in one Arrow batch.
NUMBER_ROWS = 32_768
#: Bytes in one Arrow batch, where the running Spark knows the setting.
BATCH_BYTES = 16 << 20

_written: list[str] = []
_shipped: set[str] = set()
_own_roots: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application; their Python may not have it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="tickerloom-code-")
    with zipfile.ZipFile(f"{folder}/{package.name}.zip", "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    context.addPyFile(f"{folder}/{package.name}.zip")
    _shipped.add(context.applicationId)


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by rows and bytes, so that very long texts cannot fill a worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    except Exception:  # a Spark without this setting; the row limit still holds
        return


@contextlib.contextmanager
def number_batches(spark: SparkSession):
    """Larger Arrow batches while jobs over rows of numbers run."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(NUMBER_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, str(BATCH_ROWS))


def project(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns only, cast; what else the input carries, under whatever name, is left behind."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null becomes empty) and further string columns."""
    out = project(docs, doc_id="long", text="string", **dict.fromkeys(more, "string"))
    return out.withColumn("text", F.coalesce("text", F.lit("")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names for shared files.

    Where none is named, as in tests, a temporary one serves, but only if driver and executors are one
    process: on a cluster each executor would write to a disk of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_roots:
            _own_roots[app] = f"file://{tempfile.mkdtemp(prefix='tickerloom-')}"
        root = _own_roots[app]
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tickerloom/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(discard, spark)
    _written.append(path)
    return path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete work tables (all of them without arguments) through the file system that holds them."""
    for path in paths or tuple(_written):
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may already be gone; the folder belongs to the cluster
            return
        if path in _written:
            _written.remove(path)


def writing(path: str) -> dict[str, str]:
    """Options for writing under a work path.

    Hadoop's checked local file system starts a process for each file and folder it makes, to set its mode, and
    writes a checksum file beside each; thousands of small files cost thousands of processes, each of
    which shares the executor's whole memory until it runs. The raw local file system does neither. Paths
    in other stores are written as always.
    """
    if not path.startswith("file:"):
        return {}
    return {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def materialize(df: DataFrame, name: str, path: str | None = None, few: bool = False, **options: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors.

    ``few`` is for small results of a shuffle: no more files than there are cores, as each costs its own round trips.
    """
    spark = df.sparkSession
    path = path or work_path(spark, name)
    rows = df.coalesce(max(1, spark.sparkContext.defaultParallelism)) if few else df
    rows.write.mode("overwrite").options(**writing(path), **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free() -> None:
    """Between heavy jobs: drop the shuffle files and broadcasts of jobs that are over, and give back heap.

    Spark's cleaner acts when the driver collects its garbage. An executor's heap, once grown, stays
    at its peak until a full collection, and Python workers, Arrow buffers and native code need
    that memory beside it; so each executor is asked for one as well, a task a core.
    """
    spark = SparkSession.getActiveSession()
    gc.collect()
    if spark is None:
        return
    spark._jvm.System.gc()
    if not spark.sparkContext.master.startswith("local["):
        cores = max(1, spark.sparkContext.defaultParallelism)
        spark.range(0, cores, 1, cores).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


@contextlib.contextmanager
def small_plans(spark: SparkSession):
    """For rounds of jobs over small tables: no generated classes for each plan, which would pile up in every JVM."""
    key = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def slices(batches, rows: int = SLICE_ROWS):
    """The batches in slices of a few rows, which bound the scratch arrays of whole-array work on texts."""
    for batch in batches:
        for low in range(0, len(batch), rows):
            yield batch.slice(low, rows)


def give_back() -> None:
    """At the end of a task, return freed memory to the system: an idle worker keeps none of a batch's scratch arrays."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def string_column(column: pa.Array) -> pa.Array:
    """A plain 32-bit-offset string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    return column if pa.types.is_string(column.type) else column.cast(pa.string())


def crc_remainder(column: str, modulus: int):
    """crc32 of an id's decimal text, modulo; a null id counts as remainder -1 and is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1))

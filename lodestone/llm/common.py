"""Shared helpers of the training-data operators: table access and durable intermediates."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every contract here: U+0020 and U+0009 to U+000D.
BLANKS = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session may go without that setting (tests); it then gets a
    temporary folder. On a cluster a machine-local folder would lose data with
    its executor, so a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
    return spark.sparkContext.getCheckpointDir()


#: In the current context, the list that tables made by :func:`materialise` are noted in.
_noted: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("noted", default=None)
#: Folders of this process's tables, which go when it ends.
_folders: set[str] = set()


@contextlib.contextmanager
def noting(tables: list[DataFrame]):
    """Note the tables that :func:`materialise` makes meanwhile, for a caller that discards them when it is done."""
    mark = _noted.set(tables)
    try:
        yield
    finally:
        _noted.reset(mark)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    Results are lazy and read their tables when they run, so tables stay until
    they are discarded or the driver's process ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/lodestone-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_delete, folder, spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration())
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(spark.read.parquet(path).schema).parquet(path)
    out._lodestone_path = path
    noted = _noted.get()
    if noted is not None:
        noted.append(out)
    return out


def _delete(path: str, gateway, configuration) -> None:
    with contextlib.suppress(Exception):  # at the end of the process the JVM may be gone
        at = gateway.jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(configuration).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a frame made by :func:`materialise` that nothing reads any more."""
    path = getattr(df, "_lodestone_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        _delete(path, sc._gateway, sc._jsc.hadoopConfiguration())


#: Rows up to which a table of keys may be broadcast; more go through a shuffle join.
BROADCAST_ROWS = 200_000


def light(df: DataFrame, name: str, rows: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """``df``, a narrow side of a join, written once and counted: to be broadcast if it has ``rows`` rows at most.

    ``size``: how many a row counts for, where rows hold arrays.
    """
    out = materialise(df, name)
    held = out.count() if size is None else out.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(out) if held <= rows else out


#: Bytes of an Arrow batch that goes to a Python worker. A longer text makes a larger batch of its own.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, unless its owner has set a bound: rows alone say little where texts are long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def give_back() -> None:
    """Give this process's freed memory back to the system: Python workers live on idle."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def tidied(run):
    """``run`` for mapInArrow, with :func:`give_back` before a partition, for what the worker's last task left, and after it."""

    def whole(batches):
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words of a text as an array: maximal runs of other characters than blanks (null: none)."""
    flat = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(flat, " "), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a one-element array binds it to a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def running(values: Column, merge, first: int = 0, chunk: int = 256) -> Column:
    """The running ``merge`` (of two longs) over an array of longs, from ``first`` on.

    A lambda that appends copies its array at each step, so only chunks are
    scanned that way, and then the chunks' totals.
    """
    none = F.array().cast("array<bigint>")
    last = lambda xs, default: F.coalesce(F.get(xs, F.size(xs) - 1), default)
    zero = F.lit(first).cast("long")
    n = F.size(values)
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / chunk).cast("int"), F.lit(0))), lambda j: F.slice(values, j * chunk + 1, chunk))
    scanned = F.transform(parts, lambda p: F.aggregate(p, none, lambda acc, x: F.concat(acc, F.array(merge(last(acc, zero), x)))))

    def joined(inner: Column) -> Column:
        before = F.aggregate(inner, F.array(zero), lambda acc, p: F.concat(acc, F.array(merge(last(acc, zero), last(p, zero)))))
        return let(before, lambda b: F.flatten(F.transform(inner, lambda p, j: F.transform(p, lambda x: merge(F.get(b, j), x)))))

    return let(scanned, joined)

"""Tables that can be changed: folders of Parquet files and numbered commits that list them.

A change writes a new folder and then creates the commit after the one it read,
which only one writer can; a second one gets an error and loses nothing. A
commit counts once its content is there, so readers see the state before or
after. Nothing is updated in place, and an insert writes its own rows only.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a file that vacuum aims at.
FILE_BYTES = 256 << 20


class ConflictError(RuntimeError):
    """Another writer has committed since this one read the table."""


class MutableTable:
    """A table in ``path`` with the key column ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._jvm = spark.sparkContext._jvm
        self._P = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._P(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.observers: list = []

    # commits -----------------------------------------------------------------------------------------------------
    def _latest(self) -> tuple[int, dict | None]:
        """The number of the last commit, and the content of the last one that has it."""
        at = self._P(f"{self.path}/_commits")
        if not self._fs.exists(at):
            return 0, None
        found = sorted((int(s.getPath().getName()), s.getLen()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit())
        whole = [n for n, size in found if size]
        content = None
        if whole:
            source = self._fs.open(self._P(f"{self.path}/_commits/{whole[-1]:020d}"))
            try:
                content = json.loads(bytes(source.readAllBytes()).decode())
            finally:
                source.close()
        return (found[-1][0] if found else 0), content

    def _create(self, number: int, content: dict) -> None:
        at = self._P(f"{self.path}/_commits/{number:020d}")
        self._fs.mkdirs(at.getParent())
        try:
            if self._fs.getScheme() == "file":  # Hadoop's local file system looks and then creates
                self._jvm.java.nio.file.Files.createFile(self._jvm.java.io.File(at.toUri().getPath()).toPath(), self.spark.sparkContext._gateway.new_array(self._jvm.java.nio.file.attribute.FileAttribute, 0))
                out = self._fs.create(at, True)
            else:
                out = self._fs.create(at, False)
        except Py4JJavaError as e:
            if self._fs.exists(at):
                raise ConflictError(f"commit {number} of {self.path} is another writer's") from e
            raise
        out.write(json.dumps(content).encode())
        out.close()

    def commit(self, df: DataFrame, kind: str = "write", after: int | None = None, folders: list[str] | None = None) -> MutableTable:
        """Make ``df``, beside the rows of ``folders``, the table's state after commit ``after`` (the last one, unless given)."""
        if after is None:
            after = self._latest()[0]
        new = f"v{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{new}")
        try:
            self._create(after + 1, {"schema": json.loads(df.schema.json()), "folders": [*(folders or []), new]})
        except ConflictError:
            self._fs.delete(self._P(f"{self.path}/{new}"), True)
            raise
        for f in self.observers:
            f(kind, self)
        return self

    def _state(self) -> tuple[int, list[str], DataFrame]:
        """The last commit's number, its folders and the rows."""
        number, content = self._latest()
        if content is None:
            raise FileNotFoundError(f"no table in {self.path}")
        schema = T.StructType.fromJson(content["schema"])
        return number, content["folders"], self.spark.read.schema(schema).parquet(*[f"{self.path}/{x}" for x in content["folders"]])

    def read(self) -> DataFrame:
        return self._state()[2]

    # rows --------------------------------------------------------------------------------------------------------
    def create(self, schema: str | T.StructType, if_not_exists: bool = False) -> MutableTable:
        number, content = self._latest()
        if content is not None:
            if if_not_exists:
                return self
            raise FileExistsError(self.path)
        return self.commit(self.spark.createDataFrame([], schema), "create", number)

    def insert(self, rows: DataFrame) -> MutableTable:
        """Add ``rows``, which have the table's columns in any order; only they are written."""
        number, folders, now = self._state()
        same = now.limit(0).unionByName(rows)
        return self.commit(same.select(*[F.col(f.name).cast(f.dataType) for f in now.schema]), "insert", number, folders)

    def update(self, rows: DataFrame) -> MutableTable:
        """Replace the rows whose key is there; others are ignored."""
        number, _, now = self._state()
        hit = rows.join(now.select(self.key), self.key, "left_semi")
        return self.commit(now.join(rows.select(self.key), self.key, "left_anti").unionByName(hit), "update", number)

    def upsert(self, rows: DataFrame) -> MutableTable:
        number, _, now = self._state()
        return self.commit(upsert(now, rows, self.key), "upsert", number)

    def delete(self, *keys) -> MutableTable:
        """Delete the rows of these keys; a row without a key stays."""
        number, _, now = self._state()
        return self.commit(delete_where(now, F.col(self.key).isin(list(keys))), "delete", number)

    def delete_where(self, condition: Column) -> int:
        """Delete the rows where ``condition`` is true; returns their number."""
        number, _, now = self._state()
        n = now.filter(condition).count()
        self.commit(delete_where(now, condition), "delete", number)
        return n

    # schema ------------------------------------------------------------------------------------------------------
    def add_column(self, name: str, kind: str, default=None) -> MutableTable:
        number, _, now = self._state()
        return self.commit(now.withColumn(name, F.lit(default).cast(kind)), "alter", number)

    def rename_to(self, path: str) -> MutableTable:
        if not self._fs.rename(self._P(self.path), self._P(path)):
            raise OSError(f"{self.path} can't become {path}")
        return MutableTable(self.spark, path, self.key)

    def drop(self) -> bool:
        """Delete the table with all its versions; False where there is none."""
        return bool(self._fs.delete(self._P(self.path), True))

    # upkeep ------------------------------------------------------------------------------------------------------
    def vacuum(self, files: int | None = None) -> MutableTable:
        """Rewrite into ``files`` files (by default of some FILE_BYTES each) and delete the older versions."""
        number, folders, now = self._state()
        if files is None:
            files = 1 + sum(self._fs.getContentSummary(self._P(f"{self.path}/{x}")).getLength() for x in folders) // FILE_BYTES
        self.commit(now.coalesce(files), "vacuum", number)
        number, folders, _ = self._state()
        for s in self._fs.listStatus(self._P(self.path)):
            if s.getPath().getName().startswith("v") and s.getPath().getName() not in folders:
                self._fs.delete(s.getPath(), True)
        for s in self._fs.listStatus(self._P(f"{self.path}/_commits")):
            if s.getPath().getName().isdigit() and int(s.getPath().getName()) < number:
                self._fs.delete(s.getPath(), False)
        return self

    def max_key(self):
        return self.read().agg(F.max(self.key)).first()[0]

    def row_count(self) -> int:
        return self.read().count()

    @contextmanager
    def transaction(self):
        """Changes to a frame that become one version at the end, or none at all after an error."""
        number, _, now = self._state()
        staged = Staged(now, self.key)
        yield staged
        self.commit(staged.df, "transaction", number)


class Staged:
    """A table's state inside a transaction."""

    def __init__(self, df: DataFrame, key: str):
        self.df, self.key = df, key

    def insert(self, rows: DataFrame) -> None:
        self.df = self.df.unionByName(rows)

    def upsert(self, rows: DataFrame) -> None:
        self.df = upsert(self.df, rows, self.key)

    def delete_where(self, condition: Column) -> None:
        self.df = delete_where(self.df, condition)


def upsert(now: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``now`` with the rows of equal key replaced and the others added."""
    return now.join(rows.select(key), key, "left_anti").select(*now.columns).unionByName(rows)


def delete_where(now: DataFrame, condition: Column) -> DataFrame:
    """``now`` without the rows where the condition is true; unknown keeps a row."""
    return now.filter(~F.coalesce(condition, F.lit(False)))


def fold(df: DataFrame, path: str, *columns: str, mode: str = "overwrite") -> None:
    """Rewrite sorted by ``columns``, so that Parquet's statistics and encodings work."""
    df.repartitionByRange(*columns).sortWithinPartitions(*columns).write.mode(mode).parquet(path)


def write_chunks(df: DataFrame, path: str, rows_per_chunk: int = 100_000) -> DataFrame:
    """Write in files of ``rows_per_chunk`` rows at most and return their manifest: file, bytes, sha256."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_chunk).parquet(path)
    files = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def check_chunks(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Chunks that are missing or changed: file, problem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    now = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("now"))
    both = manifest.join(now, "file", "left")
    return both.filter(F.col("now").isNull() | (F.col("now") != F.col("sha256"))).select("file", F.when(F.col("now").isNull(), "missing").otherwise("changed").alias("problem"))


def export_arc(tables: dict[str, DataFrame], path: str) -> None:
    """Write all tables of a fragment under ``path``, with a manifest of their schemas."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, json.dumps(json.loads(df.schema.json()), separators=(",", ":"))) for name, df in tables.items()]
    spark.createDataFrame(rows, "table string, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest")


def open_arc(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a fragment."""
    return {r["table"]: spark.read.schema(T.StructType.fromJson(json.loads(r["schema"]))).parquet(f"{path}/{r['table']}") for r in spark.read.parquet(f"{path}/_manifest").collect()}


def parse_arc_uri(uri: str) -> dict[str, str | None]:
    """The parts of ``arc://authority/path#table/row``."""
    import re

    m = re.fullmatch(r"arc://([^/#]+)(/[^#]*)?(?:#([^/]+)(?:/(.+))?)?", uri)
    if not m:
        raise ValueError(f"not an arc address: {uri}")
    return dict(zip(("authority", "path", "table", "row"), (m[1], (m[2] or "/").lstrip("/"), m[3], m[4])))

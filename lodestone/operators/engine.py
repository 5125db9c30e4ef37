"""The engine: a catalogue of tables, views and layers, queried by SQL text, by builder or by prepared statement."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.dialect import rewrite


class AccessDenied(PermissionError):
    """A query needs a table or column outside the caller's scopes."""


@dataclass(frozen=True)
class Scopes:
    """What a caller may read: ``*``, ``t``, ``t.*``, ``t.col``, ``pre*.col``, ``.schema``.

    Tables match case-sensitively, columns do not.
    """

    entries: tuple[str, ...]

    def columns(self, table: str, columns: list[str]) -> list[str]:
        out = []
        for c in columns:
            for entry in self.entries:
                t, _, wanted = entry.partition(".")
                if entry == "*" or (t and fnmatch.fnmatchcase(table, t) and wanted.lower() in ("", "*", c.lower())):
                    out.append(c)
                    break
        return out

    @property
    def schema(self) -> bool:
        return "*" in self.entries or ".schema" in self.entries


class Engine:
    """Tables by name over one Spark session. All queries return lazy DataFrames."""

    def __init__(self, spark: SparkSession, keys: dict[str, str] | None = None):
        self.spark = spark
        self.keys = dict(keys or {})
        self.views: dict[str, DataFrame] = {}
        self.cached: dict[tuple, DataFrame] = {}

    # catalogue ---------------------------------------------------------------------------------------------------
    def register(self, name: str, source: DataFrame | str, key: str | None = None) -> Engine:
        """A table from a DataFrame or a Parquet path; ``key`` names its row id."""
        df = self.spark.read.parquet(source) if isinstance(source, str) else source
        self._forget()
        df.createOrReplaceTempView(name)
        self.views[name] = df
        if key:
            self.keys[name] = key
        return self

    def register_dir(self, path: str, names: list[str] | tuple[str, ...]) -> Engine:
        for n in names:
            self.register(n, f"{path}/{n}.parquet")
        return self

    register_view = register
    register_layer = register

    def unregister(self, name: str) -> bool:
        self._forget()
        self.views.pop(name, None)
        return self.spark.catalog.dropTempView(name)

    def tables(self) -> DataFrame:
        """name and number of columns of everything registered."""
        return self.spark.createDataFrame([(n, len(df.columns)) for n, df in sorted(self.views.items())], "table string, columns int")

    def schema(self) -> DataFrame:
        """table, column, ordinal, type and nullability of everything registered."""
        rows = [(n, f.name, i, f.dataType.simpleString(), f.nullable) for n, df in sorted(self.views.items()) for i, f in enumerate(df.schema)]
        return self.spark.createDataFrame(rows, "table string, column string, ordinal int, type string, nullable boolean")

    def create_view(self, name: str, sql: str) -> Engine:
        """A view from dialect SQL, analysed now: an unknown name or a cycle is an error here."""
        return self.register(name, self.sql(sql))

    # queries -----------------------------------------------------------------------------------------------------
    def sql(self, text: str, params: dict | None = None) -> DataFrame:
        """Run dialect SQL. ``CACHED`` keeps the result for the same text and parameters until a table is registered or dropped; ``DIRECT`` and ``JIT`` are the normal path."""
        found = rewrite(text, self.keys)
        known = (found.sql, tuple((k, type(v).__name__, repr(v)) for k, v in sorted((params or {}).items())))
        if found.hint == "CACHED" and known in self.cached:
            return self.cached[known]
        df = self.spark.sql(found.sql, args=params) if params else self.spark.sql(found.sql)
        if found.hint == "CACHED":
            self.cached[known] = df = df.cache()
        return df

    def _forget(self) -> None:
        """Drop the kept results: a table that they read changes."""
        for df in self.cached.values():
            df.unpersist()
        self.cached.clear()

    def table(self, name: str) -> Query:
        return Query(self.spark.table(name), key=self.keys.get(name))

    def prepare(self, text: str) -> Prepared:
        return Prepared(self, text)

    def as_agent(self, scopes: list[str] | tuple[str, ...]) -> Engine:
        """An engine on a session of its own that holds only what ``scopes`` grant, so that no view leads around them."""
        granted = Scopes(tuple(scopes))
        session = self.spark.newSession()
        agent = AgentEngine(session, self.keys)
        for name, df in self.views.items():
            allowed = granted.columns(name, df.columns)
            if allowed:
                agent.views[name] = df.select(*allowed)
                agent.sessioned(name)
        return agent


class AgentEngine(Engine):
    """An engine whose catalogue was cut to an agent's scopes; what is missing counts as denied."""

    def sessioned(self, name: str) -> None:
        jdf = self.views[name]._jdf
        plan = jdf.queryExecution().analyzed()
        jvm = self.spark.sparkContext._jvm
        DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan), self.spark).createOrReplaceTempView(name)

    def sql(self, text: str, params: dict | None = None) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return super().sql(text, params)
        except AnalysisException as e:
            if e.getCondition() in ("TABLE_OR_VIEW_NOT_FOUND", "UNRESOLVED_COLUMN.WITH_SUGGESTION", "UNRESOLVED_COLUMN.WITHOUT_SUGGESTION"):
                raise AccessDenied(str(e)) from e
            raise


@dataclass(frozen=True)
class Query:
    """A lazy query under construction; every call returns a new one."""

    df: DataFrame
    key: str | None = None
    conditions: tuple[Column, ...] = ()
    columns: tuple[str, ...] = ()
    take: int | None = None
    skip: int | None = None
    order: tuple[Column, ...] = ()

    def where(self, condition: Column) -> Query:
        return replace(self, conditions=(*self.conditions, condition))

    def clear_filters(self) -> Query:
        return replace(self, conditions=())

    def select(self, *columns: str) -> Query:
        return replace(self, columns=columns)

    def order_by(self, *columns: str | Column) -> Query:
        return replace(self, order=tuple(F.asc_nulls_last(c) if isinstance(c, str) else c for c in columns))

    def limit(self, n: int) -> Query:
        return replace(self, take=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def query(self, *columns: str) -> DataFrame:
        df = reduce(lambda d, c: d.filter(c), self.conditions, self.df)
        if self.order:
            df = df.orderBy(*self.order)
        if self.skip:
            df = df.offset(self.skip)
        if self.take is not None:
            df = df.limit(self.take)
        wanted = columns or self.columns
        return df.select(*wanted) if wanted else df

    def seek(self, value) -> DataFrame:
        """The row with that key."""
        return self.where(F.col(self._key) == F.lit(value)).limit(1).query()

    def seek_index(self, **values) -> DataFrame:
        """Rows equal in all the given columns."""
        return reduce(lambda q, kv: q.where(F.col(kv[0]) == F.lit(kv[1])), values.items(), self).query()

    def after(self, last, n: int) -> DataFrame:
        """The next ``n`` rows by key after ``last``: keyset pagination."""
        return self.where(F.col(self._key) > F.lit(last)).order_by(self._key).limit(n).query()

    def top_k(self, k: int, score: Column, *columns: str) -> DataFrame:
        """The ``k`` rows with the lowest score, ties by key. Spark keeps k rows a task and never sorts the whole."""
        ties = [F.asc_nulls_last(self._key)] if self.key else []
        df = reduce(lambda d, c: d.filter(c), self.conditions, self.df).withColumn("score", score)
        out = df.orderBy(F.asc_nulls_last("score"), *ties).limit(k)
        return out.select(*columns, "score") if columns else out

    def as_view(self, name: str) -> DataFrame:
        df = self.query()
        df.createOrReplaceTempView(name)
        return df

    def to_prepared(self) -> Callable[[], DataFrame]:
        return self.query

    @property
    def _key(self) -> str:
        if not self.key:
            raise ValueError("the table has no key column")
        return self.key


class Prepared:
    """SQL text rewritten once and run with changing parameters; prepared without a run, so errors show at once."""

    def __init__(self, engine: Engine, text: str):
        self.engine, self.text = engine, text
        self.sql = rewrite(text, engine.keys).sql

    def execute(self, params: dict | None = None) -> DataFrame:
        return self.engine.spark.sql(self.sql, args=params) if params else self.engine.spark.sql(self.sql)


@dataclass
class Agent:
    """An ordered list of steps, each a callable that gets the results so far and returns its own."""

    steps: list[tuple[str, Callable[[dict], object]]] = field(default_factory=list)

    def step(self, name: str, action: Callable[[dict], object]) -> Agent:
        self.steps.append((name, action))
        return self

    def execute(self) -> dict:
        done: dict = {}
        for name, action in self.steps:
            done[name] = action(done)
        return done


@dataclass(frozen=True)
class View:
    """A programmatic view: a source table or view, columns, a filter, and whether it is kept in memory."""

    source: DataFrame
    name: str = "view"
    columns: tuple[str, ...] = ()
    condition: Column | None = None
    eager: bool = False

    def select(self, *columns: str) -> View:
        return replace(self, columns=columns)

    def where(self, condition: Column) -> View:
        return replace(self, condition=condition if self.condition is None else self.condition & condition)

    def named(self, name: str) -> View:
        return replace(self, name=name)

    def materialize(self, eager: bool = True) -> View:
        return replace(self, eager=eager)

    def build(self) -> DataFrame:
        df = self.source if self.condition is None else self.source.filter(self.condition)
        df = df.select(*self.columns) if self.columns else df
        df = df.cache() if self.eager else df
        df.createOrReplaceTempView(self.name)
        return df


def row_access(df: DataFrame, tag: str, entitled: list[str]) -> DataFrame:
    """Rows whose tag is among the caller's; a NULL tag is no one's."""
    return df.filter(F.col(tag).isin(entitled)) if entitled else df.filter(F.lit(False))


class Extensions:
    """A registry of named extensions."""

    def __init__(self):
        self._known: dict[str, object] = {}

    def register(self, name: str, extension: object) -> None:
        if name in self._known:
            raise ValueError(f"extension {name} is registered")
        self._known[name] = extension

    def get(self, name: str) -> object | None:
        return self._known.get(name)

    def names(self) -> list[str]:
        return sorted(self._known)

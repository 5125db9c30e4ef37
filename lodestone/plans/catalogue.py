"""The registered queries of the core engine and their DuckDB counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators.engine import Engine
from lodestone.plans import lifecycle_queries, operator_queries, sql_queries  # noqa: F401  (the first registers its queries with the second)

KEYS = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "nation": "n_nationkey", "region": "r_regionkey", "events": "event_id", "documents": "doc_id"}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def engine(spark: SparkSession, sf_dir: str, text: str | None = None) -> Engine:
    """An engine over the tables of a folder; with ``text``, over those it names, as opening a table reads its footers."""
    return Engine(spark, KEYS).register_dir(sf_dir, [t for t in TABLES if text is None or re.search(rf"\b{t}\b", text)])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters, filter, aggregate, sort: one query through the dialect."""
    text = "SELECT l_returnflag, l_linestatus, COUNT(*) AS cnt, SUM(l_quantity) AS qty, ROUND(AVG(l_discount), 6) AS disc FROM lineitem WHERE l_quantity > $q GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"
    return engine(spark, sf_dir, text).sql(text, {"q": 10})


def _by_sql(text: str, params: dict | None) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir, text).sql(text, params)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {"flagship": flagship}
    out |= {name: _by_sql(text, params) for name, (text, params, _) in sql_queries.ALL.items()}
    return out | operator_queries.queries()


def oracles() -> dict[str, str]:
    out = {"flagship": sql_queries.AGGREGATE["agg_group"][0]}
    out |= {name: oracle or text for name, (text, _, oracle) in sql_queries.ALL.items()}
    return out | operator_queries.oracles()

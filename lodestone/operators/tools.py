"""Queries of the bundled tools: catalogues, knowledge bases, archives and scanners, as filters and joins of ordinary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import IN, OUT, Graph, Policy


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Rows equal in all columns given; None leaves a column open."""
    for name, value in values.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows)."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def gaps(features: DataFrame, feature_edges: DataFrame, file_purposes: DataFrame) -> DataFrame:
    """(kind, name): features without a document, files of no feature, and source files without a test.

    feature_edges: feature_name, target_path, target_kind (source, test, doc).
    """
    kinds = lambda k: feature_edges.filter(F.col("target_kind") == k)
    no_doc = features.join(kinds("doc").select(F.col("feature_name").alias("name")), "name", "left_anti").select(F.lit("feature_without_doc").alias("kind"), "name")
    orphan = file_purposes.join(feature_edges.select(F.col("target_path").alias("path")), "path", "left_anti").select(F.lit("orphan_file").alias("kind"), F.col("path").alias("name"))
    tested = kinds("test").select("feature_name").distinct()
    untested = kinds("source").join(tested, "feature_name", "left_anti").select(F.lit("file_without_test").alias("kind"), F.col("target_path").alias("name")).distinct()
    return no_doc.unionByName(orphan).unionByName(untested)


def dependency_trace(deps: DataFrame, path: str, depth: int = 3, dependents: bool = False) -> DataFrame:
    """(path, depth): what ``path`` depends on, or what depends on it, within ``depth`` steps."""
    edges = deps.select(F.col("source_path").alias("source_key"), F.col("target_path").alias("target_key"), F.lit(0).alias("kind"), F.lit(1.0).alias("weight"))
    nodes = edges.select(F.col("source_key").alias("key"))
    return Graph(nodes, edges).reach([path], Policy(direction=IN if dependents else OUT, max_depth=depth)).select(F.col("key").alias("path"), "depth")


def archive_turns(conversations: DataFrame, conv_id: int) -> DataFrame:
    return conversations.filter(F.col("conv_id") == conv_id).orderBy("turn")


def using_directives(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """(path, namespace): the namespaces that source texts name in ``using`` lines."""
    return files.select(path, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^\s*using\s+(?:static\s+)?([A-Za-z_][\w.]*)\s*;"), 1))).alias("namespace"))


def file_references(files: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """(path, reference): file names that texts mention."""
    return files.select(path, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\w./-]+\.(?:cs|md|py|json|sql))\b"), 1))).alias("reference"))


def keyword_hits(files: DataFrame, keywords: dict[str, list[str]], path: str = "path", text: str = "content") -> DataFrame:
    """(path, feature, hits): how many of a feature's keywords a text has, where it has any."""
    low = F.lower(text)
    counts = [F.struct(F.lit(name).alias("feature"), sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0)).alias("hits")) for name, words in sorted(keywords.items())]
    return files.select(path, F.explode(F.array(*counts)).alias("x")).filter("x.hits > 0").select(path, "x.feature", "x.hits")

"""Property graph over two tables: nodes (key, kind, data, …) and edges (id, source_key, target_key, kind, weight).

Traversals run level by level: one join of the frontier with the edges, one
anti-join with what is visited. Each level is cut to a table, so the plan stays
flat and lost executors cost one level. Only convergence figures come to the
driver, never nodes or edges.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.durable import cut
from lodestone.functions.scalars import estimated_tokens

OUT, IN, BOTH = "out", "in", "both"


def met_path(forth: Column, back: Column) -> Column:
    """The whole path of two halves that end in the same node; ``back`` begins at the path's end."""
    return F.concat(forth, F.slice(F.reverse(back), F.lit(2), F.size(back)))


@dataclass(frozen=True)
class Policy:
    """How a traversal goes: limits are off where None."""

    direction: str = OUT
    max_depth: int = 3
    kind: int | None = None
    min_weight: float | None = None
    max_fanout: int | None = None
    node_kind: int | None = None
    stop_at: int | None = None
    max_tokens: int | None = None
    timeout: float | None = None


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    # lookups -----------------------------------------------------------------------------------------------------
    def node(self, key) -> DataFrame:
        """The node with that key; its newest row (largest id) where it has a history."""
        found = self.nodes.filter(F.col("key") == F.lit(key))
        return found.orderBy(F.desc_nulls_last("id")).limit(1) if "id" in self.nodes.columns else found.limit(1)

    def latest(self) -> DataFrame:
        """The newest row of every node."""
        w = Window.partitionBy("key").orderBy(F.desc_nulls_last("id"))
        return self.nodes.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

    def out_edges(self, key, kind: int | None = None) -> DataFrame:
        found = self.edges.filter(F.col("source_key") == F.lit(key))
        return found if kind is None else found.filter(F.col("kind") == kind)

    def in_edges(self, key, kind: int | None = None) -> DataFrame:
        found = self.edges.filter(F.col("target_key") == F.lit(key))
        return found if kind is None else found.filter(F.col("kind") == kind)

    # traversal ---------------------------------------------------------------------------------------------------
    def _steps(self, policy: Policy) -> DataFrame:
        """(a, b, eid): the edges that the policy may take, in its direction."""
        e = self.edges
        if policy.kind is not None:
            e = e.filter(F.col("kind") == policy.kind)
        if policy.min_weight is not None:
            e = e.filter(F.col("weight") >= policy.min_weight)
        eid = "id" if "id" in e.columns else None
        ident = F.col(eid).cast("long") if eid else F.xxhash64("source_key", "target_key", "kind")
        fwd = e.select(F.col("source_key").alias("a"), F.col("target_key").alias("b"), ident.alias("eid"))
        back = e.select(F.col("target_key").alias("a"), F.col("source_key").alias("b"), ident.alias("eid"))
        return {OUT: fwd, IN: back, BOTH: fwd.unionByName(back)}[policy.direction]

    def reach(self, start: list, policy: Policy) -> DataFrame:
        """(key, depth, path): every node reached, once, at its least depth, by the smallest path of that length.

        The fan-out limit counts a parent's new nodes in edge order; a node that
        several parents reach counts for the one with the smallest path.
        """
        spark = self.edges.sparkSession
        steps = self._steps(policy)
        kind = dict(self.edges.dtypes)["source_key"]
        seen = spark.createDataFrame([(s,) for s in start], f"key {kind}").select("key", F.lit(0).alias("depth"), F.array("key").alias("path"))
        frontier, began = seen, time.monotonic()
        for depth in range(1, policy.max_depth + 1):
            if policy.timeout is not None and time.monotonic() - began > policy.timeout:
                break
            found = frontier.alias("f").join(steps.alias("s"), F.col("f.key") == F.col("s.a")).select(F.col("s.b").alias("key"), F.col("f.key").alias("parent"), F.col("f.path").alias("path"), "s.eid")
            found = found.join(seen.select("key"), "key", "left_anti")
            new = found.groupBy("key").agg(F.min(F.struct("path", "eid", "parent")).alias("via"))
            if policy.max_fanout is not None:
                w = Window.partitionBy("via.parent").orderBy("via.eid", "key")
                new = new.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= policy.max_fanout)
            frontier = cut(new.select("key", F.lit(depth).alias("depth"), F.concat("via.path", F.array("key")).alias("path")), "frontier")
            seen = seen.unionByName(frontier)
            if frontier.isEmpty() or (policy.stop_at is not None and not frontier.filter(F.col("key") == policy.stop_at).isEmpty()):
                break
        return seen

    def traverse(self, start, policy: Policy = Policy(), include_paths: bool = False, include_data: bool = False) -> DataFrame:
        """Nodes reached from ``start``, itself included, breadth first. Keys without a node row are left out.

        ``node_kind`` hides other nodes but goes on through them. ``max_tokens``
        cuts in breadth-first order; the first node stays whatever it costs.
        """
        found = self.reach([start], policy)
        nodes = self.latest() if "id" in self.nodes.columns else self.nodes
        out = found.join(nodes, "key")
        if policy.node_kind is not None:
            out = out.filter(F.col("kind") == policy.node_kind)
        if policy.max_tokens is not None:
            out = _within_budget(out, policy.max_tokens, ["depth", "key"])
        wanted = ["key", "kind", "depth"] + (["path"] if include_paths else []) + (["data"] if include_data else [])
        return out.select(*wanted)

    def prepare_traversal(self, policy: Policy, **options) -> Callable:
        return lambda start: self.traverse(start, policy, **options)

    def shortest_path(self, start, end, policy: Policy = Policy(max_depth=10)) -> DataFrame:
        """(step, key) of a shortest path, the smallest of those of that length; no rows where none is within ``max_depth``.

        Whole levels grow from both ends in turn until they meet.
        """
        back = {OUT: IN, IN: OUT, BOTH: BOTH}[policy.direction]
        steps = {True: self._steps(policy), False: self._steps(replace(policy, direction=back))}
        spark, kind = self.edges.sparkSession, dict(self.edges.dtypes)["source_key"]
        seed = lambda x: spark.createDataFrame([(x,)], f"key {kind}").select("key", F.array("key").alias("path"))
        seen = {True: seed(start), False: seed(end)}
        front = dict(seen)
        empty = spark.createDataFrame([], f"step int, key {kind}")
        for k in range(policy.max_depth + 1):
            met = seen[True].alias("x").join(seen[False].alias("y"), "key").select(met_path(F.col("x.path"), F.col("y.path")).alias("path"))
            best = met.agg(F.min(F.struct(F.size("path"), "path")).alias("best")).first()["best"]
            if best is not None:
                return spark.createDataFrame([(i, v) for i, v in enumerate(best["path"])], f"step int, key {kind}")
            if k == policy.max_depth:
                break
            side = k % 2 == 0
            found = front[side].join(steps[side], F.col("key") == F.col("a")).select(F.col("b").alias("key"), "path").join(seen[side].select("key"), "key", "left_anti")
            front[side] = cut(found.groupBy("key").agg(F.min("path").alias("path")).select("key", F.concat("path", F.array("key")).alias("path")), "front")
            if front[side].isEmpty():
                return empty
            seen[side] = seen[side].unionByName(front[side])
        return empty

    def context(self, root, depth: int = 2, max_tokens: int | None = None) -> DataFrame:
        """(root, records, tokens, text): the data of outgoing nodes in breadth-first order, joined by newlines.

        A node's tokens are its own ``tokens`` or a quarter of its characters; the first record always stays.
        """
        out = self.reach([root], Policy(max_depth=depth)).join(self.latest() if "id" in self.nodes.columns else self.nodes, "key")
        out = _within_budget(out, max_tokens, ["depth", "key"])
        rows = F.sort_array(F.collect_list(F.struct("depth", "key", "data")))
        return out.agg(F.lit(root).alias("root"), F.count("*").alias("records"), F.coalesce(F.sum("_tokens"), F.lit(0)).alias("tokens"), F.array_join(F.transform(rows, lambda r: r["data"]), "\n").alias("text"))

    # algorithms --------------------------------------------------------------------------------------------------
    def page_rank(self, damping: float = 0.85, epsilon: float = 1e-6, max_rounds: int = 100) -> DataFrame:
        """(key, rank): dangling mass spreads evenly, parallel edges count each, edges to unknown nodes do not."""
        nodes = cut(self.nodes.select("key").distinct(), "nodes")
        n = nodes.count()
        if not n:
            return nodes.select("key", F.lit(0.0).alias("rank"))
        edges = self.edges.select(F.col("source_key").alias("a"), F.col("target_key").alias("b"))
        edges = edges.join(nodes, F.col("a") == F.col("key"), "left_semi").join(nodes, F.col("b") == F.col("key"), "left_semi")
        edges = cut(edges.groupBy("a", "b").agg(F.count("*").alias("m")), "edges")
        degree = edges.groupBy("a").agg(F.sum("m").alias("out"))
        share = cut(edges.join(degree, "a").select("a", "b", (F.col("m") / F.col("out")).alias("w")), "share")
        dangling = cut(nodes.join(degree, F.col("key") == F.col("a"), "left_anti"), "dangling")
        ranks = nodes.select("key", F.lit(1.0 / n).alias("rank"))
        for _ in range(max_rounds):
            lost = ranks.join(dangling, "key", "left_semi").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
            flow = share.join(ranks, F.col("a") == F.col("key")).groupBy("b").agg(F.sum(F.col("rank") * F.col("w")).alias("flow"))
            base = (1 - damping) / n + damping * lost / n
            new = ranks.join(flow, F.col("key") == F.col("b"), "left").select("key", F.col("rank").alias("old"), (F.lit(base) + damping * F.coalesce("flow", F.lit(0.0))).alias("rank"))
            new = cut(new, "ranks")
            gap = new.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
            ranks = new.select("key", "rank")
            if gap < epsilon:
                break
        return ranks

    def degrees(self, kind: int | None = None) -> DataFrame:
        """(key, in_degree, out_degree, degree) of every node."""
        e = self.edges if kind is None else self.edges.filter(F.col("kind") == kind)
        outs = e.groupBy(F.col("source_key").alias("key")).agg(F.count("*").alias("out_degree"))
        ins = e.groupBy(F.col("target_key").alias("key")).agg(F.count("*").alias("in_degree"))
        out = self.nodes.select("key").distinct().join(outs, "key", "left").join(ins, "key", "left").na.fill(0, ["out_degree", "in_degree"])
        return out.select("key", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("degree"))

    def topological_layers(self, kind: int | None = None) -> DataFrame:
        """(key, layer): layer 0 has no incoming edge, each next one only edges from earlier layers; a cycle is an error."""
        e = self.edges if kind is None else self.edges.filter(F.col("kind") == kind)
        left = cut(self.nodes.select("key").distinct(), "left")
        e = cut(e.select(F.col("source_key").alias("a"), F.col("target_key").alias("b")).join(left, F.col("a") == F.col("key"), "left_semi").join(left, F.col("b") == F.col("key"), "left_semi"), "edges")
        out, layer = None, 0
        while True:
            free = cut(left.join(e, F.col("key") == F.col("b"), "left_anti").select("key", F.lit(layer).alias("layer")), "free")
            if free.isEmpty():
                if not left.isEmpty():
                    raise ValueError("the graph has a cycle")
                return out if out is not None else free
            out = free if out is None else out.unionByName(free)
            left = cut(left.join(free, "key", "left_anti"), "left")
            e = cut(e.join(free, F.col("a") == F.col("key"), "left_anti"), "edges")
            layer += 1


def _within_budget(df: DataFrame, max_tokens: int | None, order: list[str]) -> DataFrame:
    tokens = estimated_tokens(F.coalesce("data", F.lit("")))
    if "tokens" in df.columns:
        tokens = F.coalesce(F.col("tokens").cast("long"), tokens)
    df = df.withColumn("_tokens", tokens)
    if max_tokens is None:
        return df
    # the answer to one lookup, in one order: a running sum needs its rows together
    w = Window.orderBy(*order)
    run = df.withColumn("_sum", F.sum("_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    return run.filter((F.col("_sum") <= max_tokens) | (F.col("_n") == 1)).drop("_sum", "_n")


class GraphWriter:
    """Changes to a graph as new frames; each call returns a writer with the state after it."""

    def __init__(self, graph: Graph, history: DataFrame | None = None, events: list | None = None):
        self.graph, self.history, self.events = graph, history, list(events or [])

    def _after(self, event: tuple, history: DataFrame | None = None, **parts) -> GraphWriter:
        return GraphWriter(replace(self.graph, **parts), history or self.history, [*self.events, event])

    def intern(self, rows: DataFrame) -> GraphWriter:
        """Insert nodes whose key is not there; those that are stay as they are."""
        new = rows.dropDuplicates(["key"]).join(self.graph.nodes, "key", "left_anti")
        return self._after(("intern", "node"), nodes=self.graph.nodes.unionByName(new, allowMissingColumns=True))

    def link(self, rows: DataFrame) -> GraphWriter:
        """Add edges; a missing weight is 1."""
        w = F.coalesce("weight", F.lit(1.0)) if "weight" in rows.columns else F.lit(1.0)
        return self._after(("link", "edge"), edges=self.graph.edges.unionByName(rows.withColumn("weight", w), allowMissingColumns=True))

    def unlink(self, condition) -> GraphWriter:
        """Delete edges; they go to the history."""
        gone = self.graph.edges.filter(F.coalesce(condition, F.lit(False)))
        history = gone if self.history is None else self.history.unionByName(gone)
        return self._after(("unlink", "edge"), history, edges=self.graph.edges.filter(~F.coalesce(condition, F.lit(False))))

    def remove(self, *keys) -> GraphWriter:
        """Delete nodes with all their edges."""
        one = self.unlink(F.col("source_key").isin(list(keys)) | F.col("target_key").isin(list(keys)))
        return one._after(("remove", "node"), nodes=self.graph.nodes.filter(~F.coalesce(F.col("key").isin(list(keys)), F.lit(False))))

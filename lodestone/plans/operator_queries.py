"""Queries over the operators that are functions rather than SQL text, with DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import filters as f
from lodestone.functions import scalars
from lodestone.operators import analysis, cypher, diff, tools, trust, vector
from lodestone.operators.engine import Engine, View, row_access
from lodestone.operators.graph import BOTH, IN, Graph, GraphWriter, Policy
from lodestone.sources import readers, sinks
from lodestone.streaming import changes

_QUERIES: dict = {}
_ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None):
    def add(function):
        _QUERIES[function.__name__] = function
        if oracle:
            _ORACLES[function.__name__] = oracle
        return function

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# builder and filter language ----------------------------------------------------------------------------------------
@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice BETWEEN 100000 AND 200000 OR o_orderpriority LIKE '1%') AND o_orderstatus NOT IN ('P') AND o_custkey >= 10")
def dsl_filter_tree(spark, sf):
    c = f.col
    return t(spark, sf, "orders").filter(f.all_of(f.any_of(c("o_totalprice").between(100000, 200000), c("o_orderpriority").starts_with("1")), c("o_orderstatus").not_in("P"), c("o_custkey").gte(10))).select("o_orderkey", "o_totalprice")


@_query("SELECT p_partkey FROM part WHERE p_name LIKE '%e%' AND p_type LIKE '%L' AND p_size <> 7 AND p_size < 40 AND p_retailprice > 910 AND p_brand IS NOT NULL")
def dsl_all_operators(spark, sf):
    c, df = f.col, t(spark, sf, "part")
    return df.filter(f.all_of(c("p_name").contains("e"), c("p_type").ends_with("L"), c("p_size").neq(7), f.ordinal(df, 4).lt(40), c("p_retailprice").apply(f.Op.GT, 910), ~c("p_brand").is_null())).select("p_partkey")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_discount - 0.05) <= 1e-12")
def dsl_approx_eq(spark, sf):
    return t(spark, sf, "lineitem").filter(f.col("l_discount").approx_eq(0.05)).select("l_orderkey", "l_linenumber")


@_query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 AND c_nationkey = 7 ORDER BY c_custkey LIMIT 10 OFFSET 2")
def builder_query(spark, sf):
    q = Engine(spark).register("customer", f"{sf}/customer.parquet", "c_custkey").table("customer")
    return q.where(F.col("c_acctbal") > 0).where(F.col("c_nationkey") == 7).order_by("c_custkey").offset(2).limit(10).query("c_custkey", "c_name")


@_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 20")
def keyset_page(spark, sf):
    return Engine(spark).register("orders", f"{sf}/orders.parquet", "o_orderkey").table("orders").after(100, 20).select("o_orderkey", "o_custkey")


@_query("SELECT * FROM customer WHERE c_custkey = 42")
def point_lookup(spark, sf):
    return Engine(spark).register("customer", f"{sf}/customer.parquet", "c_custkey").table("customer").seek(42)


@_query("SELECT c_custkey FROM customer WHERE c_nationkey = 4 AND c_mktsegment = 'BUILDING'")
def index_seek(spark, sf):
    return Engine(spark).register("customer", f"{sf}/customer.parquet").table("customer").seek_index(c_nationkey=4, c_mktsegment="BUILDING").select("c_custkey")


@_query("SELECT p_partkey, round((p_size - 20) * (p_size - 20) + (p_retailprice - 1000) * (p_retailprice - 1000), 4) AS score FROM part ORDER BY (p_size - 20) * (p_size - 20) + (p_retailprice - 1000) * (p_retailprice - 1000), p_partkey LIMIT 15")
def topk_scored(spark, sf):
    q = Engine(spark).register("part", f"{sf}/part.parquet", "p_partkey").table("part")
    score = (F.col("p_size") - 20) * (F.col("p_size") - 20) + (F.col("p_retailprice") - 1000) * (F.col("p_retailprice") - 1000)
    return q.top_k(15, score, "p_partkey").withColumn("score", F.round("score", 4))


@_query("SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 AND o_orderstatus = 'O'")
def prepared_query(spark, sf):
    e = Engine(spark).register("orders", f"{sf}/orders.parquet")
    return e.prepare("SELECT o_orderkey FROM orders WHERE o_totalprice > $p AND o_orderstatus = $s").execute({"p": 250000, "s": "O"})


@_query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_nationkey < 5")
def view_nested(spark, sf):
    e = Engine(spark).register("customer", f"{sf}/customer.parquet")
    e.create_view("rich", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer WHERE c_acctbal > 5000")
    e.create_view("near", "SELECT c_custkey, c_acctbal FROM rich WHERE c_nationkey < 5")
    return e.sql("SELECT * FROM near")


@_query("SELECT p_partkey, p_size FROM part WHERE p_size > 30 AND p_brand = 'Brand#11'")
def view_builder(spark, sf):
    view = View(t(spark, sf, "part")).select("p_partkey", "p_size").where(F.col("p_size") > 30).where(F.col("p_brand") == "Brand#11").named("big_parts")
    view.build()
    return spark.table("big_parts")


@_query("SELECT 'customer' AS \"table\", 5 AS columns UNION ALL SELECT 'nation', 3 UNION ALL SELECT 'region', 2")
def list_tables(spark, sf):
    return Engine(spark).register_dir(sf, ["region", "nation", "customer"]).tables()


@_query("SELECT 'nation' AS \"table\", count(*) AS rows FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def row_counts(spark, sf):
    return tools.row_counts({n: t(spark, sf, n) for n in ("nation", "region")})


@_query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")
def entitled_query(spark, sf):
    agent = Engine(spark).register_dir(sf, ["customer", "orders"]).as_agent(["customer.c_custkey", "customer.c_n*", "customer.c_name", "customer.c_nationkey"])
    return agent.sql("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")


@_query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src3')")
def row_access_filter(spark, sf):
    return row_access(t(spark, sf, "documents"), "source", ["src1", "src3"]).select("doc_id", "source")


# scalar functions ---------------------------------------------------------------------------------------------------
@_query("SELECT o_orderkey, sha256(o_orderpriority) AS digest FROM orders")
def hash_sha256(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", scalars.sha256_hex(F.col("o_orderpriority")).alias("digest"))


@_query("SELECT o_orderkey, printf('%016x', CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, strlen(o_orderpriority) + 1), lambda i: CAST(ascii(substr(o_orderpriority, i, 1)) AS UHUGEINT))), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS UBIGINT)) AS digest FROM orders")
def hash_fnv1a(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", F.lower(F.lpad(F.hex(scalars.fnv1a64(F.col("o_orderpriority"))), 16, "0")).alias("digest"))


@_query("SELECT o_orderkey, lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)) AS guid, o_orderkey AS high, o_custkey AS low FROM (SELECT o_orderkey, o_custkey, printf('%016x', o_orderkey) || printf('%016x', o_custkey) AS h FROM orders)")
def guid_split_merge(spark, sf):
    df = t(spark, sf, "orders").select("o_orderkey", scalars.guid_from_halves(F.col("o_orderkey"), F.col("o_custkey")).alias("guid"))
    high, low = scalars.guid_halves(F.col("guid"))
    return df.select("o_orderkey", "guid", high.alias("high"), low.alias("low"))


@_query("SELECT event_id, d, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS z, d AS back FROM (SELECT event_id, user_id - lag(user_id) OVER (ORDER BY event_id) AS d FROM events)")
def codec_delta_zigzag(spark, sf):
    from pyspark.sql import Window

    d = t(spark, sf, "events").select("event_id", scalars.delta(F.col("user_id"), Window.orderBy("event_id")).alias("d"))
    z = d.withColumn("z", scalars.zigzag(F.col("d")))
    return z.withColumn("back", scalars.unzigzag(F.col("z")))


@_query("SELECT doc_id, round((length(text) - length(replace(text, 'the', ''))) / 3.0 / strlen(text) + (length(text) - length(replace(text, 'on', ''))) / 2.0 / strlen(text), 8) AS score FROM documents")
def text_score(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.round(scalars.text_score(F.col("text"), ["the", "on"]), 8).alias("score"))


@_query("SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(18, 2)) AS VARCHAR) AS price FROM part")
def decimal_cast(spark, sf):
    return t(spark, sf, "part").select("p_partkey", scalars.decimal128(F.col("p_retailprice"), 2).cast("string").alias("price"))


# vectors ------------------------------------------------------------------------------------------------------------
_V = "CAST(e.embedding AS DOUBLE[])"
_VQ = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)"


def _search(spark, sf, metric=vector.COSINE):
    df = t(spark, sf, "embeddings")
    q = df.filter("vec_id = 0").first()["embedding"]
    return vector.VectorSearch(df, "vec_id", "embedding", metric), list(q)


def _rounded(df):
    return df.withColumn("distance", F.round("distance", 6))


@_query(f"SELECT vec_id, round(list_cosine_distance({_V}, {_VQ}), 6) AS distance, label FROM embeddings e ORDER BY list_cosine_distance({_V}, {_VQ}), vec_id LIMIT 10")
def vec_cosine_topk(spark, sf):
    s, q = _search(spark, sf)
    return _rounded(s.nearest(q, 10, "label"))


@_query(f"SELECT vec_id, round(list_distance({_V}, {_VQ}), 6) AS distance FROM embeddings e ORDER BY list_distance({_V}, {_VQ}), vec_id LIMIT 10")
def vec_l2_topk(spark, sf):
    s, q = _search(spark, sf, vector.EUCLIDEAN)
    return _rounded(s.nearest(q, 10))


@_query(f"SELECT vec_id, round(list_inner_product({_V}, {_VQ}), 6) AS distance FROM embeddings e ORDER BY list_inner_product({_V}, {_VQ}) DESC, vec_id LIMIT 10")
def vec_dot_topk(spark, sf):
    s, q = _search(spark, sf, vector.DOT)
    return _rounded(s.nearest(q, 10))


@_query(f"SELECT vec_id, round(list_cosine_distance({_V}, {_VQ}), 6) AS distance FROM embeddings e WHERE label = 3 ORDER BY list_cosine_distance({_V}, {_VQ}), vec_id LIMIT 10")
def vec_filtered(spark, sf):
    s, q = _search(spark, sf)
    return _rounded(s.where(F.col("label") == 3).nearest(q, 10))


@_query(f"SELECT vec_id, round(list_distance({_V}, {_VQ}), 6) AS distance FROM embeddings e WHERE list_distance({_V}, {_VQ}) <= 10.5")
def vec_within(spark, sf):
    s, q = _search(spark, sf, vector.EUCLIDEAN)
    return _rounded(s.within(q, 10.5))


@_query(f"SELECT vec_id, round(d, 6) AS distance, label * 10 + vec_id % 7 AS score FROM (SELECT vec_id, label, list_cosine_distance({_V}, {_VQ}) AS d FROM embeddings e ORDER BY d, vec_id LIMIT 40) ORDER BY score, vec_id LIMIT 10")
def vec_rerank(spark, sf):
    s, q = _search(spark, sf)
    return _rounded(s.rerank(q, 10, F.col("label") * 10 + F.col("vec_id") % 7))


@_query("SELECT q.vec_id AS query, e.vec_id AS key, round(list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 5) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9), e.vec_id) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5")
def vec_batch_exact(spark, sf):
    df = t(spark, sf, "embeddings")
    return vector.batch_nearest(df.filter("vec_id % 50 = 0"), df, "vec_id", "embedding", 5).withColumn("distance", F.round("distance", 5))


@_query()
def vec_index_search(spark, sf):
    df = t(spark, sf, "embeddings")
    return vector.InvertedFile.build(df, "vec_id", "embedding").search(df.filter("vec_id % 50 = 0"), 10)


_HYBRID = f"""WITH d AS (SELECT doc_id, text, CAST(embedding AS DOUBLE[]) AS v FROM documents JOIN embeddings ON doc_id = vec_id),
a AS (SELECT doc_id, row_number() OVER (ORDER BY list_cosine_distance(v, {_VQ}), doc_id) AS vector_rank FROM d QUALIFY vector_rank <= 30),
s AS (SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) / 3.0 + (length(text) - length(replace(text, 'con', ''))) / 3.0) / strlen(text) AS x FROM d),
b AS (SELECT doc_id, row_number() OVER (ORDER BY x DESC, doc_id) AS text_rank FROM s WHERE x > 0 QUALIFY text_rank <= 30),
m AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(1.0 / (60 + vector_rank), 0) + coalesce(1.0 / (60 + text_rank), 0) AS s, vector_rank AS v, text_rank AS x FROM a FULL JOIN b ON a.doc_id = b.doc_id)
SELECT doc_id, round(s, 8) AS score, CAST(coalesce(v, 0) AS INT) AS vector_rank, CAST(coalesce(x, 0) AS INT) AS text_rank FROM m ORDER BY s DESC, v NULLS LAST, x NULLS LAST, doc_id LIMIT 10"""


@_query(_HYBRID)
def hybrid_rrf(spark, sf):
    docs, e = t(spark, sf, "documents"), t(spark, sf, "embeddings")
    _, q = _search(spark, sf)
    both = docs.join(e, docs["doc_id"] == e["vec_id"])
    return vector.hybrid(both, "doc_id", "embedding", "text", q, ["the", "con"], 10).withColumn("score", F.round("score", 8))


# graph --------------------------------------------------------------------------------------------------------------
_NODES = """SELECT CAST(10000000 + r_regionkey AS BIGINT) AS key, 1 AS kind, r_name AS data FROM region
UNION ALL SELECT 20000000 + n_nationkey, 2, n_name FROM nation UNION ALL SELECT 30000000 + c_custkey, 3, c_name FROM customer
UNION ALL SELECT 40000000 + s_suppkey, 4, s_name FROM supplier UNION ALL SELECT 50000000 + o_orderkey, 5, o_orderstatus FROM orders"""
_EDGES = """SELECT CAST(10000000 + n_regionkey AS BIGINT) AS source_key, CAST(20000000 + n_nationkey AS BIGINT) AS target_key, 10 AS kind, CAST(1.0 AS DOUBLE) AS weight FROM nation
UNION ALL SELECT 20000000 + c_nationkey, 30000000 + c_custkey, 10, 1.0 FROM customer UNION ALL SELECT 20000000 + s_nationkey, 40000000 + s_suppkey, 10, 1.0 FROM supplier
UNION ALL SELECT 30000000 + o_custkey, 50000000 + o_orderkey, 31, o_totalprice FROM orders"""
_G = f"nodes AS ({_NODES}), edges AS ({_EDGES})"


def graph_of(spark, sf) -> Graph:
    """Regions, nations, customers, suppliers and orders as a graph; a key is kind * 10,000,000 + id."""
    e = Engine(spark).register_dir(sf, ["region", "nation", "customer", "supplier", "orders"])
    return Graph(e.sql(_NODES), e.sql(_EDGES).withColumn("weight", F.col("weight").cast("double")))


def _bfs(start: int, depth: int, where: str = "TRUE", back: bool = False) -> str:
    a, b = ("target_key", "source_key") if back else ("source_key", "target_key")
    return f"WITH RECURSIVE {_G}, r(key, depth) AS (SELECT CAST({start} AS BIGINT), 0 UNION SELECT e.{b}, r.depth + 1 FROM r JOIN edges e ON e.{a} = r.key WHERE r.depth < {depth} AND {where}) SELECT n.key, n.kind, min(depth) AS depth FROM r JOIN nodes n USING (key) GROUP BY n.key, n.kind"


@_query(f"WITH {_G} SELECT * FROM nodes WHERE key = 20000003")
def graph_node(spark, sf):
    return graph_of(spark, sf).node(20000003)


@_query(f"WITH {_G} SELECT source_key, target_key, kind FROM edges WHERE source_key = 20000003 AND kind = 10")
def graph_neighbors(spark, sf):
    return graph_of(spark, sf).out_edges(20000003, 10).select("source_key", "target_key", "kind")


@_query(f"WITH {_G} SELECT source_key, target_key, kind FROM edges WHERE target_key = 30000007")
def graph_incoming(spark, sf):
    return graph_of(spark, sf).in_edges(30000007).select("source_key", "target_key", "kind")


@_query(_bfs(10000001, 3))
def graph_bfs(spark, sf):
    return graph_of(spark, sf).traverse(10000001, Policy(max_depth=3))


@_query(_bfs(50000007, 3, back=True))
def graph_bfs_in(spark, sf):
    return graph_of(spark, sf).traverse(50000007, Policy(direction=IN, max_depth=3))


@_query(_bfs(20000003, 2, "e.weight >= 200000 OR e.kind = 10"))
def graph_bfs_pruned(spark, sf):
    g = graph_of(spark, sf)
    return Graph(g.nodes, g.edges.filter("weight >= 200000 or kind = 10")).traverse(20000003, Policy(max_depth=2))


@_query(f"SELECT * FROM ({_bfs(10000001, 2)}) WHERE kind = 4")
def graph_bfs_node_kind(spark, sf):
    return graph_of(spark, sf).traverse(10000001, Policy(max_depth=2, node_kind=4))


@_query()
def graph_bfs_fanout(spark, sf):
    return graph_of(spark, sf).traverse(10000001, Policy(max_depth=3, max_fanout=2), include_paths=True)


@_query(f"WITH {_G}, o AS (SELECT 50000007 AS k), p AS (SELECT e1.target_key AS a, e1.source_key AS b, e2.source_key AS c, e3.source_key AS d FROM edges e1 JOIN edges e2 ON e2.target_key = e1.source_key JOIN edges e3 ON e3.target_key = e2.source_key WHERE e1.target_key = 50000007) SELECT 0 AS step, a AS key FROM p UNION ALL SELECT 1, b FROM p UNION ALL SELECT 2, c FROM p UNION ALL SELECT 3, d FROM p")
def graph_shortest_path(spark, sf):
    g = graph_of(spark, sf)
    order = 50000007
    region = g.reach([order], Policy(direction=IN, max_depth=3)).filter("depth = 3").first()["key"]
    return g.shortest_path(order, region, Policy(direction=IN, max_depth=5))


@_query(f"WITH {_G} SELECT n.key, count(DISTINCT i.source_key || ':' || i.target_key) AS in_degree, count(DISTINCT o.source_key || ':' || o.target_key) AS out_degree, count(DISTINCT i.source_key || ':' || i.target_key) + count(DISTINCT o.source_key || ':' || o.target_key) AS degree FROM nodes n LEFT JOIN edges i ON i.target_key = n.key LEFT JOIN edges o ON o.source_key = n.key GROUP BY n.key")
def graph_degree(spark, sf):
    return graph_of(spark, sf).degrees()


@_query(f"WITH RECURSIVE {_G}, r(key, layer) AS (SELECT key, 0 FROM nodes WHERE key NOT IN (SELECT target_key FROM edges) UNION ALL SELECT target_key, layer + 1 FROM r JOIN edges ON source_key = key) SELECT key, max(layer) AS layer FROM r GROUP BY key")
def graph_toposort_layers(spark, sf):
    return graph_of(spark, sf).topological_layers()


def _rank_round(before: str) -> str:
    return f"(SELECT n.key, 0.15 / c.n + 0.85 * d.lost / c.n + 0.85 * coalesce(s.flow, 0) AS rank FROM nodes n CROSS JOIN c CROSS JOIN (SELECT coalesce(sum(b.rank), 0) AS lost FROM {before} b WHERE b.key NOT IN (SELECT source_key FROM edges)) d LEFT JOIN (SELECT e.target_key, sum(b.rank / g.deg) AS flow FROM edges e JOIN {before} b ON b.key = e.source_key JOIN (SELECT source_key, count(*) AS deg FROM edges GROUP BY source_key) g ON g.source_key = e.source_key GROUP BY e.target_key) s ON s.target_key = n.key)"


@_query(f"WITH {_G}, c AS (SELECT count(*) AS n FROM nodes), r0 AS (SELECT key, 1.0 / n AS rank FROM nodes, c), r1 AS {_rank_round('r0')}, r2 AS {_rank_round('r1')}, r3 AS {_rank_round('r2')} SELECT key, round(rank, 10) AS rank FROM r3")
def graph_pagerank(spark, sf):
    return graph_of(spark, sf).page_rank(max_rounds=3, epsilon=0.0).withColumn("rank", F.round("rank", 10))


@_query(f"WITH {_G}, r AS (SELECT 0 AS depth, key, data FROM nodes WHERE key = 20000003 UNION ALL SELECT 1, n.key, n.data FROM nodes n JOIN edges e ON e.target_key = n.key WHERE e.source_key = 20000003), x AS (SELECT *, greatest(1, length(data) // 4) AS tok, sum(greatest(1, length(data) // 4)) OVER (ORDER BY depth, key) AS run FROM r) SELECT 20000003 AS root, count(*) AS records, CAST(sum(tok) AS BIGINT) AS tokens, string_agg(data, chr(10) ORDER BY depth, key) AS text FROM x WHERE run <= 40")
def graph_context(spark, sf):
    return graph_of(spark, sf).context(20000003, 1, 40)


@_query(_bfs(20000003, 2, "e.kind = 10"))
def graph_pattern(spark, sf):
    return cypher.run(graph_of(spark, sf), "MATCH (a) |> [r:CONTAINS*..2] |> (b) WHERE a.key = 20000003 RETURN b")


@_query("SELECT 0 AS step, CAST(10000000 + n_regionkey AS BIGINT) AS key FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 1, 20000003")
def graph_pattern_shortest(spark, sf):
    region = t(spark, sf, "nation").filter("n_nationkey = 3").first()["n_regionkey"] + 10000000
    return cypher.run(graph_of(spark, sf), "MATCH p = shortestPath((a) |> [*..4] |> (b)) WHERE a.key = $x AND b.key = 20000003 RETURN p", x=region)


@_query(f"WITH {_G} SELECT DISTINCT f.target_key AS key FROM edges e JOIN edges f ON f.source_key = e.target_key WHERE e.source_key = 20000003 AND e.kind = 10 AND f.kind = 31")
def graph_arrow_path(spark, sf):
    return cypher.arrow_path(graph_of(spark, sf), "20000003 |> CONTAINS |> * |> FOLLOWS |> *")


@_query(_bfs(20000004, 1))
def graph_layer_view(spark, sf):
    e = Engine(spark).register_layer("reached", graph_of(spark, sf).traverse(20000004, Policy(max_depth=1)))
    return e.sql("SELECT key, kind, depth FROM reached")


@_query(f"WITH {_G} SELECT source_key, count(*) AS n FROM edges WHERE source_key <> 20000003 AND target_key <> 20000003 GROUP BY source_key")
def graph_remove_node(spark, sf):
    after = GraphWriter(graph_of(spark, sf)).remove(20000003).graph
    return after.edges.groupBy("source_key").agg(F.count("*").alias("n"))


@_query(_bfs(30000007, 2).replace("edges e ON e.source_key", "(SELECT source_key, target_key FROM edges UNION ALL SELECT target_key, source_key FROM edges) e ON e.source_key"))
def graph_bfs_both(spark, sf):
    return graph_of(spark, sf).traverse(30000007, Policy(direction=BOTH, max_depth=2))


# diff and fusion ----------------------------------------------------------------------------------------------------
def _versions(spark, sf):
    left = t(spark, sf, "supplier")
    right = left.filter("s_suppkey % 7 <> 3").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 5 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))
    return left, right.unionByName(left.filter("s_suppkey < 4").withColumn("s_suppkey", F.col("s_suppkey") + 1000000))


_RIGHT = "(SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 7 <> 3 UNION ALL SELECT s_suppkey + 1000000, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey < 4)"


@_query(f"SELECT count(*) FILTER (l.s_suppkey = r.s_suppkey AND l.s_acctbal = r.s_acctbal) AS matching, count(*) FILTER (l.s_suppkey = r.s_suppkey AND l.s_acctbal <> r.s_acctbal) AS modified, count(*) FILTER (r.s_suppkey IS NULL) AS left_only, count(*) FILTER (l.s_suppkey IS NULL) AS right_only FROM supplier l FULL JOIN {_RIGHT} r ON l.s_suppkey = r.s_suppkey")
def table_diff(spark, sf):
    return diff.table_diff(*_versions(spark, sf), "s_suppkey")


@_query("SELECT * FROM (VALUES ('a', 'x', 'type_changed', 'int', 'bigint'), ('a', 'y', 'left_only', 'string', NULL), ('b', NULL, 'right_only', NULL, NULL)) v(\"table\", \"column\", change, left_type, right_type)")
def schema_diff(spark, sf):
    empty = lambda ddl: spark.createDataFrame([], ddl)
    return diff.schema_diff({"a": empty("x int, y string")}, {"a": empty("x long"), "b": empty("z int")})


@_query("SELECT n_nationkey AS k, n_name AS name, 'nations' AS source FROM nation UNION ALL SELECT r_regionkey, r_name, 'regions' FROM region")
def fused_scan(spark, sf):
    arcs = {"nations": {"names": t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))}, "regions": {"names": t(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))}, "other": {}}
    return diff.fused_query(arcs, "names")


@_query("SELECT * FROM (VALUES ('names', 'a,b', 2), ('more', 'b', 1)) v(\"table\", sources, columns)")
def discover_tables(spark, sf):
    n = t(spark, sf, "nation")
    return diff.discover({"a": {"names": n.select("n_nationkey", "n_name")}, "b": {"names": n.select("n_nationkey", "n_name"), "more": n.select("n_name")}})


# ledgers ------------------------------------------------------------------------------------------------------------
_LEDGER = "(SELECT event_id + 1 AS seq, user_id, CAST(user_id AS VARCHAR) || '|' || event_type AS payload FROM events)"


def _ledger(spark, sf):
    e = t(spark, sf, "events").select((F.col("event_id") + 1).alias("seq"), "user_id", F.concat_ws("|", "user_id", "event_type").alias("payload"))
    return trust.chain(e)


@_query(f"SELECT seq, sha256(payload) AS payload_hash, coalesce(lag(sha256(payload)) OVER (ORDER BY seq), '') AS prev_hash FROM {_LEDGER}")
def ledger_chain(spark, sf):
    return _ledger(spark, sf).select("seq", "payload_hash", "prev_hash")


@_query("SELECT count(*) AS entries, FALSE AS valid, CAST(6 AS BIGINT) AS first_bad FROM events")
def ledger_verify(spark, sf):
    broken = _ledger(spark, sf).withColumn("payload", F.when(F.col("seq") == 6, "forged").otherwise(F.col("payload")))
    return trust.verify(broken)


@_query("SELECT CAST(9 AS BIGINT) AS common, CAST(10 AS BIGINT) AS diverges_at, count(*) - 9 AS left_only, count(*) - 9 AS right_only FROM events")
def ledger_diff(spark, sf):
    left = _ledger(spark, sf)
    return diff.ledger_diff(left, left.withColumn("payload_hash", F.when(F.col("seq") >= 10, F.sha2("payload_hash", 256)).otherwise(F.col("payload_hash"))))


@_query("SELECT user_id AS agent, round(1 + sum(CASE WHEN ok THEN w ELSE 0 END), 8) AS alpha, round(1 + sum(CASE WHEN ok THEN 0 ELSE w END), 8) AS beta, count(*) AS ratings FROM (SELECT user_id, event_type <> 'error' AS ok, pow(0.5, (max(epoch_us(ts)) OVER (PARTITION BY user_id) - epoch_us(ts)) / 2592000000000.0) AS w FROM events) GROUP BY user_id")
def reputation(spark, sf):
    e = t(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    out = trust.reputation(e, "user_id", "us", F.col("event_type") != "error")
    return out.select("agent", F.round("alpha", 8).alias("alpha"), F.round("beta", 8).alias("beta"), "ratings")


@_query("SELECT user_id, max_by(value, event_id) AS score FROM events GROUP BY user_id")
def reputation_latest(spark, sf):
    e = t(spark, sf, "events").select("user_id", F.col("value").alias("score"), F.col("event_id").alias("last_updated"))
    return trust.reputation_of(e, e.select("user_id").distinct(), "user_id")


@_query("SELECT e.event_id, (SELECT count(*) FROM events x WHERE x.user_id = e.user_id AND epoch_us(x.ts) BETWEEN epoch_us(e.ts) AND epoch_us(e.ts) + 86400000000) AS in_window FROM events e")
def velocity_window(spark, sf):
    e = t(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return analysis.velocity(e, "user_id", "us", 86400).select("event_id", "in_window")


@_query("WITH RECURSIVE v AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN CURRENT ROW AND 259200000000 FOLLOWING) AS c FROM events), f AS (SELECT * FROM v WHERE c > 2), g AS (SELECT f.*, (SELECT min(x.n) FROM f x WHERE x.user_id = f.user_id AND x.n >= f.n + f.c) AS next FROM f), r AS (SELECT * FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n) = 1) UNION ALL SELECT g.* FROM r JOIN g ON g.user_id = r.user_id AND g.n = r.next) SELECT user_id AS agent, t AS start, c AS count FROM r")
def velocity_spikes(spark, sf):
    e = t(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return analysis.velocity_spikes(e, "user_id", "us", 86400 * 3, 2)


@_query("WITH e AS (SELECT event_id + 1 AS s, CASE WHEN event_id % 100 < 40 THEN 'p' || (event_id % 2) ELSE CAST(user_id AS VARCHAR) END AS x FROM events), n AS (SELECT s, x, lag(x) OVER (ORDER BY s) AS p1, lag(x, 2) OVER (ORDER BY s) AS p2 FROM e), g AS (SELECT s, s - row_number() OVER (ORDER BY s) AS island FROM n WHERE x = p2 AND x <> p1), r AS (SELECT min(s) - 2 AS first_seq, count(*) + 2 AS n FROM g GROUP BY island) SELECT first_seq, a.x AS a, b.x AS b, n // 2 AS cycles FROM r JOIN e a ON a.s = first_seq JOIN e b ON b.s = first_seq + 1 WHERE n >= 6")
def ping_pong(spark, sf):
    e = t(spark, sf, "events").select((F.col("event_id") + 1).alias("seq"), F.when(F.col("event_id") % 100 < 40, F.concat(F.lit("p"), F.col("event_id") % 2)).otherwise(F.col("user_id").cast("string")).alias("agent"))
    return analysis.ping_pong(e, "seq", "agent")


# context and tools --------------------------------------------------------------------------------------------------
@_query("WITH s AS (SELECT p_name AS path, CASE WHEN contains(lower(p_name), 're') THEN 2.0 ELSE 0 END + CASE WHEN contains(lower(p_brand), 're') THEN 1.25 ELSE 0 END + CASE WHEN contains(lower(p_type), 're') THEN 0.75 ELSE 0 END + CASE WHEN contains(lower(p_name), 'brand') THEN 2.0 ELSE 0 END + CASE WHEN contains(lower(p_brand), 'brand') THEN 1.25 ELSE 0 END + CASE WHEN contains(lower(p_type), 'brand') THEN 0.75 ELSE 0 END + CASE WHEN contains(lower(p_name), 'test') THEN 0.25 ELSE 0 END AS score, CAST(greatest(1, (length(p_type) + 3) // 4) AS BIGINT) AS tokens FROM (SELECT p_name || '/' || p_partkey AS p_name, p_brand, p_type FROM part)), b AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, path LIMIT 20), r AS (SELECT *, sum(tokens) OVER (ORDER BY score DESC, path) AS run FROM b) SELECT path, CAST(score AS DOUBLE) AS score, round(least(1.0, CAST(score AS DOUBLE) / 7), 6) AS confidence, tokens FROM r WHERE run <= 30")
def context_rank(spark, sf):
    c = t(spark, sf, "part").select(F.concat_ws("/", "p_name", "p_partkey").alias("path"), F.col("p_brand").alias("symbol"), F.col("p_type").alias("excerpt"))
    return analysis.rank_context(c, "re brand", budget=30).withColumn("confidence", F.round("confidence", 6))


def _deps(spark, sf):
    return t(spark, sf, "nation").select(F.col("n_name").alias("source_path"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("target_path"))


@_query("SELECT 'r1' AS target, count(*) AS dependents, CAST(CASE WHEN count(*) > 10 THEN 0.8 WHEN count(*) > 3 THEN 0.4 ELSE 0.1 END AS DOUBLE) AS risk, CASE WHEN count(*) > 10 THEN 'e2e' WHEN count(*) > 3 THEN 'integration' ELSE 'unit' END AS envelope FROM nation WHERE n_regionkey = 1")
def impact_report(spark, sf):
    return analysis.impact_report(_deps(spark, sf), "r1")


@_query("SELECT n_name AS path, (n_nationkey % 4) / 3.0 AS coverage, 1 - (n_nationkey % 4) / 3.0 AS score FROM nation WHERE n_regionkey = 1")
def direct_impact(spark, sf):
    signals = t(spark, sf, "nation").select(F.col("n_name").alias("path"), ((F.col("n_nationkey") % 4) / 3.0).alias("coverage"))
    return analysis.direct_impact(_deps(spark, sf), signals, "r1")


@_query("SELECT n_name AS path, 1 AS depth FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'r2', 0")
def dependency_trace(spark, sf):
    return tools.dependency_trace(_deps(spark, sf), "r2", 2, dependents=True)


@_query("SELECT 'feature_without_doc' AS kind, r_name AS name FROM region WHERE r_regionkey NOT IN (1, 2) UNION ALL SELECT 'orphan_file', n_name FROM nation WHERE n_regionkey > 2 UNION ALL SELECT DISTINCT 'file_without_test', n_name FROM nation WHERE n_regionkey = 0")
def knowledge_gaps(spark, sf):
    r, n = t(spark, sf, "region"), t(spark, sf, "nation")
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).filter("n_regionkey <= 2")
    kind = F.when(F.col("n_regionkey") == 0, "source").when(F.col("n_regionkey") == 1, "doc").otherwise("doc")
    edges = both.select(F.col("r_name").alias("feature_name"), F.col("n_name").alias("target_path"), kind.alias("target_kind"))
    return tools.gaps(r.select(F.col("r_name").alias("name")), edges, n.select(F.col("n_name").alias("path")))


@_query("SELECT turn, role, text FROM conversations WHERE conv_id = 3")
def archive_turns(spark, sf):
    return tools.archive_turns(t(spark, sf, "conversations"), 3).select("turn", "role", "text")


@_query("SELECT CAST(doc_id AS VARCHAR) AS path, 'en' AS feature, CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'and') AS INT) AS hits FROM documents WHERE contains(lower(text), 'the') OR contains(lower(text), 'and')")
def keyword_hits(spark, sf):
    docs = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return tools.keyword_hits(docs, {"en": ["the", "and"]})


# sources and sinks --------------------------------------------------------------------------------------------------
def _scratch(spark) -> str:
    import uuid

    from lodestone.functions.durable import shared_dir

    return f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"


@_query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_roundtrip(spark, sf):
    path = _scratch(spark)
    t(spark, sf, "nation").coalesce(1).write.option("header", True).csv(path)
    return readers.read_csv(spark, path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


@_query("SELECT s_suppkey, CASE WHEN s_suppkey < 5 THEN 'changed' ELSE s_name END AS s_name FROM supplier UNION ALL SELECT -1, 'new'")
def upsert(spark, sf):
    now = t(spark, sf, "supplier").select("s_suppkey", "s_name")
    rows = now.filter("s_suppkey < 5").withColumn("s_name", F.lit("changed")).unionByName(spark.createDataFrame([(-1, "new")], now.schema))
    return sinks.upsert(now, rows, "s_suppkey")


@_query("SELECT c_custkey, c_acctbal FROM customer WHERE NOT coalesce(c_acctbal < 1000, FALSE)")
def delete_where(spark, sf):
    return sinks.delete_where(t(spark, sf, "customer").select("c_custkey", "c_acctbal"), F.col("c_acctbal") < 1000)


@_query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey <> 3 AND s_acctbal >= 0 UNION ALL SELECT -1, 'x', 1.5")
def table_transaction(spark, sf):
    rows = t(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    table = sinks.MutableTable(spark, _scratch(spark), "s_suppkey").create(rows.schema).insert(rows).delete(3)
    with table.transaction() as tx:
        tx.insert(spark.createDataFrame([(-1, "x", 1.5)], rows.schema))
        tx.delete_where(F.col("s_acctbal") < 0)
    return table.read()


@_query("SELECT n_nationkey, n_name FROM nation")
def encrypted_column(spark, sf):
    key = b"0123456789abcdef"
    sealed = t(spark, sf, "nation").select("n_nationkey", readers.encrypt(F.col("n_name"), key).alias("n_name"))
    return sealed.select("n_nationkey", readers.decrypt(F.col("n_name"), key).alias("n_name"))


@_query("SELECT s_suppkey AS k, CASE WHEN l.s_suppkey IS NULL THEN 'create' WHEN r.s_suppkey IS NULL THEN 'delete' ELSE 'update' END AS kind FROM (SELECT * FROM supplier) l FULL JOIN " + _RIGHT + " r USING (s_suppkey) WHERE l.s_acctbal IS DISTINCT FROM r.s_acctbal")
def change_feed(spark, sf):
    return changes.change_rows(*_versions(spark, sf), "s_suppkey").select(F.col("s_suppkey").alias("k"), "kind")


@_query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark, sf):
    return changes.tumbling(t(spark, sf, "events"), "ts", "1 day", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@_query("SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM (SELECT *, sum(CAST(begins AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR, TRUE) AS begins FROM events)) GROUP BY user_id, s")
def session_counts(spark, sf):
    out = changes.sessions(t(spark, sf, "events"), "ts", "6 hours", "user_id")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})

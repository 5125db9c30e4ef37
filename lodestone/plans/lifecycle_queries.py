"""Queries over sources, sinks and the prepared forms of operators, with DuckDB counterparts."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import scalars
from lodestone.functions import filters as f
from lodestone.operators import analysis, cypher, diff, tools, trust, vector
from lodestone.operators.engine import Agent, Engine
from lodestone.operators.graph import Policy
from lodestone.plans.operator_queries import _LEDGER, _V, _VQ, _bfs, _ledger, _query, _rounded, _scratch, _search, graph_of, t
from lodestone.sources import readers, sinks
from lodestone.streaming import changes


def _put(spark: SparkSession, path: str, data: bytes) -> str:
    """A small file in the shared folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(data)
    out.close()
    return path


def _nations(spark, sf) -> list:
    """The 25 rows of nation, for files that are built from them."""
    return t(spark, sf, "nation").orderBy("n_nationkey").collect()


# sinks --------------------------------------------------------------------------------------------------------------
def _table(spark, df: DataFrame, key: str) -> sinks.MutableTable:
    return sinks.MutableTable(spark, _scratch(spark), key).create(df.schema).insert(df)


@_query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'seen' ELSE s_name END AS s_name FROM supplier")
def table_update(spark, sf):
    rows = t(spark, sf, "supplier").select("s_suppkey", "s_name")
    new = rows.filter("s_suppkey % 3 = 0").unionByName(rows.limit(1).withColumn("s_suppkey", (F.lit(-5)).cast(rows.schema["s_suppkey"].dataType)))
    return _table(spark, rows, "s_suppkey").update(new.withColumn("s_name", F.lit("seen"))).read()


@_query("SELECT s_suppkey, s_name, 7 AS grade FROM supplier")
def table_alter_rename(spark, sf):
    table = _table(spark, t(spark, sf, "supplier").select("s_suppkey", "s_name"), "s_suppkey")
    return table.add_column("grade", "int", 7).rename_to(_scratch(spark)).read()


@_query("SELECT max(c_custkey) AS top, count(*) AS n, CAST(round(sum(c_acctbal), 2) AS DOUBLE) AS total FROM customer WHERE c_custkey % 2 = 0")
def table_vacuum(spark, sf):
    table = _table(spark, t(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    table.delete_where(F.col("c_custkey") % 2 == 1)
    return table.vacuum().read().agg(F.max("c_custkey").alias("top"), F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@_query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def fragment_roundtrip(spark, sf):
    path = _scratch(spark)
    sinks.export_arc({x: t(spark, sf, x) for x in ("nation", "region")}, path)
    found = sinks.open_arc(spark, path)
    return found["nation"].join(found["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@_query("SELECT o_custkey, count(*) AS n, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total FROM orders GROUP BY o_custkey")
def fold_sorted(spark, sf):
    path = _scratch(spark)
    sinks.fold(t(spark, sf, "orders"), path, "o_custkey")
    return spark.read.parquet(path).groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@_query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS missing, CAST(1 AS BIGINT) AS changed FROM customer")
def chunk_check(spark, sf):
    path = _scratch(spark)
    manifest = sinks.write_chunks(t(spark, sf, "customer"), path, 500).orderBy("file")
    first = manifest.first()["file"]
    forged = manifest.withColumn("sha256", F.when(F.col("file") == first, F.reverse("sha256")).otherwise(F.col("sha256")))
    n = lambda kind: F.count(F.when(F.col("problem") == kind, 1)).alias(kind)
    bad = sinks.check_chunks(spark, path, forged).agg(n("missing"), n("changed"))
    return spark.read.parquet(path).agg(F.count("*").alias("n")).crossJoin(bad)  # one row each


# sources ------------------------------------------------------------------------------------------------------------
@_query("SELECT p_partkey, p_retailprice, p_name || chr(10) || '\"' || p_type || '\", ' AS label FROM part")
def csv_types(spark, sf):
    """Integers, reals and texts with quotes and line ends through a file."""
    path = _scratch(spark)
    rows = t(spark, sf, "part").select("p_partkey", "p_retailprice", F.concat("p_name", F.lit('\n"'), "p_type", F.lit('", ')).alias("label"))
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreTrailingWhiteSpace", False).csv(path)
    out = readers.read_csv(spark, path)
    return out.select(F.col("p_partkey").cast(rows.schema["p_partkey"].dataType).alias("p_partkey"), "p_retailprice", "label")


def _workbook(spark, sf) -> str:
    """A workbook of two sheets: the nations with a formula column, and their regions as inline texts."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rows = _nations(spark, sf)
    head = "".join(f'<c r="{c}1" t="inlineStr"><is><t>{n}</t></is></c>' for c, n in zip("ABC", ("n_nationkey", "n_name", "twice")))
    body = "".join(
        f'<row r="{k}"><c r="A{k}"><v>{r.n_nationkey}</v></c><c r="B{k}" t="s"><v>{k - 2}</v></c><c r="C{k}"><f>A{k}*2</f><v>{r.n_nationkey * 2}</v></c></row>' for k, r in enumerate(rows, 2)
    )
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="nations" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{escape(r.n_name)}</t></si>" for r in rows) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1">{head}</row>{body}</sheetData></worksheet>')
    return _put(spark, f"{_scratch(spark)}/nations.xlsx", buf.getvalue())


@_query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(2 * n_nationkey AS BIGINT) AS twice FROM nation")
def excel_sheet(spark, sf):
    return readers.read_sheet(spark, _workbook(spark, sf), "nations")


@_query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) + 1 AS INT) AS row, 'A' || CAST(row_number() OVER (ORDER BY n_nationkey) + 1 AS VARCHAR) AS reference FROM nation")
def excel_references(spark, sf):
    return readers.read_workbook(spark, _workbook(spark, sf), "cell_references").select("row", "reference")


def _plan(spark, sf) -> str:
    rows = _nations(spark, sf)
    tasks = "".join(f'<task id="{r.n_nationkey + 1}" name={quoteattr(r.n_name)} start="2024-01-30" duration="{r.n_regionkey + 1}" complete="{r.n_nationkey}"><depend id="{r.n_regionkey + 1}" type="2"/></task>' for r in rows)
    return _put(spark, f"{_scratch(spark)}/plan.gan", f"<project><tasks>{tasks}</tasks></project>".encode())


@_query("SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS name, strftime(DATE '2024-01-30' + CAST(n_regionkey + 1 AS INT), '%Y-%m-%d') AS end_date, CAST(n_nationkey AS INT) AS complete FROM nation")
def gantt_tasks(spark, sf):
    return readers.read_gantt(spark, _plan(spark, sf)).select("id", "name", "end_date", "complete")


@_query("SELECT CAST(n_nationkey + 1 AS BIGINT) AS from_task, CAST(n_regionkey + 1 AS BIGINT) AS to_task, 'FS' AS type FROM nation")
def gantt_dependencies(spark, sf):
    return readers.read_gantt(spark, _plan(spark, sf), "dependencies").select("from_task", "to_task", "type")


@_query("SELECT n_name AS text, 2 AS depth, 'region ' || n_regionkey AS parent FROM nation UNION ALL SELECT DISTINCT 'region ' || n_regionkey, 1, 'all' FROM nation")
def mind_map_edges(spark, sf):
    rows = _nations(spark, sf)
    parts = "".join(f'<node TEXT="region {k}">' + "".join(f"<node TEXT={quoteattr(r.n_name)}/>" for r in rows if r.n_regionkey == k) + "</node>" for k in sorted({r.n_regionkey for r in rows}))
    path = _put(spark, f"{_scratch(spark)}/map.mm", f'<map><node TEXT="all">{parts}</node></map>'.encode())
    nodes, edges = readers.read_mind_map(spark, path), readers.read_mind_map(spark, path, "edges")
    above = nodes.select(F.col("id").alias("parent_id"), F.col("text").alias("parent"))
    return nodes.join(edges.select("parent_id", F.col("child_id").alias("id")), "id").join(above, "parent_id").select("text", "depth", "parent")


def _commits(spark, sf) -> DataFrame:
    o = t(spark, sf, "orders")
    sha = F.md5(F.col("o_orderkey").cast("string"))
    return o.select(F.concat_ws("|", sha, F.concat(F.lit("c"), F.col("o_custkey") % 50), F.concat(F.col("o_custkey") % 50, F.lit("@x")), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("a|b")).alias("value"))


@_query("SELECT CAST(o_custkey % 50 AS VARCHAR) || '@x' AS email, 'c' || (o_custkey % 50) AS name, count(*) AS commits, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last FROM orders GROUP BY 1, 2")
def commit_authors(spark, sf):
    noise = spark.createDataFrame([("not a commit",)], "value string")
    return readers.authors(readers.parse_commits(_commits(spark, sf).unionByName(noise)))


@_query("SELECT 'f' || (l_partkey % 20) AS path, sum(CAST(l_quantity AS BIGINT)) AS added, count(*) FILTER (l_linenumber <> 3) AS text_changes FROM lineitem GROUP BY 1")
def commit_file_changes(spark, sf):
    li = t(spark, sf, "lineitem")
    lines = li.select(F.concat_ws("\t", F.md5(F.col("l_orderkey").cast("string")), F.col("l_quantity").cast("long"), F.when(F.col("l_linenumber") == 3, "-").otherwise("1"), F.concat(F.lit("f"), F.col("l_partkey") % 20)).alias("value"))
    return readers.parse_file_changes(lines).groupBy("path").agg(F.sum(F.col("added").cast("long")).alias("added"), F.count("deleted").alias("text_changes"))


@_query("SELECT c_custkey, CASE WHEN c_nationkey % 3 < 2 THEN c_name END AS plain FROM customer")
def row_decrypt(spark, sf):
    """Rows sealed with the key of their tag; the caller may read two of three tags."""
    master = b"m" * 32
    rows = t(spark, sf, "customer").select("c_custkey", "c_name", F.concat(F.lit("t"), F.col("c_nationkey") % 3).alias("tag"))
    sealed = F.lit(None).cast("binary")
    for tag in ("t0", "t1", "t2"):
        sealed = F.when(F.col("tag") == tag, readers.encrypt(F.col("c_name"), scalars.hkdf_sha256(master, tag.encode()))).otherwise(sealed)
    return readers.decrypt_rows(rows.withColumn("v", sealed), "v", "tag", master, ["t0", "t1"]).select("c_custkey", "plain")


@_query("SELECT n_nationkey * 2 AS k, n_name FROM nation WHERE n_nationkey > 4")
def memory_table(spark, sf):
    """A frame made in the program, queried by name."""
    e = Engine(spark).register("made", t(spark, sf, "nation").select((F.col("n_nationkey") * 2).alias("k"), "n_name"), "k")
    return e.sql("SELECT k, n_name FROM made WHERE k > $k", {"k": 8})


# prepared forms -----------------------------------------------------------------------------------------------------
@_query(_bfs(20000003, 2))
def graph_prepared_traversal(spark, sf):
    return graph_of(spark, sf).prepare_traversal(Policy(max_depth=2))(20000003)


@_query(_bfs(20000005, 1, "e.kind = 10"))
def graph_prepared_pattern(spark, sf):
    return cypher.PreparedPattern(graph_of(spark, sf), "MATCH (a) |> [r:CONTAINS] |> (b) WHERE a.key = $start RETURN b").execute(start=20000005)


@_query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) GROUP BY c_nationkey")
def agent_steps(spark, sf):
    """Steps that use one another's results."""
    e = Engine(spark).register_dir(sf, ["customer"])
    mean = e.prepare("SELECT AVG(c_acctbal) AS a FROM customer")
    rich = e.prepare("SELECT c_nationkey FROM customer WHERE c_acctbal > $a")
    agent = Agent().step("mean", lambda _: mean.execute().first()["a"]).step("rich", lambda done: rich.execute({"a": done["mean"]}))
    return agent.step("n", lambda done: done["rich"].groupBy("c_nationkey").agg(F.count("*").alias("n"))).execute()["n"]


@_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
def builder_prepared(spark, sf):
    q = Engine(spark).register_dir(sf, ["orders"]).table("orders").where(f.col("o_totalprice").gt(200000)).where(f.col("o_orderstatus").eq("F")).select("o_orderkey", "o_totalprice")
    return q.to_prepared()()


# vectors ------------------------------------------------------------------------------------------------------------
@_query(f"SELECT h.vec_id, round(h.d, 6) AS distance, d.lang FROM (SELECT vec_id, list_cosine_distance({_V}, {_VQ}) AS d FROM embeddings e ORDER BY d, vec_id LIMIT 10) h JOIN documents d ON d.doc_id = h.vec_id")
def vec_enriched(spark, sf):
    search, q = _search(spark, sf)
    source = t(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    return _rounded(search.enrich(search.nearest(q, 10), source))


@_query("SELECT vec_id FROM embeddings WHERE vec_id >= 20 OR vec_id IN (3, 4) UNION ALL SELECT -1")
def vec_index_changes(spark, sf):
    """Rows of an index after deletions and replacements."""
    rows = t(spark, sf, "embeddings").select("vec_id", "embedding")
    one = rows.filter("vec_id = 30")
    new = rows.filter("vec_id in (3, 4, 25)").unionByName(one.withColumn("vec_id", F.lit(-1).cast(rows.schema["vec_id"].dataType)))
    return vector.InvertedFile.build(rows, "vec_id", "embedding").delete(F.col("vec_id") < 20).upsert(new).cells.select("vec_id")


def _batch(metric: str, order: str, distance: str) -> str:
    return f"SELECT q.vec_id AS query, e.vec_id AS key, round({distance}, 4) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY {order}, e.vec_id) AS rank FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q, embeddings e QUALIFY rank <= 3"


_E, _Q = "CAST(e.embedding AS DOUBLE[])", "CAST(q.embedding AS DOUBLE[])"


@_query(_batch("euclidean", f"list_distance({_E}, {_Q})", f"list_distance({_E}, {_Q})"))
def vec_batch_l2(spark, sf):
    df = t(spark, sf, "embeddings")
    found = vector.batch_nearest(df.filter("vec_id % 50 = 0"), df, "vec_id", "embedding", 3, vector.EUCLIDEAN)
    return found.select("query", "key", F.round("distance", 4).alias("distance"), F.col("rank").cast("long").alias("rank"))


@_query(_batch("dot", f"list_inner_product({_E}, {_Q}) DESC", f"list_inner_product({_E}, {_Q})"))
def vec_batch_dot(spark, sf):
    df = t(spark, sf, "embeddings")
    found = vector.batch_nearest(df.filter("vec_id % 50 = 0"), df, "vec_id", "embedding", 3, vector.DOT)
    return found.select("query", "key", F.round("distance", 4).alias("distance"), F.col("rank").cast("long").alias("rank"))


# trust, tools, time -------------------------------------------------------------------------------------------------
@_query("""SELECT o_orderkey AS seq, reason IS NULL AS allowed, reason FROM (SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN 'unknown agent' WHEN o_orderkey % 13 = 0 THEN 'outside the key''s validity'
  WHEN o_totalprice > 150000 THEN 'over the authority ceiling' WHEN o_custkey % 5 = 0 AND NOT (o_orderkey % 2 = 0 AND 1 % 11 <> 0 AND o_custkey <> 1) THEN 'co-signature missing' END AS reason FROM orders)""")
def ledger_authorisation(spark, sf):
    o = t(spark, sf, "orders")
    day = F.when(F.col("o_orderkey") % 13 == 0, F.lit(99)).otherwise(F.lit(5))
    entries = o.select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("agent_id"), day.alias("ts"), F.col("o_totalprice").alias("value"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit(1).cast(o.schema["o_custkey"].dataType), F.lit(11).cast(o.schema["o_custkey"].dataType))).otherwise(F.array().cast(f"array<{o.schema['o_custkey'].dataType.simpleString()}>")).alias("cosigners"))
    agents = t(spark, sf, "customer").filter("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("agent_id"), F.lit(0).alias("valid_from"), F.lit(10).alias("valid_to"), F.lit(150000.0).alias("ceiling"), F.when(F.col("c_custkey") % 5 == 0, 1).otherwise(0).alias("needs_cosign"))
    return trust.may_append(entries, agents).select("seq", "allowed", "reason")


@_query(f"SELECT seq, sha256(payload) AS payload_hash FROM {_LEDGER}")
def fragment_sync(spark, sf):
    """A ledger behind another one, brought up to date."""
    whole = _ledger(spark, sf).select("seq", "payload", "payload_hash", "prev_hash")
    return trust.import_deltas(whole.filter("seq <= 50"), trust.export_deltas(whole, 31)).select("seq", "payload_hash")


@_query("SELECT CAST(50 AS BIGINT) AS common, CAST(0 AS BIGINT) AS local_ahead, count(*) - 50 AS remote_ahead, TRUE AS compatible FROM events")
def sync_preflight(spark, sf):
    whole = _ledger(spark, sf)
    return trust.sync_preflight(whole.filter("seq <= 50"), whole)


@_query("WITH f AS (SELECT p_name || '/' || p_partkey AS path, greatest(1, length(p_type) // 4) AS tokens, CAST(contains(lower(p_name), 'a') AS INT) + CAST(contains(lower(p_name), 're') AS INT) AS m FROM part), r AS (SELECT *, sum(tokens) OVER (ORDER BY path) AS run FROM f WHERE m > 0) SELECT path, m / 2.0 AS confidence, CAST(tokens AS BIGINT) AS tokens FROM r WHERE run <= 200")
def files_ranked(spark, sf):
    files = t(spark, sf, "part").select(F.concat_ws("/", F.col("p_name"), "p_partkey").alias("path"), F.col("p_type").alias("content"))
    return analysis.rank_files(files, "a re", 200).withColumn("tokens", F.col("tokens").cast("long"))


@_query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'")
def records_where(spark, sf):
    return tools.where_equal(t(spark, sf, "customer"), c_nationkey=3, c_mktsegment="BUILDING", c_name=None).select("c_custkey")


@_query("SELECT s_suppkey AS path, 'N' || s_nationkey || '.Core' AS namespace FROM supplier UNION ALL SELECT s_suppkey, 'System' FROM supplier")
def source_directives(spark, sf):
    files = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("path"), F.concat(F.lit("using System;\n  using static N"), "s_nationkey", F.lit(".Core;\nusing System;\nclass X { }")).alias("content"))
    return tools.using_directives(files)


@_query("SELECT s_suppkey AS path, 'src/f' || s_nationkey || '.py' AS reference FROM supplier UNION ALL SELECT s_suppkey, 'README.md' FROM supplier")
def source_references(spark, sf):
    files = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("path"), F.concat(F.lit("see src/f"), "s_nationkey", F.lit(".py and README.md, not a.exe")).alias("content"))
    return tools.file_references(files)


@_query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_rows(spark, sf):
    return diff.latest_by(t(spark, sf, "events"), "user_id", "event_id").select("user_id", "event_id")


@_query("SELECT event_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS delta FROM events")
def date_delta(spark, sf):
    return t(spark, sf, "events").select("event_id", scalars.timestamp_delta(F.col("ts")).alias("delta"))


@_query("SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 DAY, ts), time_bucket(INTERVAL 1 DAY, ts) - INTERVAL 1 DAY]) AS w FROM events) GROUP BY ALL")
def sliding_counts(spark, sf):
    return changes.sliding(t(spark, sf, "events"), "ts", "2 days", "1 day", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@_query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 5")
def window_alerts(spark, sf):
    return changes.velocity_alerts(t(spark, sf, "events"), "event_type", "ts", "1 day", 5).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))

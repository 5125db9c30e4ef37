"""Unit tests of dialect, joins, graph, trust, analysis, sources, sinks and streaming."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.functions import filters as f
from lodestone.functions import scalars
from lodestone.functions.dialect import rewrite
from lodestone.operators import analysis, cypher, diff, trust, vector
from lodestone.operators.engine import AccessDenied, Agent, Engine, Extensions, Scopes
from lodestone.operators.graph import Graph, GraphWriter, Policy, met_path
from lodestone.sources import readers, sinks
from lodestone.streaming import changes


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# dialect ------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "text, expected",
    [
        ("SELECT a FROM t ORDER BY a", "SELECT a FROM t ORDER BY a NULLS LAST"),
        ("SELECT a FROM t ORDER BY a DESC, b ASC NULLS FIRST LIMIT 3", "SELECT a FROM t ORDER BY a DESC NULLS FIRST , b ASC NULLS FIRST LIMIT 3"),
        ("SELECT [a b] FROM t |a SELECT x FROM s", "SELECT `a b` FROM t UNION ALL SELECT x FROM s"),
        ("SELECT TOP 3 a FROM t WHERE b = @p", "SELECT a FROM t WHERE b = :p LIMIT 3"),
        ("SELECT DISTINCT TOP (3) a FROM t", "SELECT DISTINCT a FROM t LIMIT 3"),
        ("SELECT N'x' FROM t WITH (NOLOCK) OFFSET 1 ROWS FETCH NEXT 2 ROWS ONLY", "SELECT 'x' FROM t LIMIT 2 OFFSET 1"),
        ("SELECT 'a -- [b] $c |u' FROM t", "SELECT 'a -- [b] $c |u' FROM t"),
        ("SELECT a FROM (SELECT TOP 2 a FROM t) x ORDER BY a", "SELECT a FROM ( SELECT a FROM t LIMIT 2 ) x ORDER BY a NULLS LAST"),
    ],
)
def test_rewrite(text, expected):
    assert rewrite(text).sql == expected


def test_hints_and_quotes():
    assert rewrite("CACHED SELECT 1").hint == "CACHED"
    assert rewrite("/* JIT */ SELECT 1") == rewrite("JIT SELECT 1")
    assert rewrite("SELECT 'it''s'").sql == r"SELECT 'it\'s'"
    with pytest.raises(ValueError):
        rewrite("SELECT * FROM t:5")


def test_order_nulls_end_to_end(spark):
    e = Engine(spark).register("v", spark.createDataFrame([(1,), (None,), (2,)], "x int"))
    assert [r.x for r in e.sql("SELECT x FROM v ORDER BY x").collect()] == [1, 2, None]
    assert [r.x for r in e.sql("SELECT x FROM v ORDER BY x DESC").collect()] == [None, 2, 1]


# joins: unique, partial, duplicate keys, NULL keys, empty, self, disjoint, swapped ----------------------------------
CASES = {
    "unique": ([(1, "a"), (2, "b")], [(1, "x"), (2, "y")]),
    "partial": ([(1, "a"), (2, "b")], [(2, "y"), (3, "z")]),
    "duplicates_left": ([(1, "a"), (1, "b")], [(1, "x")]),
    "duplicates_right": ([(1, "a")], [(1, "x"), (1, "y")]),
    "duplicates_both": ([(1, "a"), (1, "b")], [(1, "x"), (1, "y")]),
    "null_keys": ([(None, "a"), (1, "b")], [(None, "x"), (1, "y")]),
    "empty_left": ([], [(1, "x")]),
    "empty_right": ([(1, "a")], []),
    "disjoint": ([(1, "a")], [(2, "x")]),
    "same": ([(1, "a"), (2, "b")], [(1, "a"), (2, "b")]),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("kind", ["INNER", "LEFT", "RIGHT", "FULL OUTER"])
def test_join_matrix(spark, case, kind):
    left, right = CASES[case]
    e = Engine(spark).register("l", spark.createDataFrame(left, "k int, a string")).register("r", spark.createDataFrame(right, "k int, b string"))
    found = rows(e.sql(f"SELECT l.k AS lk, a, r.k AS rk, b FROM l {kind} JOIN r ON l.k = r.k"))
    pairs = [(k, a, j, b) for k, a in left for j, b in right if k is not None and k == j]
    lonely = lambda side, other: [x for x in side if not any(x[0] is not None and x[0] == y[0] for y in other)]
    if kind in ("LEFT", "FULL OUTER"):
        pairs += [(*x, None, None) for x in lonely(left, right)]
    if kind in ("RIGHT", "FULL OUTER"):
        pairs += [(None, None, *x) for x in lonely(right, left)]
    assert found == sorted(pairs, key=str)


# filters and entitlements -------------------------------------------------------------------------------------------
def test_filters_are_three_valued(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    assert rows(df.filter(f.negate(f.col("x").eq(1)))) == [(3,)]
    assert rows(df.filter(f.col("x").not_in(1))) == [(3,)]
    assert rows(df.filter(f.col("x").is_null())) == [(None,)]


def test_scopes_and_agents(spark):
    assert Scopes(("t.a", "p*.b")).columns("t", ["A", "b"]) == ["A"]
    assert Scopes(("p*.b",)).columns("pre", ["a", "b"]) == ["b"]
    assert Scopes(("*",)).columns("x", ["a"]) == ["a"]
    e = Engine(spark).register("pay", spark.createDataFrame([(1, 2)], "id int, amount int")).register("hid", spark.createDataFrame([(1,)], "id int"))
    agent = e.as_agent(["pay.id"])
    assert rows(agent.sql("SELECT * FROM pay")) == [(1,)]
    for text in ("SELECT amount FROM pay", "SELECT * FROM hid"):
        with pytest.raises(AccessDenied):
            agent.sql(text)


def test_agent_steps_and_extensions():
    done = Agent().step("a", lambda d: 1).step("b", lambda d: d["a"] + 1).execute()
    assert done == {"a": 1, "b": 2}
    x = Extensions()
    x.register("e", 1)
    assert x.names() == ["e"] and x.get("none") is None


# scalars ------------------------------------------------------------------------------------------------------------
def test_cbor_and_keys(spark):
    raw = bytes.fromhex("a36161016162820203616363666f6f")
    assert scalars.decode_cbor(raw) == {"a": 1, "b": [2, 3], "c": "foo"}
    assert scalars.decode_cbor(bytes.fromhex("f93c00")) == 1.0
    assert scalars.decode_cbor(bytes.fromhex("9f0102ff")) == [1, 2]
    df = spark.createDataFrame([(bytearray(raw),), (None,), (bytearray(b"\xff"),)], "d binary")
    assert rows(df.select(scalars.cbor_field(F.col("d"), "c"))) == [("foo",), (None,), (None,)]
    okm = scalars.hkdf_sha256(bytes([11] * 22), bytes.fromhex("f0f1f2f3f4f5f6f7f8f9"), bytes(range(13)), 42)
    assert okm.hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"


def test_guid_negative_halves(spark):
    df = spark.createDataFrame([(-1, -(2**63))], "h long, l long").select("h", "l", scalars.guid_from_halves(F.col("h"), F.col("l")).alias("g"))
    h, low = scalars.guid_halves(F.col("g"))
    assert rows(df.select("g", h, low)) == [("ffffffff-ffff-ffff-8000-000000000000", -1, -(2**63))]


# graph --------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def diamond(spark):
    nodes = spark.createDataFrame([(k, k, 1 + k % 2, f"data {k}") for k in range(1, 7)], "key long, id long, kind int, data string")
    edges = [(1, 1, 2), (2, 1, 3), (3, 2, 4), (4, 3, 4), (5, 4, 5), (6, 5, 6), (7, 6, 99)]
    return Graph(nodes, spark.createDataFrame([(i, a, b, 10, 1.0) for i, a, b in edges], "id long, source_key long, target_key long, kind int, weight double"))


def test_traverse(diamond):
    found = diamond.traverse(1, Policy(max_depth=2), include_paths=True)
    assert rows(found.select("key", "depth", "path")) == [(1, 0, [1]), (2, 1, [1, 2]), (3, 1, [1, 3]), (4, 2, [1, 2, 4])]
    assert rows(diamond.traverse(1, Policy(max_depth=5, stop_at=4)).select("key")) == [(1,), (2,), (3,), (4,)]
    assert rows(diamond.traverse(1, Policy(max_depth=1, max_fanout=1)).select("key")) == [(1,), (2,)]
    assert rows(diamond.traverse(6, Policy(max_depth=1)).select("key")) == [(6,)]  # 99 has no node


def test_long_path_is_whole(spark):
    forth, back = list(range(1500)), list(range(2999, 1498, -1))
    assert rows(spark.createDataFrame([(forth, back), ([7], [7])], "x array<long>, y array<long>").select(met_path(F.col("x"), F.col("y")))) == [(list(range(3000)),), ([7],)]


def test_shortest_path_and_patterns(diamond):
    assert rows(diamond.shortest_path(1, 6)) == [(0, 1), (1, 2), (2, 4), (3, 5), (4, 6)]
    assert rows(diamond.shortest_path(6, 1)) == []
    assert rows(diamond.shortest_path(1, 6, Policy(max_depth=3))) == []
    assert rows(diamond.shortest_path(3, 3)) == [(0, 3)]
    found = cypher.PreparedPattern(diamond, "MATCH (a) |> [r:CONTAINS*..2] |> (b) WHERE a.key = $x RETURN b").execute(x=4)
    assert rows(found.select("key")) == [(4,), (5,), (6,)]
    with pytest.raises(ValueError):
        cypher.parse("MATCH (a) |> [r:NOPE] |> (b) WHERE a.key = 1")


def test_page_rank_and_layers(diamond, spark):
    ranks = dict(rows(diamond.page_rank()))
    assert abs(sum(ranks.values()) - 1) < 1e-6 and ranks[4] > ranks[2]
    assert rows(diamond.topological_layers()) == [(1, 0), (2, 1), (3, 1), (4, 2), (5, 3), (6, 4)]
    loop = Graph(diamond.nodes, diamond.edges.unionByName(spark.createDataFrame([(9, 5, 1, 10, 1.0)], diamond.edges.schema)))
    with pytest.raises(ValueError):
        loop.topological_layers()


def test_graph_writer(diamond, spark):
    w = GraphWriter(diamond).intern(spark.createDataFrame([(1, "other"), (7, "new")], "key long, data string"))
    assert rows(w.graph.nodes.filter("key in (1, 7)").select("key", "data")) == [(1, "data 1"), (7, "new")]
    w = w.remove(4)
    assert w.graph.edges.count() == 4 and w.history.count() == 3


# vectors ------------------------------------------------------------------------------------------------------------
def test_vector_dimension_and_index_recall(spark, tmp_path):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    with pytest.raises(Exception, match="dimensions"):
        vector.VectorSearch(df, "vec_id", "embedding").nearest([1.0, 2.0], 3).collect()
    queries = df.filter("vec_id % 50 = 0")
    exact = {tuple(r) for r in vector.batch_nearest(queries, df, "vec_id", "embedding", 10).select("query", "key").collect()}
    index = vector.InvertedFile.build(df, "vec_id", "embedding", cells=16)
    assert index.cells.count() == df.count()
    found = {tuple(r) for r in index.search(queries, 10, probes=10).select("query", "key").collect()}
    assert len(exact & found) / len(exact) >= 0.9
    index = vector.InvertedFile.build(df, "vec_id", "embedding")
    assert len(index.centroids) > 16
    index.save(str(tmp_path / "index"))
    again = vector.InvertedFile.load(spark, str(tmp_path / "index"))
    assert again.probes == index.probes and again.merge(index).cells.count() == df.count()
    found = {tuple(r) for r in again.search(queries, 10).select("query", "key").collect()}
    assert len(exact & found) / len(exact) >= 0.9
    assert index.delete(F.col("vec_id") < 100).cells.count() == df.filter("vec_id >= 100").count()


# trust and analysis -------------------------------------------------------------------------------------------------
def test_ledger(spark):
    e = spark.createDataFrame([(k, f"p{k}") for k in range(1, 6)], "seq long, payload string")
    ledger = trust.chain(e)
    assert tuple(trust.verify(ledger).first()) == (5, True, None)
    more = trust.append(ledger.select("seq", "payload", "payload_hash", "prev_hash"), spark.createDataFrame([("x",), ("y",)], "payload string"), "payload")
    assert tuple(trust.verify(more).first()) == (7, True, None)
    assert trust.verify(more.filter("seq <> 3")).first()["valid"] is False
    assert trust.import_deltas(ledger.select(*more.columns), trust.export_deltas(more, 4)).count() == 7
    assert diff.ledger_diff(ledger, more).first()["common"] == 5


def test_may_append(spark):
    agents = spark.createDataFrame([("a", 0, 100, 10.0, 1), ("b", 0, 100, 10.0, 0)], "agent_id string, valid_from long, valid_to long, ceiling double, needs_cosign int")
    e = spark.createDataFrame([(1, "a", 5, 1.0, ["b"]), (2, "a", 5, 1.0, ["a"]), (3, "b", 200, 1.0, None), (4, "b", 5, 11.0, None), (5, "z", 5, 1.0, None)], "seq long, agent_id string, ts long, value double, cosigners array<string>")
    assert {r.seq: r.reason for r in trust.may_append(e, agents).collect()} == {1: None, 2: "co-signature missing", 3: "outside the key's validity", 4: "over the authority ceiling", 5: "unknown agent"}


def test_arc_validation(spark):
    ledger = trust.chain(spark.createDataFrame([(1, "p"), (2, "q")], "seq long, payload string"))
    agents = spark.createDataFrame([("a", "k"), ("b", "k")], "agent_id string, public_key string")
    anchors = spark.createDataFrame([("a", "k"), ("a", "k"), ("b", "other")], "agent_id string, public_key string")
    seen = lambda x: {tuple(r) for r in diff.validate(x, agents, anchors).collect()}
    assert seen(ledger) == {("a", True, True), ("b", False, True)}
    assert seen(ledger.withColumn("payload", F.lit("forged"))) == {("a", True, False), ("b", False, False)}


def test_fnv_and_crc(spark):
    texts = ["", "a", "foobar", "späte \U0001f600" * 9, None]

    def plain(text):
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", scalars.fnv1a64(F.col("x")).alias("h"), scalars.crc32(F.col("x")).alias("c"))
    for r in df.collect():
        assert r.h is None if r.x is None else r.h % 2**64 == plain(r.x)
        assert r.c is None if r.x is None else r.c == zlib.crc32(r.x.encode())


def test_registry_and_audit_log(spark):
    shape = "agent_id string, public_key binary, valid_from long, valid_to long, signature string, at long"
    of = lambda name, a, b, at: (name, bytearray(b"k"), a, b, trust.sign(b"k", name, f"{a}:{b}", 0), at)
    none = spark.createDataFrame([], shape)
    forged = ("c", bytearray(b"k"), 0, 9, trust.sign(b"other", "c", "0:9", 0), 3)
    agents = trust.register(none, spark.createDataFrame([of("a", 0, 5, 1), of("b", 0, 9, 2), forged, ("d", None, 0, 1, None, 4)], shape))
    agents = trust.register(agents, spark.createDataFrame([of("a", 6, 9, 1)], shape))
    assert sorted(r.agent_id for r in agents.collect()) == ["a", "a", "b"]
    assert trust.agent_of(agents, "a").first().valid_to == 9 and trust.agent_of(agents, "c").first() is None
    log = spark.createDataFrame([], trust.AUDIT)
    events = lambda *rows: spark.createDataFrame(list(rows), "ts long, kind int, agent_id string, details string")
    log = trust.audit_append(log, events((2, 1, "b", "späte"), (1, 0, "a", None)))
    log = trust.audit_append(log, events((3, 2, None, "x"))).cache()
    assert [r.event_id for r in log.orderBy("ts").collect()] == [1, 2, 3]
    assert tuple(trust.audit_verify(log).first()) == (3, True, None)
    assert tuple(trust.audit_verify(log.withColumn("details", F.when(F.col("event_id") == 2, "forged").otherwise(F.col("details")))).first()) == (3, False, 2)
    assert trust.audit_verify(log.filter("event_id <> 2")).first().first_bad == 3


def test_reputation_is_the_same_step_by_step(spark):
    obs = [("a", 0, True), ("a", trust.HALF_LIFE, False), ("a", 3 * trust.HALF_LIFE, True)]
    a, b, last = 1.0, 1.0, None
    for _, t, good in obs:
        fade = 0.5 ** ((t - last) / trust.HALF_LIFE) if last is not None else 1
        a, b, last = 1 + (a - 1) * fade + good, 1 + (b - 1) * fade + (not good), t
    r = trust.reputation(spark.createDataFrame(obs, "g string, t long, s boolean"), "g", "t", F.col("s")).first()
    assert abs(r.alpha - a) < 1e-9 and abs(r.beta - b) < 1e-9 and r.ratings == 3


def test_signatures(spark):
    good = trust.sign(b"k", "p", "d", 1)
    df = spark.createDataFrame([(bytearray(b"k"), "p", "d", 1, good), (bytearray(b"k"), "p", "d", 2, good)], "k binary, p string, d string, n long, s string")
    assert [r[0] for r in df.select(trust.signature_ok("k", "p", "d", "n", "s")).collect()] == [True, False]


def test_spikes_and_ping_pong(spark):
    e = spark.createDataFrame([("a", k * 1_000_000) for k in range(6)] + [("b", 0)], "g string, t long")
    assert rows(analysis.velocity_spikes(e, "g", "t", 2, 2)) == [("a", 0, 3), ("a", 3_000_000, 3)]
    seq = "xababababyzz"
    ledger = spark.createDataFrame(list(enumerate(seq, 1)), "seq long, agent string")
    assert rows(analysis.ping_pong(ledger, "seq", "agent")) == [(2, "a", "b", 4)]


# sources ------------------------------------------------------------------------------------------------------------
def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,name,score\n1,"a ""q"", b",1.5\n2,,x\n3\n')
    assert readers.csv_schema("id;v\n1;2.5\n", ";") == [("id", "bigint"), ("v", "double")]
    df = readers.read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "score": "string"}
    assert rows(df) == [(1, 'a "q", b', "1.5"), (2, None, "x"), (3, None, None)]
    assert readers.sheet_csv_url("https://docs.google.com/spreadsheets/d/AbC/edit#gid=7").endswith("AbC/export?format=csv&gid=7")


def test_csv_loses_no_value(spark, tmp_path):
    """A value that fits no number after many that do, quoted line ends in the header and in cells, a folder of files."""
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.csv").write_text('id,"two\nlines",n\n' + "".join(f'{k},"x\ny",{k}\n' for k in range(300)) + "x7,,2.5\n")
    (tmp_path / "a" / "2.csv").write_text('id,"two\nlines",n\n  999 ,z, 4 \n')
    df = readers.read_csv(spark, str(tmp_path / "a"))
    assert dict(df.dtypes) == {"id": "string", "two\nlines": "string", "n": "double"} and df.count() == 302
    assert df.filter("id = 'x7'").first()["n"] == 2.5 and df.filter("trim(id) = '999'").first()["n"] == 4.0
    assert df.filter("n = 7").first()["two\nlines"] == "x\ny"


def test_workbook(spark, tmp_path):
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets><definedNames><definedName name="N">One!$A$1</definedName></definedNames></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>id</t></si><si><t>v</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>1</v></c><c r="B2"><f>A2*2.5</f><v>2.5</v></c></row></sheetData><mergeCells><mergeCell ref="A3:B3"/></mergeCells></worksheet>')
    (tmp_path / "w.xlsx").write_bytes(buf.getvalue())
    path = str(tmp_path / "w.xlsx")
    assert rows(readers.read_sheet(spark, path)) == [(1, 2.5)]
    assert rows(readers.read_workbook(spark, path, "cell_references").drop("file")) == [("One", 2, 2, "A2")]
    assert rows(readers.read_workbook(spark, path, "merged_regions").drop("file")) == [("One", "A3:B3")]
    assert rows(readers.read_workbook(spark, path, "defined_names").drop("file")) == [("N", "One!$A$1")]


def test_plans_and_maps(spark, tmp_path):
    (tmp_path / "p.gan").write_text('<project><tasks><task id="1" name="A" start="2024-01-01" duration="2" complete="50"><depend id="2" type="2"/><task id="3" name="C" start="2024-01-01" duration="1"/></task><task id="2" name="B" start="2024-01-03" duration="1"/></tasks></project>')
    tasks = rows(readers.read_gantt(spark, str(tmp_path / "p.gan")).drop("file"))
    assert (1, "A", "2024-01-01", "2024-01-03", 2, 50, None) in tasks and (3, "C", "2024-01-01", "2024-01-02", 1, 0, 1) in tasks
    assert rows(readers.read_gantt(spark, str(tmp_path / "p.gan"), "dependencies").drop("file")) == [(1, 2, "FS")]
    (tmp_path / "m.mm").write_text('<map><node TEXT="root"><node TEXT="a"/><node TEXT="b"><node TEXT="c"/></node></node></map>')
    assert rows(readers.read_mind_map(spark, str(tmp_path / "m.mm"), "edges").drop("file")) == [(1, 2, "child"), (1, 3, "child"), (3, 4, "child")]


def test_commit_log(spark):
    lines = spark.createDataFrame([("abc1234|Ann|a@x|2024-01-01|first",), ("noise",), ("abc1235|Ann|a@x|2024-01-02|a|b",)], "value string")
    commits = readers.parse_commits(lines)
    assert rows(commits.select("sha", "subject")) == [("abc1234", "first"), ("abc1235", "a|b")]
    assert rows(readers.authors(commits)) == [("a@x", "Ann", 2, "2024-01-01", "2024-01-02")]


def test_row_keys(spark):
    master = b"m" * 32
    key = scalars.hkdf_sha256(master, b"t1")
    df = spark.createDataFrame([("t1", "v"), ("t2", "w")], "tag string, v string").withColumn("v", readers.encrypt(F.col("v"), key))
    assert rows(readers.decrypt_rows(df, "v", "tag", master, ["t1"]).select("tag", "plain")) == [("t1", "v"), ("t2", None)]


# sinks --------------------------------------------------------------------------------------------------------------
def test_mutable_table(spark, tmp_path):
    t = sinks.MutableTable(spark, str(tmp_path / "t"), "id").create("id long, v string")
    heard = []
    t.observers.append(lambda kind, _: heard.append(kind))
    new = lambda *r: spark.createDataFrame(list(r), "id long, v string")
    t.insert(new((1, "a"), (2, "b"))).upsert(new((2, "B"), (3, "c"))).update(new((1, "A"), (9, "z")))
    assert rows(t.read()) == [(1, "A"), (2, "B"), (3, "c")]
    assert t.delete_where(F.col("v") == "c") == 1 and t.max_key() == 2 and t.row_count() == 2
    with pytest.raises(RuntimeError), t.transaction() as tx:
        tx.insert(new((7, "x")))
        raise RuntimeError
    assert t.row_count() == 2 and heard == ["insert", "upsert", "update", "delete"]
    assert t.add_column("w", "int", 5).vacuum().read().columns == ["id", "v", "w"]
    with pytest.raises(FileExistsError):
        t.create("id long")


def test_chunks_and_arcs(spark, tmp_path):
    df = spark.range(10).toDF("id")
    manifest = sinks.write_chunks(df.coalesce(1), str(tmp_path / "c"), 4)
    assert manifest.count() == 3 and sinks.check_chunks(spark, str(tmp_path / "c"), manifest).count() == 0
    sinks.export_arc({"a": df}, str(tmp_path / "arc"))
    assert rows(sinks.open_arc(spark, str(tmp_path / "arc"))["a"]) == rows(df)
    assert sinks.parse_arc_uri("arc://local/x/y.arc#t/5") == {"authority": "local", "path": "x/y.arc", "table": "t", "row": "5"}


# streaming ----------------------------------------------------------------------------------------------------------
def test_change_bus_and_streams(spark, tmp_path):
    before = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    after = spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string")
    events = changes.change_rows(before, after, "id")
    assert rows(events.select("id", "kind")) == [(1, "delete"), (2, "update"), (3, "create")]
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    heard = []
    bus = changes.ChangeBus()
    bus.subscribe("update", lambda df: heard.extend(r.id for r in df.collect()))
    q = bus.attach(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert heard == [2]


def test_running_reputation(spark, tmp_path):
    obs = spark.createDataFrame([("a", 0, True), ("a", trust.HALF_LIFE, False)], "g string, t long, s boolean")
    obs.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = changes.running_reputation(spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in")), "g", "t", "s")
    q = stream.writeStream.outputMode("update").format("memory").queryName("rep").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    r = spark.sql("SELECT * FROM rep").first()
    assert (r.alpha, r.beta) == (1.5, 2.0)


def test_writers_that_meet(spark, tmp_path):
    """Of two changes to one state the second fails and leaves the first; an unfinished commit is no version."""
    t = sinks.MutableTable(spark, str(tmp_path / "t"), "id").create("id long, v string")
    new = lambda *r: spark.createDataFrame(list(r), "id long, v string")
    t.insert(new((1, "a"), (None, "n")))
    with pytest.raises(sinks.ConflictError), t.transaction() as tx:
        tx.insert(new((2, "b")))
        sinks.MutableTable(spark, t.path, "id").insert(new((3, "c")))
    assert rows(t.read().filter("id is not null")) == [(1, "a"), (3, "c")]
    assert t.delete(3).read().filter("id is null").count() == 1 and t.row_count() == 2  # a row without a key stays
    number = t._latest()[0]
    (tmp_path / "t" / "_commits" / f"{number + 1:020d}").touch()
    assert t.row_count() == 2 and t.insert(new((4, "d"))).row_count() == 3
    assert t.vacuum().row_count() == 3 and t.drop() and not t.drop()


def test_kept_results_follow_their_tables(spark):
    e = Engine(spark).register("kept_t", spark.range(3))
    assert e.sql("CACHED SELECT count(*) AS n FROM kept_t").first()[0] == 3
    e.register("kept_t", spark.range(9))
    assert e.sql("CACHED SELECT count(*) AS n FROM kept_t").first()[0] == 9
    one, true = (e.sql("CACHED SELECT $x AS x", {"x": x}) for x in (1, True))
    assert one.dtypes != true.dtypes

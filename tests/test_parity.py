"""Operators on small fixtures: parsing, imports, stores, matching, loops, runtime helpers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from graphloom import runtime
from graphloom.errors import CircuitOpenError, ConfigurationError, NotFoundError, UnsupportedLanguageError
from graphloom.functions import text as tx
from graphloom.operators import impact, ops, rewrite, risk, search, traverse
from graphloom.sources import parse, store

FILES = [
    ("r/app/a.py", "from b import Engine, run\nimport pkg\nLIMIT: int = 3\nclass Wheel:\n    pass\nclass Car(Wheel):\n    size = 1\n    def __init__(self, w: Wheel, e: 'Engine') -> None:\n        self.w = Wheel()\n        run()\n        w.turn()\n"),
    ("r/app/b.py", "import a\nclass Engine:\n    pass\ndef run():\n    return 1\n"),
    ("r/app/pkg/__init__.py", "x = 1\n"),
    ("r/lib/b.py", "import b\n"),
    ("r/app/C.java", "package p.q;\nimport r.D;\n/** A shop. */\npublic abstract class C {\n  private final D item = null;\n  /** Sells an item. */\n  public D sell(D d, int n) { return this.give(d); }\n}\nclass D { }\n"),
    ("r/app/t.ts", "import { Box, Lid as L } from './box';\nclass T {\n  private box: Box;\n  open(b: Box): void { b.lift(); }\n}\nclass Box { }\n"),
]


@pytest.fixture(scope="module")
def parsed(spark):
    return parse.parse_texts(spark.createDataFrame(FILES, "file_path string, content string")).cache()


def names(edges, elements):
    n = {r.id: r.name for r in elements.select("id", "name").collect()}
    return {(n.get(r.source_id, r.source_id), n.get(r.target_id, r.target_id)) for r in edges.collect()}


def test_elements(parsed):
    e = {(r.name, r.type): r for r in parsed.collect() if r.name}
    assert e["LIMIT", "variable"].return_type == "int" and e["size", "field"].parent == "Car"
    assert e["p.q", "namespace"].line_number == 1 and e["item", "field"].return_type == "D"
    assert e["C", "class"].is_abstract and e["C", "class"].docstring == "A shop."
    assert e["sell", "method"].docstring == "Sells an item." and e["sell", "method"].call_kinds == ["method_call"]
    assert e["__init__", "function"].call_kinds == ["function_call", "function_call", "method_call"]
    m = {r.file_path: r for r in parsed.collect() if r.type == "module"}
    assert m["r/app/a.py"].import_kinds == ["direct_import", "from_import"] and m["r/app/a.py"].items == ["Engine", "run"]
    assert m["r/app/t.ts"].items == ["Box", "Lid"] and all(r.tree_size > 1 for r in m.values())


def test_type_edges(parsed):
    e = parse.element_rows(parsed)
    assert names(parse.dependencies(e), e) == {("__init__", "Wheel"), ("sell", "D"), ("open", "Box")}
    assert names(parse.compositions(e), e) == {("Car", "Wheel"), ("C", "D"), ("T", "Box")}


def test_imports_usage_and_file_cycles(parsed):
    every = {(r.source_file, r.target_file) for r in parse.import_edges(parsed, itself=True).collect()}
    assert every == {("r/app/a.py", "r/app/b.py"), ("r/app/a.py", "r/app/pkg/__init__.py"), ("r/app/b.py", "r/app/a.py"), ("r/lib/b.py", "r/lib/b.py")}
    cycles = {tuple(r.cycle) for r in parse.file_cycles(parse.import_edges(parsed, itself=True)).collect()}
    assert cycles == {("r/app/a.py", "r/app/b.py", "r/app/a.py"), ("r/lib/b.py", "r/lib/b.py")}
    e = parse.element_rows(parsed)
    assert {("__init__", "run"), ("r/app/a.py", "Engine"), ("r/app/a.py", "run")} <= names(parse.cross_file_usage(e, parsed), e)
    s = {r.file_path: r for r in parse.project_summary(parsed).collect()}
    assert s["r/app/a.py"].class_count == 2 and s["r/app/a.py"].imports == 2


def test_unknown_language_is_an_error(spark):
    with pytest.raises(UnsupportedLanguageError):
        parse.parser_for("cobol")


NODES = [("g", "a", "A", "class"), ("g", "b", 'B<"', "method"), ("h", "c", None, "class")]
EDGES = [("g", "e1", "a", "b", "calls"), ("g", "e2", "b", "a", "calls")]


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame(NODES, "graph_id string, id string, label string, type string"), spark.createDataFrame(EDGES, "graph_id string, id string, source_id string, target_id string, type string")


def test_documents_round_trip(spark, graph, tmp_path):
    n, e = graph
    docs = {r.graph_id: json.loads(r.document) for r in store.graph_documents(n, e).collect()}
    assert docs["g"]["metadata"] == {"node_count": 2, "edge_count": 2} and docs["h"]["metadata"]["edge_count"] == 0
    store.write_graph_json(n, e, str(tmp_path / "j"))
    n2, e2 = store.read_graph_json(spark, str(tmp_path / "j" / "graph_id=g"), "g")
    assert sorted(r.id for r in n2.collect()) == ["a", "b"] and e2.count() == 2
    xml = [r.xml for r in store.graphml_rows(n, e).where("id = 'b'").collect()]
    assert xml == ['<node id="b"><data key="label">B&lt;&quot;</data><data key="type">method</data></node>']


def test_store_and_backups(spark, graph, tmp_path):
    n, e = graph
    s = store.GraphStore(spark, str(tmp_path / "s")).add(n.where("graph_id = 'g'"), e)
    s.add(n.where("graph_id = 'h'"), e.limit(0)).save()
    assert {(r.graph_id, r.nodes, r.relationships) for r in s.info().collect()} == {("g", 2, 2), ("h", 1, 0)}
    b = store.create_backup(spark, s.path, str(tmp_path / "b"), "daily", "1")
    store.delete_graph(spark, s.path, "g")
    assert s.graph("g")[0].count() == 0
    store.restore_backup(spark, b, s.path)
    assert s.graph("g")[0].count() == 2
    store.append_fragment(n.where("id = 'a'").withColumn("id", F.lit("z")), e.limit(0), s.path)
    assert s.graph("g")[0].count() == 3
    assert store.delete_backup(spark, b) and not store.delete_backup(spark, b)
    with pytest.raises(NotFoundError):
        store.restore_backup(spark, b, s.path)


def test_matching_by_parts_of_names(spark):
    q = spark.createDataFrame([(1, ["graphbuilder", "io", "x", ""]), (2, ["builder", "zz"]), (3, None)], "question_id int, keywords array<string>")
    n = spark.createDataFrame([("g", "1", "GraphBuilder"), ("g", "2", "graph"), ("g", "3", "FastIO"), ("g", "4", None), ("g", "5", ""), ("g", "6", "X")], "graph_id string, id string, name string")
    got = {(r.question_id, r.id, r.keyword): r.score for r in search.match_names(q, n).collect()}
    assert got == {(1, "1", "graphbuilder"): 1.0, (1, "2", "graphbuilder"): 0.6, (1, "3", "io"): 0.8, (1, "6", "x"): 1.0, (2, "1", "builder"): 0.8}


E = "graph_id string, id string, source_id string, target_id string, type string, strength double"


def test_shortest_paths_and_all_paths(spark):
    rows = [("g", "1", "a", "b", "calls", None), ("g", "2", "b", "d", "calls", 0.5), ("g", "3", "a", "c", "calls", 0.1), ("g", "4", "c", "d", "calls", 0.1), ("g", "5", "a", "d2", "calls", 1.0), ("g", "6", "d", "a", "calls", 1.0)]
    step, roots = traverse.steps(spark.createDataFrame(rows, E)), spark.createDataFrame([("g", "a")], "graph_id string, root string")
    got = {r.target: (r.length, r.total_weight, r.path) for r in traverse.shortest(step, roots).collect()}
    assert got["d"] == (2, 1.5, ["a", "b", "d"]) and got["a"] == (0, 0.0, ["a"]) and got["d2"][0] == 1
    assert "d" not in {r.target for r in traverse.shortest(step, roots, 2).collect()}
    goal = spark.createDataFrame([("g", "d")], "graph_id string, target string")
    assert [r.path for r in traverse.paths(step, roots, goal, 5, 1).collect()] == [["a", "c", "d"]]
    assert traverse.paths(step, roots, goal, 5).count() == 2 and traverse.paths(step, roots, goal, 2).count() == 0


def test_components_and_chains_of_long_paths(spark):
    order = list(range(1, 201))
    order = order[:1] + order[:0:-1]  # 1, 200, 199, ..., 2
    edges = spark.createDataFrame([("g", str(k), f"n{a:03}", f"n{b:03}", "calls", 1.0) for k, (a, b) in enumerate(zip(order, order[1:]))] + [("h", "x", "p", "q", "calls", 1.0)], E)
    nodes = spark.createDataFrame([("g", "alone")], "graph_id string, id string")
    got = {(r.graph_id, r.id): r.component for r in rewrite.components(nodes, edges).collect()}
    assert {c for (g, i), c in got.items() if g == "g" and i != "alone"} == {"n001"} and got["h", "q"] == "p" and got["g", "alone"] == "alone"
    assert [(r.head, r.tail, r.edges) for r in rewrite.linear_chains(edges.where("graph_id = 'g'")).collect()] == [("n001", "n002", 199)]
    ring = spark.createDataFrame([("g", str(k), f"r{k}", f"r{(k + 1) % 5}", "calls", 1.0) for k in range(5)], E)
    assert rewrite.linear_chains(ring).collect() == []


def test_impact_of_deletion_reaches_further(spark):
    edges = spark.createDataFrame([("g", str(k), f"n{k}", f"n{k + 1}", "inherits", 1.0) for k in range(6)], E)
    nodes = spark.createDataFrame([("g", f"n{k}", "class") for k in range(7)], "graph_id string, id string, type string")
    roots = spark.createDataFrame([("g", "n0")], "graph_id string, root string")
    reached = lambda change: impact.impact(nodes, edges, roots, 3, change=change).count()
    assert (reached("MODIFY"), reached("DELETE")) == (2, 3)
    with pytest.raises(ValueError):
        impact.impact(nodes, edges, roots, change="burn")


def test_smells_and_report(spark):
    edges = spark.createDataFrame([("g", "1", "a", "b", "imports", 1.0), ("g", "2", "b", "a", "imports", 1.0), ("g", "3", "a", "m", "defines", 1.0), ("g", "4", "a", "k", "defines", 1.0)], E)
    nodes = spark.createDataFrame([("g", "a", "class", 1), ("g", "b", "class", 1), ("g", "m", "method", 30), ("g", "k", "method", None)], "graph_id string, id string, type string, complexity int")
    got = {(r.smell, r.subject) for r in risk.architecture_smells(nodes, edges, max_methods=1).collect()}
    assert got == {("circular_dependency", "a,b,a"), ("god_class", "a")}
    el = spark.createDataFrame([("e1", 1, None, "md5(x)")], "id string, line_number int, docstring string, code string")
    rep = {(r.category, r.kind): r.findings for r in risk.enhanced_report(el, nodes, edges, max_methods=1).collect()}
    assert rep == {("security", "weak_crypto"): 1, ("architecture", "circular_dependency"): 1, ("architecture", "god_class"): 1, ("quality", "complex_functions"): 1}


def test_documents(spark):
    rows = [("k", "K", "class", "f.py", 1, "A <b> class. More.", None, None), ("m", "run", "method", "f.py", 3, None, ["a"], "K"), ("n", None, "function", None, None, None, None, None)]
    e = spark.createDataFrame(rows, "id string, name string, type string, file_path string, line_number int, docstring string, parameters array<string>, parent_id string").withColumn("return_type", F.lit(None).cast("string"))
    assert [r.document for r in tx.module_documents(e).collect()] == ["# f.py\n## Class K: A <b> class\n### run"]
    assert {r.id: r.document for r in tx.class_documents(e.withColumn("parent_id", F.lower("parent_id"))).collect()} == {"k": "# K\nA <b> class. More.\n- def run(a):"}
    html = spark.createDataFrame([("# T\n- **a** & `b<`",)], "t string").select(tx.to_html(F.col("t"))).first()[0]
    assert html == "<h1>T</h1>\n<li><b>a</b> &amp; <code>b&lt;</code></li>"


def test_alert_comparators_and_stale_keys(spark):
    x = spark.createDataFrame([(0, 1.0), (60, 1.0), (120, 9.0), (180, None)], "s int, v double").withColumn("ts", F.timestamp_seconds("s"))
    n = {c: ops.alerts(x, "ts", "v", 1.0, 60, comparator=c).count() for c in ops.COMPARE}
    assert n == {">": 0, ">=": 1, "<": 0, "<=": 1, "==": 1, "!=": 0}
    keys = spark.createDataFrame([("k1", "g", None), ("k2", "g", "a"), ("k3", "g", "b"), ("k4", "h", None)], "key string, graph_id string, node_id string")
    assert sorted(r.key for r in ops.stale_keys(keys, spark.createDataFrame([("g", "a")], "graph_id string, id string")).collect()) == ["k1", "k2"]


def test_runtime(spark):
    now = [0.0]
    b = runtime.CircuitBreaker(2, 10, lambda: now[0])

    def fail():
        raise OSError("no")

    for _ in range(2):
        with pytest.raises(OSError):
            b.call(fail)
    with pytest.raises(CircuitOpenError):
        b.call(lambda: 1)
    now[0] = 11
    assert b.state == "half_open" and b.call(lambda: 1) == 1 and b.state == "closed"
    cache = runtime.TableCache(lambda: now[0])
    cache.set("graph:g:1", spark.range(3), 5)
    assert cache.get("graph:g:1").count() == 3 and cache.get("none") is None and cache.statistics()["hit_rate"] == 0.5
    now[0] = 20
    assert cache.get("graph:g:1") is None and not cache.exists("graph:g:1")
    cache.set("graph:g:2", spark.range(1))
    assert cache.delete_matching("graph:g:*") == 1
    log = []
    assert runtime.handled("x", log, {OSError: lambda x: "saved"})(fail)() == "saved" and log[0]["kind"] == "OSError"
    with pytest.raises(OSError):
        runtime.handled("x")(fail)()
    assert runtime.Config.from_env({"GRAPHLOOM_MAX_DEPTH": "7"}).max_depth == 7
    with pytest.raises(ConfigurationError):
        runtime.Config.from_env({"GRAPHLOOM_MAX_DEPTH": "x"})
    assert runtime.catalogue(spark).where("kind = 'layouts'").count() == 4 and runtime.progress(spark) == []

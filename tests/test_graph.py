from __future__ import annotations

import random

import pytest

from graphloom.operators import build, impact as im, query as qu, rewrite as rw, traverse as tr
from graphloom.plans.rank import row_numbers
from pyspark.sql import functions as F

NODE = "graph_id string, id string, label string, type string, element_id string, name string, file_path string, line_number int, complexity int, visibility string, docstring string"
EDGE = "graph_id string, id string, source_id string, target_id string, type string, strength double, call_count int, context string, line_number int"


def nodes(spark, rows):
    return spark.createDataFrame([("g", i, lb, t, None, n, f, ln, c, "public", None) for i, lb, t, n, f, ln, c in rows], NODE)


def edges(spark, rows):
    return spark.createDataFrame([("g", i, a, b, t, s, c, None, None) for i, a, b, t, s, c in rows], EDGE)


@pytest.fixture(scope="module")
def f1(spark):
    n = nodes(spark, [(x, f"Class{x}", "class" if x != "F" else "method", f"Class{x}", f"{x}.py", 1, 1) for x in "ABCDEF"])
    e = edges(spark, [("AB", "A", "B", "calls", 0.8, None), ("BC", "B", "C", "calls", 0.7, None), ("CD", "C", "D", "calls", 0.6, None), ("AE", "A", "E", "depends", 0.9, None), ("ED", "E", "D", "calls", 0.5, None), ("DA", "D", "A", "depends", 0.4, None), ("AF", "A", "F", "contains", 1.0, None)])
    return n, e


def root(spark, x="A"):
    return spark.createDataFrame([("g", x)], "graph_id string, root string")


def test_shortest_and_all_paths(spark, f1):
    _, e = f1
    way = {r.id: r for r in tr.reach(tr.steps(e), root(spark), 9).collect()}
    assert way["D"].path == ["A", "E", "D"] and way["D"].distance == 2 and way["A"].distance == 0
    only = {r.id: r.path for r in tr.reach(tr.steps(e, "out", ["calls"]), root(spark), 9).collect()}
    assert only["D"] == ["A", "B", "C", "D"]
    goal = spark.createDataFrame([("g", "D")], "graph_id string, target string")
    found = {(tuple(r.path), r.length, r.total_weight) for r in tr.paths(tr.steps(e), root(spark), goal, 5).collect()}
    assert found == {(("A", "E", "D"), 2, 1.4), (("A", "B", "C", "D"), 3, 2.1)}


def test_cycles_components_degrees(spark, f1):
    n, e = f1
    assert {tuple(r.cycle) for r in tr.cycles(e, 5).collect()} == {("A", "B", "C", "D", "A"), ("A", "E", "D", "A")}
    assert {r.id for r in tr.strong_components(e).collect()} == set("ABCDE")
    a = build.node_metrics(n, e).where("id = 'A'").first()
    assert (a.in_degree, a.out_degree, a.total_degree) == (1, 3, 4)
    assert [r.id for r in qu.pattern_match(n, {"type": "class", "name": "ClassA"}).collect()] == ["A"]


def test_impact(spark):
    n = nodes(spark, [("class_a", "a", "class", "a", "a.py", 1, 5), ("class_b", "b", "class", "b", "b.py", 1, 3), ("method_1", "m", "method", "m", "m.py", 1, 2), ("method_2", "k", "method", "k", "k.py", 1, 4), ("interface_i", "i", "interface", "i", "i.py", 1, 1)])
    e = edges(spark, [("1", "class_b", "class_a", "inherits", 0.9, None), ("2", "method_1", "class_a", "calls", 0.8, None), ("3", "method_2", "method_1", "calls", 0.7, None), ("4", "class_a", "interface_i", "implements", 0.9, None)])
    got = {r.id: (round(r.score, 6), r.level, r.role, r.distance) for r in im.impact(n, e, root(spark, "class_a"), 5).collect()}
    assert got == {"class_b": (0.623077, "HIGH", "downstream", 1), "interface_i": (0.523385, "MEDIUM", "upstream", 1), "method_1": (0.393846, "LOW", "downstream", 1), "method_2": (0.1792, "NONE", "downstream", 2)}


def test_grades(spark):
    rows = [("g", "r", "node1", "class", 0.8, 1, "HIGH"), ("g", "r", "node2", "method", 0.6, 2, "MEDIUM"), ("g", "r", "node3", "interface", 0.3, 3, "LOW")]
    g = im.grade(spark.createDataFrame(rows, "graph_id string, root string, id string, type string, score double, distance int, level string")).collect()
    assert {r.id: (round(r.grade_score, 6), r.grade) for r in g} == {"node1": (0.733333, "HIGH"), "node2": (0.546667, "MEDIUM"), "node3": (0.42, "MEDIUM")}


def test_rewrites(spark):
    n = nodes(spark, [("1", "T", "class", "T", "t.py", 1, 1), ("2", "T", "class", "T", "t.py", 1, 1), ("3", "O", "class", "O", "o.py", 1, 1)])
    e = edges(spark, [("a", "1", "3", "calls", 0.5, None), ("b", "2", "3", "calls", 0.4, None)])
    kept, own = rw.remove_duplicates(n, e)
    assert kept.count() == 2 and [(r.source_id, r.target_id) for r in own.collect()] == [("1", "3")]
    m = rw.merge_edges(edges(spark, [("a", "1", "2", "calls", 0.6, 5), ("b", "1", "2", "calls", 0.4, 3)])).first()
    assert (m.id, m.call_count, m.merged, m.strength) == ("a", 8, 2, 0.7)
    n = nodes(spark, [(x, x, "class", x, "f", 1, 1) for x in ("A1", "A2", "B1", "B2", "I")])
    c = rw.components(n, edges(spark, [("a", "A1", "A2", "calls", 1.0, 1), ("b", "B1", "B2", "calls", 1.0, 1)]))
    assert sorted(r["count"] for r in c.groupBy("component").count().collect()) == [1, 2, 2]


def test_similar_names(spark):
    n = nodes(spark, [("1", "getUser", "method", "getUser", "u.py", 1, 1), ("2", "getUsers", "method", "getUsers", "u.py", 2, 1), ("3", "getUserData", "method", "getUserData", "u.py", 3, 1), ("4", "other", "method", "other", "u.py", 4, 1), ("5", "getUserInfo", "method", "getUserInfo", "v.py", 4, 1)])
    got = {r.id: r.keep for r in rw.similar_seeds(n).collect()}
    assert got == {"1": "1", "2": "1", "3": "1", "4": "4", "5": "5"}


def test_chains(spark):
    e = edges(spark, [(str(k), a, b, "calls", 1.0, 1) for k, (a, b) in enumerate([("h", "x"), ("x", "y"), ("y", "t"), ("t", "u"), ("t", "v"), ("c", "d"), ("d", "c")])])
    assert [(r.head, r.tail, r.edges) for r in rw.linear_chains(e).collect()] == [("h", "t", 3)]
    got = {(r.source_id, r.target_id, r.compressed_chain) for r in rw.compress_chains(e).collect()}
    assert got == {("h", "t", True), ("t", "u", False), ("t", "v", False), ("c", "d", False), ("d", "c", False)}


def test_strong_components_against_closure(spark):
    rnd = random.Random(3)
    pairs = {(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(45)}
    reach = {a: {a} for a in {x for p in pairs for x in p}}
    for _ in range(30):
        for a, b in pairs:
            reach[a] |= reach[b]
    want = {x: min(y for y in reach if y in reach[x] and x in reach[y]) for x in reach if any(y != x and y in reach[x] and x in reach[y] for y in reach)}
    got = {r.id: r.component for r in tr.strong_components(edges(spark, [(f"{a}{b}", a, b, "calls", 1.0, 1) for a, b in pairs])).collect()}
    assert got == want


def test_row_numbers(spark):
    rows = [(k % 3 if k % 7 else None, k) for k in range(100)]
    df = spark.createDataFrame(rows, "g int, v int").repartition(5)
    got = {(r.g, r.v): r["rank"] for r in row_numbers(df, [F.desc("v")], by=["g"]).collect()}
    for g in (0, 1, 2, None):
        own = sorted((v for x, v in rows if x == g), reverse=True)
        assert [got[g, v] for v in own] == list(range(1, len(own) + 1))


def test_empty_graph(spark):
    n, e = nodes(spark, []), edges(spark, [])
    assert rw.components(n, e).count() == rw.linear_chains(e).count() == tr.strong_components(e).count() == 0
    assert im.impact(n, e, root(spark).limit(0), 3).count() == 0

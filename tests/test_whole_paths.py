"""Walks of whole graphs in tasks against loops of joins and plain walks."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from graphloom.operators import traverse as tr, whole
from graphloom.operators.whole import rounded
from graphloom.plans.graph_queries import QUERIES

EDGE = "graph_id string, id string, source_id string, target_id string, type string, strength double, call_count int, context string, line_number int"
NODE = "graph_id string, id string, label string, type string, element_id string, name string, file_path string, line_number int, complexity int, visibility string, docstring string, created_at timestamp"


@pytest.fixture(scope="module")
def graph(spark):
    """Two graphs of the same random shape, with parallel edges and edges to the node itself."""
    rnd = random.Random(11)
    rows = [(g, f"{g}{k:03}", f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}", rnd.choice(["calls", "imports", "uses"]), rnd.choice([0.1, 0.25, 0.7, None]), 1, None, None) for g in "gh" for k in range(40)]
    return spark.createDataFrame(rows, EDGE)


def test_shortest_in_tasks_and_by_joins(spark, graph):
    roots = spark.createDataFrame([(g, f"n{k}") for g in "gh" for k in range(9)] + [("h", "alone")], "graph_id string, root string")
    step = tr.steps(graph)
    rows = [{(*r[:5], tuple(r.path)) for r in tr.shortest(step, roots, 6, whole=n).collect()} for n in (0, 1000)]
    assert rows[0] == rows[1] and ("h", "alone", "alone", 0, 0.0, ("alone",)) in rows[1] and len(rows[1]) > 50
    joined = {(*r[:5], tuple(r.path.split(","))) for r in tr.shortest(step, roots, 6, ",").collect()}
    assert joined == rows[1]


def test_shortest_writes_no_paths(spark, graph, tmp_path):
    """the rows of each round were written, which fills the disk."""
    from graphloom import session

    graph.write.parquet(f"{tmp_path}/edges.parquet")
    spark.createDataFrame([(g, f"n{k}", "", "class", None, "", "f.py", 1, 1, "public", None, None) for g in "gh" for k in range(14)], NODE).write.parquet(f"{tmp_path}/nodes.parquet")
    before = len(session._WRITTEN)
    QUERIES["g1_shortest"](spark, str(tmp_path)).collect()
    written = [spark.read.parquet(p) for p in session._WRITTEN[before:]]
    assert written and not any("path" in df.columns for df in written)


def test_rounded_as_spark_rounds(spark):
    values = [0.1234567895, 0.1234567885, 2.5e-10, 5e-10, 0.1 + 0.2, 1.0000000005, -0.1234567895, 123456.1234567895, 0.0, 1e17]
    want = [r.x for r in spark.createDataFrame([(v,) for v in values], "x double").selectExpr("round(x, 9) AS x").collect()]
    assert rounded(np.array(values)).tolist() == want


def first_paths(pairs, goals, roots, most_nodes, most):
    """(root, goal, path, weight, types) of each simple path, of each root and goal the first by length, weight, path and types."""
    found: dict = {}

    def go(path, weight, types):
        if path[-1] in goals:
            found.setdefault((path[0], path[-1]), []).append((len(path), round(weight, 9), tuple(path), tuple(types)))
        elif len(path) < most_nodes:
            for a, b, w, t in pairs:
                if a == path[-1] and b not in path:
                    go([*path, b], weight + w, [*types, t])

    for root in roots:
        go([root], 0.0, [])
    return sorted((*pair, path, w, types) for pair, rows in found.items() for _, w, path, types in sorted(rows)[:most])


def random_graph(seed):
    """Arrays of a graph with parallel edges and equal weights; the edges, goals and roots."""
    rnd = random.Random(seed)
    ids = [f"n{k:02}" for k in range(rnd.choice([6, 9, 14]))]
    pairs = [(a, b, rnd.choice([0.1, 0.2, 0.3, 0.25]), rnd.choice(["calls", "uses"])) for a, b in (rnd.choices(ids, k=2) for _ in range(rnd.choice([12, 40, 70]))) if a != b]
    goals, roots = rnd.sample(ids, 2), rnd.sample(ids, 4)
    rows = [("g", 0, whole.EDGE, a, b, w, 0.5, t) for a, b, w, t in pairs]
    rows += [("g", 0, kind, i, None, None, None, None) for kind, some in ((whole.GOAL, goals), (whole.ROOT, roots)) for i in some]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string())
    names = ("graph_id", "part", "kind", "id", "next", "w", "product", "type")
    return whole.Graph(pa.table({n: pa.array(c, t) for n, c, t in zip(names, zip(*rows), kinds)})), pairs, goals, roots


@pytest.mark.parametrize("held", [1, 7, 500_000])
def test_paths_of_arrays_against_a_walk(monkeypatch, held):
    monkeypatch.setattr(whole, "PAIRS", held)
    seen = 0
    for seed in range(25):
        g, pairs, goals, roots = random_graph(seed)
        for nodes, most in ((5, None), (5, 3), (4, 2), (6, 2), (3, 1), (5, 10)):
            got = []
            for b in whole.paths(nodes, most, None)(g):
                got += zip(b["root"].to_pylist(), b["target"].to_pylist(), map(tuple, b["path"].to_pylist()), b["total_weight"].to_pylist(), map(tuple, b["types"].to_pylist()))
            want = first_paths(pairs, goals, roots, nodes, most)
            assert sorted(got) == want
            seen += len(want)
    assert seen > 1000


@pytest.mark.parametrize("most", [None, 2])
def test_paths_in_tasks_and_by_joins(spark, graph, most):
    roots = spark.createDataFrame([(g, f"n{k}") for g in "gh" for k in range(6)], "graph_id string, root string")
    goals = spark.createDataFrame([(g, i) for g in "gh" for i in ("n5", "n9")], "graph_id string, target string")
    step = tr.steps(graph)
    both = [sorted((*r[:3], tuple(r.path), r.length, r.total_weight, tuple(r.types)) for r in tr.paths(step, roots, goals, 5, most, whole=n).select("graph_id", "root", "target", "path", "length", "total_weight", "types").collect()) for n in (0, 1000)]
    assert both[0] == both[1] and len(both[0]) > 20


def written_with_paths(spark, graph, query, folder) -> bool:
    """Whether a query writes tables of paths."""
    from graphloom import session

    graph.write.parquet(f"{folder}/edges.parquet")
    kinds = ["method", "class", "function"]
    spark.createDataFrame([(g, f"n{k}", "", kinds[k % 3], None, "", "f.py", 1, 1, "public", None, None) for g in "gh" for k in range(14)], NODE).write.parquet(f"{folder}/nodes.parquet")
    before = len(session._WRITTEN)
    assert QUERIES[query](spark, str(folder)).count()
    return any("path" in spark.read.parquet(p).columns for p in session._WRITTEN[before:])


def test_all_paths_writes_no_paths(spark, graph, tmp_path):
    """the walks of each round were written, which fills the disk."""
    assert not written_with_paths(spark, graph, "g2_all_paths", tmp_path)


def test_dependency_paths_writes_no_paths(spark, graph, tmp_path):
    """the walks of each round were written."""
    assert not written_with_paths(spark, graph, "i10_dependency_paths", tmp_path)


def test_shortest_with_fewer_digits(spark):
    edge = spark.createDataFrame([("g", "e", "a", "b", "calls", 0.123456789, 1, None, None)], EDGE)
    root = spark.createDataFrame([("g", "a")], "graph_id string, root string")
    got = [{(r.target, r.total_weight) for r in tr.shortest(tr.steps(edge), root, 3, whole=n, digits=6).collect()} for n in (0, 1000)]
    assert got[0] == got[1] == {("a", 0.0), ("b", 0.123457)}


def test_cycles_in_tasks_and_by_joins(spark, graph):
    rows = [[(r.graph_id, tuple(r.cycle), r.length) for r in tr.cycles(graph, 7, whole=n).collect()] for n in (0, 1000)]
    assert set(rows[0]) == set(rows[1]) and len(rows[0]) == len(rows[1]) == len(set(rows[1])) > 100
    for n in (0, 1000):
        joined = tr.cycles(graph, 7, join=",", whole=n)
        assert joined.dtypes[1:] == [("cycle", "string"), ("length", "int")]
        assert sorted((r.graph_id, tuple(r.cycle.split(",")), r.length) for r in joined.collect()) == sorted(rows[1])


def test_cycles_write_no_paths(spark, graph, tmp_path):
    """halves of cycles were written and joined, more in each round."""
    assert not written_with_paths(spark, graph, "g5_cycles", tmp_path)


@pytest.mark.parametrize("most", [2, 3, 6, 10])
def test_cycles_of_a_graph_in_parts(most, monkeypatch):
    """A few paths and roots at a time, first edges dealt out to parts: each cycle once."""
    rnd = random.Random(most)
    pairs = sorted({(f"n{rnd.randrange(12):02}", f"n{rnd.randrange(12):02}") for _ in range(45)})
    pairs = [(a, b) for a, b in pairs if a != b]
    want = set()

    def go(path):
        for a, b in pairs:
            if a == path[-1] and b == path[0]:
                want.add((*path, b))
            elif a == path[-1] and b > path[0] and b not in path and len(path) < most:
                go([*path, b])

    for start in {a for a, _ in pairs}:
        go([start])
    monkeypatch.setattr(whole, "ONWARD", 3)
    monkeypatch.setattr(whole, "ROUND", 2 * len(pairs))
    n, got = len(pairs), []
    for own in range(4):
        table = pa.table({"graph_id": ["g"] * n, "part": [own] * n, "kind": [whole.EDGE] * n, "id": [a for a, _ in pairs], "next": [b for _, b in pairs], "parts": [4] * n, "own": [own] * n})
        for columns in whole.cycles(most, None)(whole.Graph(table)):
            got += [(tuple(c), k) for c, k in zip(columns["cycle"].to_pylist(), columns["length"].to_pylist())]
    assert len(got) == len(set(got)) and set(got) == {(c, len(c) - 1) for c in want} and want


@pytest.mark.parametrize("whole", [0, tr.WHOLE])
def test_cycles_leave_only_tables_that_they_read(spark, graph, whole, monkeypatch):
    """all tables that lead to the walk stayed on the disk while cycles were written."""
    from graphloom import session

    want = {tuple(r) for r in tr.strong_components(graph).collect()}
    components = tr.strong_components
    monkeypatch.setattr(tr, "strong_components", lambda e: components(e, whole))
    folder = Path(session.shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    rows = tr.cycles(graph, 7)
    assert {p.name for p in set(folder.iterdir()) - before} == {f.split("/")[-2] for f in rows.inputFiles()}
    assert rows.count() > 100 and {tuple(r) for r in components(graph, whole).collect()} == want

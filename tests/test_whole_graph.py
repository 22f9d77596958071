"""Whole results where rounds, lengths or types were cut before."""

from __future__ import annotations

import hashlib
import random

from graphloom.operators import rewrite as rw, traverse as tr
from graphloom.plans.graph_queries import QUERIES

NODE = "graph_id string, id string"
EDGE = "graph_id string, id string, source_id string, target_id string, type string, strength double, call_count int, context string, line_number int"


def edges(spark, pairs, kind="calls"):
    return spark.createDataFrame([("g", f"{kind}{k}", a, b, kind, 1.0, 1, None, None) for k, (a, b) in enumerate(pairs)], EDGE)


def ring(n, name="n"):
    return [(f"{name}{k:02}", f"{name}{(k + 1) % n:02}") for k in range(n)]


def cycles(spark, query, df, folder):
    df.write.parquet(f"{folder}/edges.parquet")
    return {(r.cycle, r.length) for r in QUERIES[query](spark, str(folder)).collect()}


def closed(n, name="n"):
    return ",".join(a for a, _ in ring(n, name)) + f",{name}00", n


def test_long_circular_dependencies(spark, tmp_path):
    df = edges(spark, ring(4, "a") + ring(6, "b") + ring(10, "c"), "depends")
    assert cycles(spark, "r2_circular", df, tmp_path) == {closed(4, "a"), closed(6, "b"), closed(10, "c")}


def test_components_of_a_long_path(spark):
    ids = ["001", *(f"{k:03}" for k in range(300, 1, -1))]
    got = rw.components(spark.createDataFrame([("g", "alone")], NODE), edges(spark, list(zip(ids, ids[1:]))))
    assert {(r.id, r.component) for r in got.collect()} == {("alone", "alone"), *((i, "001") for i in ids)}


def test_strong_components_of_a_long_chain(spark):
    pairs, last = [], None
    for k in range(600, 0, -2):  # two-node cycles in descending order, each with an edge to the next
        a, b = f"{k:03}", f"{k - 1:03}"
        pairs += [(a, b), (b, a)] + ([(last, a)] if last else [])
        last = b
    got = {r.id: r.component for r in tr.strong_components(edges(spark, pairs)).collect()}
    assert len(got) == 600 and all(got[f"{k:03}"] == got[f"{k - 1:03}"] == f"{k - 1:03}" for k in range(600, 0, -2))


def test_strong_components_by_rounds_and_in_one_task(spark):
    rnd = random.Random(5)
    df = edges(spark, sorted({(f"n{rnd.randrange(25)}", f"n{rnd.randrange(25)}") for _ in range(40)}))
    rounds, one = ({tuple(r) for r in tr.strong_components(df, n).collect()} for n in (0, 1000))
    assert rounds == one and one


def test_long_cycles_over_all_types(spark, tmp_path):
    df = edges(spark, ring(2, "a") + ring(5, "b"), "calls").unionByName(edges(spark, ring(10, "c") + ring(11, "d"), "defines"))
    assert cycles(spark, "g5_cycles", df, tmp_path) == {closed(2, "a"), closed(5, "b"), closed(10, "c")}


def test_cycles_against_a_walk(spark):
    rnd = random.Random(7)
    pairs = {(f"n{rnd.randrange(12):02}", f"n{rnd.randrange(12):02}") for _ in range(34)}
    want = set()

    def walk(path):
        for a, b in pairs:
            if a == path[-1] and a != b:
                if b == path[0]:
                    want.add((*path, b))
                elif b > path[0] and b not in path and len(path) < 7:
                    walk([*path, b])

    for start in {a for a, _ in pairs}:
        walk([start])
    got = [tuple(r.cycle) for r in tr.cycles(edges(spark, sorted(pairs)), 7).collect()]
    assert len(got) == len(set(got)) and set(got) == want and max(map(len, got)) == 8


def test_paths_from_all_methods_over_all_types(spark, tmp_path):
    df = edges(spark, [("m1", "x1"), ("x1", "x2"), ("x2", "x3"), ("x3", "k1"), ("m2", "x1"), ("m0", "m1")])
    df.write.parquet(f"{tmp_path}/edges.parquet")
    kinds = {"m0": "method", "m1": "method", "m2": "method", "k1": "class", "x1": "function", "x2": "function", "x3": "function"}
    columns = "graph_id string, id string, label string, type string, element_id string, name string, file_path string, line_number int, complexity int, visibility string, docstring string, created_at timestamp"
    spark.createDataFrame([("g", i, i, t, None, i, "f.py", 1, 1, "public", None, None) for i, t in kinds.items()], columns).write.parquet(f"{tmp_path}/nodes.parquet")
    tail = "x1,x2,x3,k1"
    assert {r.path for r in QUERIES["g2_all_paths"](spark, str(tmp_path)).collect()} == {f"m1,{tail}", f"m2,{tail}"}
    assert {r.path for r in QUERIES["i10_dependency_paths"](spark, str(tmp_path)).collect()} == {f"m1,{tail}", f"m2,{tail}", f"m0,m1,{tail}"}


def test_shortest_paths_of_ten_nodes(spark, tmp_path):
    """From every node whose id's hash is divisible by 20."""
    df = edges(spark, ring(40))
    df.write.parquet(f"{tmp_path}/edges.parquet")
    columns = "graph_id string, id string, label string, type string, element_id string, name string, file_path string, line_number int, complexity int, visibility string, docstring string, created_at timestamp"
    ids = [f"n{k:02}" for k in range(40)]
    spark.createDataFrame([("g", i, i, "class", None, i, "f.py", 1, 1, "public", None, None) for i in ids], columns).write.parquet(f"{tmp_path}/nodes.parquet")
    roots = [k for k, i in enumerate(ids) if int(hashlib.md5(i.encode()).hexdigest()[:6], 16) % 20 == 0]
    got = {(r.root, r.target): r.length for r in QUERIES["g1_shortest"](spark, str(tmp_path)).collect()}
    assert roots and got == {(ids[k], ids[(k + d) % 40]): d for k in roots for d in range(10)}

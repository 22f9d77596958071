from __future__ import annotations

import random
from collections import Counter

from graphloom.operators import tree_aggregate as ta

EDGE = "id string, source_id string, target_id string, strength double, side string"


def test_against_counter(spark):
    rnd = random.Random(2)
    rows = [(f"e{i}", rnd.choice(["hub", " HUB\t", f"n{rnd.randrange(9)}", None, " "]), f"m{rnd.randrange(5)}", rnd.choice([0.25, 0.5, None]), "x") for i in range(200)]
    df = spark.createDataFrame(rows + rows[:30] + [(None, "hub", "m1", 0.5, "x")] * 2, EDGE)
    want = Counter()
    for _, a, b, *_ in rows + [(None, "hub", "m1", 0.5, "x")]:
        for side, x in (("source", a), ("target", b)):
            if x and x.strip():
                want[side, x.strip().lower()] += 1
    for kw in ({}, {"chunk_rows": 7, "fan_in": 2}):
        got = {(r.side, r.node_id): r.edges for r in ta.node_degrees(df, **kw).collect()}
        assert got == dict(want)
    heavy = {(r.side, r.node_id) for r in ta.heavy_nodes(df, 0.2, chunk_rows=7, fan_in=2).collect()}
    assert heavy == {k for k, n in want.items() if n >= 0.2 * 201}


def test_empty(spark):
    assert ta.node_degrees(spark.createDataFrame([], EDGE)).collect() == []
    assert ta.heavy_nodes(spark.createDataFrame([(None, None, None, None, None)], EDGE)).collect() == []

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from graphloom.operators import orphans

T0 = datetime(2025, 1, 1)
REF, PARENT = "scope string, key string, t timestamp, ref string, begin string", "scope string, key string, begin timestamp, end timestamp"


def brute(refs, parents):
    out = set()
    for scope, key, t, ref, extra in refs:
        if key is None:
            continue
        own = [(b, e) for s, k, b, e in parents if s is not None and s == scope and k == key]
        if not own:
            out.add((ref, "missing"))
        elif t is not None and not any(b is not None and b <= t and (e is None or e > t) for b, e in own):
            out.add((ref, "deleted" if any(b is not None and b <= t for b, _ in own) else "late"))
    return out


@pytest.mark.parametrize("kw", [{}, {"max_lifetimes": 1, "hot_share": 0.05}, {"max_lifetimes": 0, "blocks": 3, "hot_share": 0.05}])
def test_against_brute_force(spark, kw):
    rnd = random.Random(5)
    day = lambda: T0 + timedelta(days=rnd.randrange(200))
    parents = []
    for k in range(40):
        for _ in range(rnd.randrange(1, 4)):
            b = day()
            parents.append((rnd.choice("ab"), f"k{k}", rnd.choice([b, b, None]), rnd.choice([None, b + timedelta(days=rnd.randrange(60))])))
    parents += parents[:5] + [(None, "k1", T0, None), ("a", None, T0, None)]
    refs = [(rnd.choice(["a", "b", "a", None]), rnd.choice([f"k{rnd.randrange(60)}", "k1", "k1", None]), rnd.choice([day(), day(), None]), f"r{i}", "x") for i in range(300)]
    refs += refs[:20]
    got = orphans.find_orphans(spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PARENT), **kw).collect()
    assert {(r.ref, r.reason) for r in got} == brute(refs, parents)
    assert len(got) == len({tuple(r) for r in got})


def test_empty_tables(spark):
    refs, parents = spark.createDataFrame([("a", "k", T0, "r", "x")], REF), spark.createDataFrame([], PARENT)
    assert [r.reason for r in orphans.find_orphans(refs, parents).collect()] == ["missing"]
    assert orphans.find_orphans(refs.limit(0), parents).collect() == []


def test_clean_id(spark):
    df = spark.createDataFrame([("\t Ab ",), (" \t",), ("",), (None,), ("a b",)], "x string")
    assert [r[0] for r in df.select(orphans.clean_id(df.x)).collect()] == ["ab", None, None, None, "a b"]


def test_filter_proves_most_missing_keys(spark):
    keys = spark.range(200_000).selectExpr("'a' AS scope", "concat('k', id) AS key")
    other = spark.range(50_000).selectExpr("'a' AS scope", "concat('m', id) AS key")
    blocks = -(-200_000 * orphans.BITS_A_KEY // 32768)
    may = lambda df: orphans.might_contain(df, ["scope", "key"], keys, blocks).where("_may").count()
    assert may(keys) == 200_000 and may(other) < 0.02 * 50_000


def test_filter_larger_than_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(orphans, "BROADCAST_BYTES", 0)
    parents = spark.createDataFrame([("a", f"k{k}", T0, None) for k in range(50)], PARENT)
    refs = spark.createDataFrame([("a", f"k{k}", T0 + timedelta(days=1), f"r{k}", "x") for k in range(45, 60)], REF)
    assert sorted(r.ref for r in orphans.find_orphans(refs, parents).collect()) == [f"r{k}" for k in range(50, 60)]

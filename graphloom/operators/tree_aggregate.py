"""Per-key results where a few keys hold most rows (problem 5).

Multi-level tree aggregation: input chunks of fixed size are combined locally, then the states are merged in
rounds of bounded fan-in. No task gets all partial states of a hot key, nor its rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.operators.orphans import clean_id

#: Rows of one input chunk, and chunks that one merge takes together.
CHUNK_ROWS = 1 << 16
FAN_IN = 16


def tree_aggregate(rows: DataFrame, keys: list[str], first: dict[str, Column], merge: dict[str, Column], chunks: int, fan_in: int = FAN_IN) -> DataFrame:
    """Aggregate ``rows`` (which carry ``_chunk``, an integer below ``chunks``) per ``keys``.

    first: the states of a chunk; merge: how states of the same names are merged, both as aggregate columns. The
    states must not depend on order. If rows are partitioned by ``_chunk``, the first level needs no shuffle; each
    further round joins at most ``fan_in`` states of a key in one group. Null keys form a group of their own.
    """
    state = rows.groupBy("_chunk", *keys).agg(*[c.alias(n) for n, c in first.items()])
    while chunks > 1:
        state = state.withColumn("_chunk", F.floor(F.col("_chunk") / fan_in).cast("int")).groupBy("_chunk", *keys).agg(*[c.alias(n) for n, c in merge.items()])
        chunks = math.ceil(chunks / fan_in)
    return state.drop("_chunk")


def edge_ends(edges: DataFrame, rows: int | None = None, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, int]:
    """Each edge id once, its ends cleaned, in hash chunks of about ``chunk_rows`` rows; and the number of chunks.

    Chunks follow from the id alone, so a task that runs again after a lost executor gives the same chunks.
    Rows with a null id can't be told apart as copies; equal ones count once.
    """
    rows = edges.count() if rows is None else rows  # from the files' footers
    chunks = max(1, math.ceil(rows / chunk_rows))
    at = edges.select("id", clean_id(F.col("source_id")).alias("source"), clean_id(F.col("target_id")).alias("target"), "strength")
    at = at.withColumn("_chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
    if chunks > 1:
        at = at.repartition("_chunk")  # the only shuffle of whole rows: copies of an id meet, and chunks are local
    some = at.where("id IS NOT NULL").groupBy("_chunk", "id").agg(*[F.min(c).alias(c) for c in ("source", "target", "strength")])
    return some.unionByName(at.where("id IS NULL").distinct().select(*some.columns)), chunks


def node_degrees(edges: DataFrame, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """For each side and node: edges, their part of all edges, mean and greatest strength.

    side is ``source`` or ``target``; null and blank ends name no node; null strengths are left out of the mean.
    ``share`` is over all distinct edges, also those without ends. An empty table gives no rows.
    """
    at, chunks = edge_ends(edges, chunk_rows=chunk_rows)
    side = lambda s, c: F.struct(F.lit(s).alias("side"), c.alias("node_id"))
    ends = at.select("_chunk", "strength", F.explode(F.array(side("source", F.col("source")), side("target", F.col("target")), side("all", F.lit(None).cast("string")))).alias("_e"))
    ends = ends.select("_chunk", "strength", "_e.side", "_e.node_id").where("node_id IS NOT NULL OR side = 'all'")
    one = F.col("strength").cast("decimal(20,6)")  # sums must not depend on the order of merging
    first = {"edges": F.count("*"), "strength_n": F.count("strength"), "strength_sum": F.sum(one), "strength_max": F.max("strength")}
    merge = {"edges": F.sum("edges"), "strength_n": F.sum("strength_n"), "strength_sum": F.sum("strength_sum"), "strength_max": F.max("strength_max")}
    state = tree_aggregate(ends, ["side", "node_id"], first, merge, chunks, fan_in)
    total = state.where("side = 'all'").agg(F.sum("edges").alias("n")).scalar()
    out = state.where("side <> 'all'")
    return out.select("side", "node_id", "edges", (F.col("edges") / total).alias("share"), (F.col("strength_sum") / F.col("strength_n")).cast("double").alias("mean_strength"), F.col("strength_max").alias("max_strength"), total.alias("_total"))


def heavy_nodes(edges: DataFrame, least_share: float = 0.01, **kw) -> DataFrame:
    """side, node_id of the ids that stand in at least ``least_share`` of all edges on that side."""
    return node_degrees(edges, **kw).where(F.col("edges") >= F.lit(least_share) * F.col("_total")).select("side", "node_id")

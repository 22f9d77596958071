"""One row per node and per edge from tables with copies, stale rows and careless ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.operators.orphans import clean_id

NODE_COLUMNS = ["label", "type", "element_id", "name", "file_path", "line_number", "complexity", "visibility", "docstring"]
EDGE_COLUMNS = ["type", "strength", "call_count", "context", "line_number"]
#: Rows up to which a table counts as small enough to broadcast; beyond it the join shuffles.
SMALL_ROWS = 20_000


def latest_nodes(nodes: DataFrame) -> DataFrame:
    """The latest row of each (graph_id, id), ids cleaned. Rows without graph or id are left out; a null time is the earliest."""
    n = nodes.withColumn("id", clean_id(F.col("id"))).where("graph_id IS NOT NULL AND id IS NOT NULL")
    row = F.max_by(F.struct(*NODE_COLUMNS), F.coalesce(F.col("created_at"), F.to_timestamp(F.lit("1970-01-01"))))
    return n.groupBy("graph_id", "id").agg(row.alias("_r")).select("graph_id", "id", "_r.*")


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Each edge id once, ends cleaned; edges without a graph or an end are left out."""
    e = edges.select("graph_id", "id", clean_id(F.col("source_id")).alias("source_id"), clean_id(F.col("target_id")).alias("target_id"), *EDGE_COLUMNS)
    return e.dropDuplicates(["id"]).where("graph_id IS NOT NULL AND source_id IS NOT NULL AND target_id IS NOT NULL")


def once(df: DataFrame, key: str = "id") -> DataFrame:
    """Each key once; rows delivered twice are copies."""
    return df.dropDuplicates([key])


def small(df: DataFrame, known: int | None = None, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its known number of rows, else a count, shows that it is small. For checkpointed or
    written tables, whose count is cheap."""
    n = df.limit(rows + 1).count() if known is None else known
    return F.broadcast(df) if n <= rows else df

"""Lookups, filters, pages and statistics of graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def pattern_match(rows: DataFrame, constraints: dict) -> DataFrame:
    """Rows that meet all constraints; ``type`` and ``label`` must be equal, any other key only where it is present."""
    cond = F.lit(True)
    for k, v in constraints.items():
        cond &= F.col(k) == v if k in ("type", "label") else F.col(k).isNull() | (F.col(k) == v)
    return rows.where(cond)


def query_rows(rows: DataFrame, constraints: dict) -> DataFrame:
    """Rows in which every key is present and equal."""
    for k, v in constraints.items():
        rows = rows.where(F.col(k) == v)
    return rows


def find_by_property(rows: DataFrame, key: str, value) -> DataFrame:
    """Rows whose property equals the value; None finds those without it."""
    return rows.where(F.col(key).eqNullSafe(F.lit(value)))


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with label and type of their ends, null where an end has no node."""
    n = nodes.select("graph_id", "id", "label", "type")
    for side in ("source", "target"):
        edges = edges.join(n.select("graph_id", F.col("id").alias(f"{side}_id"), F.col("label").alias(f"{side}_label"), F.col("type").alias(f"{side}_type")), ["graph_id", f"{side}_id"], "left")
    return edges


def remove_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those in ``gone`` (graph_id, id), and edges that touch none of them."""
    left = nodes.join(gone, ["graph_id", "id"], "left_anti")
    for c in ("source_id", "target_id"):
        edges = edges.join(gone.select("graph_id", F.col("id").alias(c)), ["graph_id", c], "left_anti")
    return left, edges


def subgraph(nodes: DataFrame, edges: DataFrame, cond: Column) -> tuple[DataFrame, DataFrame]:
    """Nodes that meet a condition and the edges between them."""
    some = nodes.where(cond)
    ids = some.select("graph_id", "id")
    for c in ("source_id", "target_id"):
        edges = edges.join(ids.withColumnRenamed("id", c), ["graph_id", c], "left_semi")
    return some, edges


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """A page of rows in a total order; offset plus limit stay on one task only as a top-k."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_info(rows: DataFrame, page_size: int, page_number: Column | int = 1) -> DataFrame:
    """total, total_pages, has_next and has_prev of a page."""
    n = F.lit(page_number) if isinstance(page_number, int) else page_number
    pages = F.ceil(F.col("total") / page_size)
    return rows.agg(F.count("*").alias("total")).select("total", pages.alias("total_pages"), (n < pages).alias("has_next"), (n > 1).alias("has_prev"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (node or edge), type and count over all graphs."""
    return nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "type", "n").unionByName(edges.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "type", "n"))

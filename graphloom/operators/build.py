"""Graph construction: nodes, edges, strengths, metadata, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.operators.orphans import clean_id
from graphloom.schema import BASE_STRENGTH, OTHER_STRENGTH, lookup


def latest_elements(elements: DataFrame) -> DataFrame:
    """The latest row of each element id."""
    cols = ["name", "type", "file_path", "line_number", "end_line_number", "complexity", "visibility", "is_abstract", "is_static", "parameters", "return_type", "docstring", "parent_id", "language", "code"]
    e = elements.withColumn("id", clean_id(F.col("id"))).where("id IS NOT NULL")
    return e.groupBy("id").agg(F.max_by(F.struct(*cols), "recorded_at").alias("_r")).select("id", "_r.*")


def create_nodes(elements: DataFrame) -> DataFrame:
    """One node per element; ids follow from the content, so a recomputed task gives the same."""
    return elements.select(
        F.sha2(F.concat_ws("|", "name", "type", "file_path", F.col("line_number").cast("string")), 256).alias("id"),
        F.col("name").alias("label"), "type", F.col("id").alias("element_id"), "file_path", "line_number", "complexity", F.coalesce("visibility", F.lit("public")).alias("visibility"),
    )


def relationship_strength(type_col="type", context="context", calls="call_count"):
    """Base by type, more for a long context and for many calls, at most 1."""
    base = lookup(BASE_STRENGTH, F.col(type_col), OTHER_STRENGTH)
    context_bonus = F.when(F.length(context) > 50, 0.1).otherwise(0.0)
    call_bonus = F.when(F.col(calls) > 10, 0.2).when(F.col(calls) > 5, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), base + context_bonus + call_bonus)


def create_edges(relationships: DataFrame, elements: DataFrame) -> DataFrame:
    """Relationships whose two ends are elements, with their strength; others are left out (see ``unresolved``)."""
    ids = elements.select("id")
    r = relationships.dropDuplicates(["id"]).withColumns({"source_id": clean_id(F.col("source_id")), "target_id": clean_id(F.col("target_id"))})
    r = r.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return r.select("id", "source_id", "target_id", "type", relationship_strength().alias("strength"), "call_count", "context")


def unresolved(relationships: DataFrame, elements: DataFrame) -> DataFrame:
    """Relationships that ``create_edges`` leaves out."""
    return relationships.dropDuplicates(["id"]).select("id", "type").join(create_edges(relationships, elements).select("id"), "id", "left_anti")


def graph_metadata(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts and histograms per graph in long form: graph_id, metric, key, value."""
    lang = F.regexp_extract("file_path", r"\.(py|java|js|ts|go)$", 1)
    one = lambda df, metric, key, n: df.groupBy("graph_id", key.alias("key")).agg(n.alias("value")).select("graph_id", F.lit(metric).alias("metric"), "key", "value")
    count, none = F.count("*"), F.lit("")
    return (
        one(nodes, "nodes", none, count).unionByName(one(edges, "edges", none, count)).unionByName(one(nodes, "files", none, F.countDistinct("file_path")))
        .unionByName(one(nodes.where(lang != ""), "language", lang, count)).unionByName(one(nodes, "node_type", F.col("type"), count)).unionByName(one(edges, "edge_type", F.col("type"), count))
    )


def node_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In, out and total degree of each node; a self-loop counts once, as in-degree."""
    loop = F.col("source_id") == F.col("target_id")
    ends = edges.select("graph_id", F.explode(F.array(
        F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
        F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.when(loop, 0).otherwise(1).alias("o")),
    )).alias("e"))
    # the sums are combined before the shuffle, so a hub's edges don't meet in one task
    degree = ends.groupBy("graph_id", "e.id").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = nodes.select("graph_id", "id").join(degree, ["graph_id", "id"], "left")
    return out.select("graph_id", "id", zero("in_degree").alias("in_degree"), zero("out_degree").alias("out_degree"), (zero("in_degree") + zero("out_degree")).alias("total_degree"))


def connected(edges: DataFrame) -> DataFrame:
    """Distinct neighbours either way: graph_id, id, neighbour."""
    pair = F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("neighbour")), F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("neighbour"))))
    return edges.select("graph_id", pair.alias("p")).select("graph_id", "p.id", "p.neighbour").where("id <> neighbour").distinct()


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes of equal (graph, name, type, file) as one: the least id, the greatest complexity, the number merged."""
    return nodes.groupBy("graph_id", "name", "type", "file_path").agg(F.min("id").alias("id"), F.max("complexity").alias("complexity"), F.count("*").alias("merged"))


def compress_properties(nodes: DataFrame, longest: int = 1000) -> DataFrame:
    """Properties as a map without null and empty values; longer strings are cut and marked."""
    cols = ["label", "type", "element_id", "name", "file_path", "visibility", "docstring"]
    cut = lambda c: F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest), F.lit("..."))).otherwise(F.col(c))
    props = F.map_filter(F.create_map(*[x for c in cols for x in (F.lit(c), cut(c))]), lambda k, v: v.isNotNull() & (v != ""))
    return nodes.select("graph_id", "id", props.alias("props"))

"""Graph stores: files of one document, partitioned multi-graph tables, snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from graphloom.errors import NotFoundError, StoreError

GRAPH_JSON = "nodes array<struct<id: string, label: string, type: string, properties: map<string, string>>>, edges array<struct<id: string, source_id: string, target_id: string, type: string, properties: map<string, string>>>"


def read_graph_json(spark: SparkSession, path: str, graph_id: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of JSON documents ``{nodes, edges}``; the last node of an id wins."""
    doc = spark.read.schema(GRAPH_JSON).json(path, multiLine=True)
    n = doc.select(F.posexplode("nodes").alias("k", "n")).groupBy("n.id").agg(F.max_by("n", "k").alias("n")).select(F.lit(graph_id).alias("graph_id"), "n.*")
    e = doc.select(F.explode("edges").alias("e")).select(F.lit(graph_id).alias("graph_id"), "e.*").dropDuplicates(["id"])
    return n, e


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Store graphs; those that are written replace their former selves, others stay (dynamic partition overwrite)."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph_id").parquet(f"{path}/{name}")


def _table(spark: SparkSession, path: str, least: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as x:
        if x.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return spark.createDataFrame([], least)


def read_graph(spark: SparkSession, path: str, graph_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Stored nodes and edges; a graph id prunes partitions. Tables without any file are empty."""
    out = [_table(spark, f"{path}/{name}", least) for name, least in (("nodes", "id string, label string, type string, graph_id string"), ("edges", "id string, source_id string, target_id string, type string, graph_id string"))]
    return tuple(x.where(F.col("graph_id") == graph_id) if graph_id else x for x in out)


def list_graphs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id with the number of its nodes and edges."""
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("nodes"))
    return n.join(edges.groupBy("graph_id").agg(F.count("*").alias("edges")), "graph_id", "full_outer").select("graph_id", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"))


def delete_graph(spark: SparkSession, path: str, graph_id: str) -> None:
    """Remove a graph's partitions through the file system of the path."""
    jvm = spark._jvm
    for name in ("nodes", "edges"):
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/graph_id={graph_id}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def export_rows(nodes: DataFrame) -> DataFrame:
    """Nodes as JSON strings: graph_id, id, document."""
    return nodes.select("graph_id", "id", F.to_json(F.struct("id", "label", "type", "name", "file_path", "line_number", "complexity")).alias("document"))


def import_rows(documents: DataFrame) -> DataFrame:
    """The inverse of ``export_rows``."""
    s = "id string, label string, type string, name string, file_path string, line_number int, complexity int"
    return documents.select("graph_id", F.from_json("document", s).alias("d")).select("graph_id", "d.*")


def retained(backups: DataFrame, keep: int = 30, days: int = 7) -> DataFrame:
    """Snapshots to keep: of each name the ``keep`` latest that are at most ``days`` older than its latest."""
    w = W.partitionBy("name").orderBy(F.desc("ts"), "id")
    x = backups.withColumn("n", F.row_number().over(w)).withColumn("last", F.max("ts").over(W.partitionBy("name")))
    return x.where((F.col("n") <= keep) & (F.col("ts") >= F.col("last") - F.expr(f"INTERVAL {days} DAYS"))).select("id", "name", "ts")


def register(spark: SparkSession, **tables: DataFrame) -> None:
    """Views for queries in SQL."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def graph_documents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each graph as one JSON document ``{nodes, edges, metadata}``, which ``read_graph_json`` reads: graph_id, document.

    A graph's rows meet in one task, so this is for graphs that fit one document; ``write_graph`` has no such bound.
    """
    shape = lambda df, *keep: F.struct(*keep, F.map_filter(F.create_map(*[x for c in df.columns if c not in ("graph_id", *keep) for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull()).alias("properties"))
    n = nodes.select("graph_id", shape(nodes, "id", "label", "type").alias("x")).groupBy("graph_id").agg(F.array_sort(F.collect_list("x"), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("nodes"))
    e = edges.select("graph_id", shape(edges, "id", "source_id", "target_id", "type").alias("x")).groupBy("graph_id").agg(F.array_sort(F.collect_list("x"), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("edges"))
    meta = F.struct(F.size(F.coalesce("nodes", F.array())).alias("node_count"), F.size(F.coalesce("edges", F.array())).alias("edge_count"))
    return n.join(e, "graph_id", "full_outer").select("graph_id", F.to_json(F.struct("nodes", "edges", meta.alias("metadata"))).alias("document"))


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One folder a graph with its JSON document."""
    graph_documents(nodes, edges).select("graph_id", F.col("document").alias("value")).write.mode("overwrite").partitionBy("graph_id").text(path)


def _xml(c) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def graphml_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges as GraphML elements: graph_id, part (``node`` or ``edge``), id, xml. Lines can be written in parallel
    and joined between a graph's opening and closing tags."""
    data = lambda *cs: F.concat(*[F.concat(F.lit(f'<data key="{c}">'), _xml(F.col(c)), F.lit("</data>")) for c in cs])
    n = nodes.select("graph_id", F.lit("node").alias("part"), "id", F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('">'), data("label", "type"), F.lit("</node>")).alias("xml"))
    e = edges.select("graph_id", F.lit("edge").alias("part"), "id", F.concat(F.lit('<edge id="'), _xml(F.col("id")), F.lit('" source="'), _xml(F.col("source_id")), F.lit('" target="'), _xml(F.col("target_id")), F.lit('">'), data("type"), F.lit("</edge>")).alias("xml"))
    return n.unionByName(e)


def append_fragment(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Add rows to stored graphs without touching what is there; ``latest`` of an id is settled when read."""
    for name, df in (("nodes", nodes), ("edges", edges)):
        df.write.mode("append").partitionBy("graph_id").parquet(f"{path}/{name}")


def create_backup(spark: SparkSession, path: str, backups: str, name: str, stamp: str) -> str:
    """Copy stored graphs to ``backups/name/stamp``; the folder's name."""
    target = f"{backups}/{name}/{stamp}"
    for part in ("nodes", "edges"):
        spark.read.parquet(f"{path}/{part}").write.partitionBy("graph_id").parquet(f"{target}/{part}")
    return target


def restore_backup(spark: SparkSession, backup: str, path: str) -> None:
    """Replace stored graphs by a backup's; a missing backup is an error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{backup}/nodes")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise NotFoundError(f"no backup at {backup}")
    for part in ("nodes", "edges"):
        spark.read.parquet(f"{backup}/{part}").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("graph_id").parquet(f"{path}/{part}")


def delete_backup(spark: SparkSession, backup: str) -> bool:
    """Remove a backup; whether there was one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(backup)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class GraphStore:
    """Stored graphs under one path, with what has been added since the last save."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._added = spark, path, []

    def add(self, nodes: DataFrame, edges: DataFrame) -> GraphStore:
        self._added.append((nodes, edges))
        return self

    def save(self) -> None:
        """Write all that was added, replacing the graphs of those ids."""
        if not self._added:
            raise StoreError("nothing was added")
        n, e = self._added[0]
        for n2, e2 in self._added[1:]:
            n, e = n.unionByName(n2, allowMissingColumns=True), e.unionByName(e2, allowMissingColumns=True)
        write_graph(n, e, self.path)
        self._added = []

    def graph(self, graph_id: str) -> tuple[DataFrame, DataFrame]:
        return read_graph(self.spark, self.path, graph_id)

    def by_element(self, element_id: str) -> DataFrame:
        return read_graph(self.spark, self.path)[0].where(F.col("element_id") == element_id)

    def info(self) -> DataFrame:
        """graph_id, nodes and relationships."""
        return list_graphs(*read_graph(self.spark, self.path)).withColumnRenamed("edges", "relationships")

    def clear(self) -> None:
        for name in ("nodes", "edges"):
            delete_backup(self.spark, f"{self.path}/{name}")

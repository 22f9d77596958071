"""Layout-ready rows of impacts and graphs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.plans.rank import row_numbers
from graphloom.schema import lookup

#: Colours of levels.
LEVEL_COLOUR = {"CRITICAL": "#d32f2f", "HIGH": "#f57c00", "MEDIUM": "#fbc02d", "LOW": "#388e3c", "NONE": "#9e9e9e"}


def visual_nodes(impacts: DataFrame) -> DataFrame:
    """Size 8 + 17 score, opacity and the level's colour of each node."""
    return impacts.select("graph_id", "root", "id", "level", "distance", F.round(8 + 17 * F.col("score"), 6).alias("size"), F.round(F.least(F.lit(0.8), F.col("score") + 0.3), 6).alias("opacity"), lookup(LEVEL_COLOUR, F.col("level"), LEVEL_COLOUR["NONE"]).alias("colour"))


def visual_edges(paths: DataFrame) -> DataFrame:
    """Hops of paths with width 1 + 4 strength."""
    hop = F.posexplode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] AS source, path[i] AS target))")).alias("hop", "e")
    return paths.where("size(path) > 1").select("graph_id", "root", "id", hop, "strength").select("graph_id", "root", "id", "hop", "e.source", "e.target", F.round(1 + 4 * F.col("strength"), 6).alias("width"))


def clusters(impacts: DataFrame) -> DataFrame:
    """Types with more than one member per root; ``members`` counts them and ``first`` is the least id."""
    return impacts.groupBy("graph_id", "root", "type").agg(F.count("*").alias("members"), F.min("id").alias("first")).where("members > 1")


def _spread(impacts: DataFrame, by: list[str]) -> DataFrame:
    n = impacts.groupBy(*by).agg(F.count("*").alias("_n"))
    return row_numbers(impacts, [F.asc("id")], "_i", by).join(n, by)


def _xy(x: Column, y: Column) -> list[Column]:
    return [F.round(x, 4).alias("x"), F.round(y, 4).alias("y")]


def ring_layout(impacts: DataFrame, cx: float = 400.0, cy: float = 300.0) -> DataFrame:
    """A ring for each distance, of radius 80 + 60 d."""
    d = _spread(impacts, ["graph_id", "root", "distance"])
    angle, r = 2 * math.pi * (F.col("_i") - 1) / F.col("_n"), 80 + 60 * F.col("distance")
    return d.select("graph_id", "root", "id", *_xy(cx + r * F.cos(angle), cy + r * F.sin(angle)))


def row_layout(impacts: DataFrame, width: float = 800.0, gap: float = 100.0) -> DataFrame:
    """A row for each distance, evenly spaced."""
    d = _spread(impacts, ["graph_id", "root", "distance"])
    return d.select("graph_id", "root", "id", *_xy(width * F.col("_i") / (F.col("_n") + 1), gap * (F.col("distance") + 1)))


def circle_layout(impacts: DataFrame, width: float = 800.0, height: float = 600.0) -> DataFrame:
    """All nodes of a root on one circle."""
    d = _spread(impacts, ["graph_id", "root"])
    angle, r = 2 * math.pi * (F.col("_i") - 1) / F.col("_n"), min(width, height) / 3
    return d.select("graph_id", "root", "id", *_xy(width / 2 + r * F.cos(angle), height / 2 + r * F.sin(angle)))


def heat_map(impacts: DataFrame, grid: int = 10) -> DataFrame:
    """A cell for each node; numbering starts anew for each level."""
    d = row_numbers(impacts, [F.desc("score"), F.asc("id")], "_i", ["graph_id", "root", "level"])
    i = F.col("_i") - 1
    return d.select("graph_id", "root", "level", "id", (i % grid).alias("x"), F.floor(i / grid).alias("y"), "score")


def timeline(issues: DataFrame) -> DataFrame:
    """Per month and level the issues found."""
    return issues.groupBy(F.date_format("detected_at", "yyyy-MM").alias("month"), F.coalesce(F.lower("level"), F.lit("low")).alias("level")).agg(F.count("*").alias("n"))


def type_matrix(impacts: DataFrame) -> DataFrame:
    """For each pair of types 0.7 times the mean of their mean scores, and 0.3 times the mean strength of paths between
    a root's node of one type and of the other where the two share a root. There are few types, so the pairs are few."""
    avg = impacts.groupBy("type").agg(F.avg("score").alias("s"), F.avg("strength").alias("t"))
    a, b = avg.select(F.col("type").alias("row"), F.col("s").alias("s1"), F.col("t").alias("t1")), avg.select(F.col("type").alias("col"), F.col("s").alias("s2"), F.col("t").alias("t2"))
    value = 0.7 * (F.col("s1") + F.col("s2")) / 2 + 0.3 * (F.col("t1") + F.col("t2")) / 2
    return a.join(b, F.col("row") <= F.col("col")).select("row", "col", F.round(value, 6).alias("value"))


def layers(impacts: DataFrame) -> DataFrame:
    """Every distance of a root up to its greatest, empty ones included: nodes, mean and greatest score."""
    per = impacts.groupBy("graph_id", "root", "distance").agg(F.count("*").alias("nodes"), F.round(F.avg("score"), 6).alias("mean"), F.max("score").alias("max"))
    every = impacts.groupBy("graph_id", "root").agg(F.max("distance").alias("_m")).select("graph_id", "root", F.explode(F.sequence(F.lit(0), "_m")).alias("distance"))
    return every.join(per, ["graph_id", "root", "distance"], "left").select("graph_id", "root", "distance", F.coalesce("nodes", F.lit(0)).alias("nodes"), "mean", "max")


def strength_classes(impacts: DataFrame) -> DataFrame:
    """Paths by class of their strength."""
    s = F.col("strength")
    name = F.when(s >= 0.8, "very strong").when(s >= 0.6, "strong").when(s >= 0.4, "medium").when(s >= 0.2, "weak").otherwise("very weak")
    return impacts.groupBy(name.alias("strength_class")).agg(F.count("*").alias("paths"))


def related(nodes: DataFrame, neighbours: DataFrame, text: str) -> DataFrame:
    """Nodes whose label, type or name holds the text, in any case, and their neighbours: graph_id, id."""
    t = text.lower()
    hit = nodes.where(F.lower("label").contains(t) | F.lower("type").contains(t) | F.lower("name").contains(t)).select("graph_id", "id")
    return hit.unionByName(neighbours.join(hit, ["graph_id", "id"], "left_semi").select("graph_id", F.col("neighbour").alias("id"))).distinct()


def tree_layout(impacts: DataFrame, width: float = 800.0, gap: float = 100.0) -> DataFrame:
    """A tree under each root: a node's parent is the one before it on its path, rows are distances, and nodes of a row go by
    parent, so that branches stay together."""
    x = impacts.withColumn("parent", F.when(F.size("path") > 1, F.col("path")[F.size("path") - 2]))
    by = ["graph_id", "root", "distance"]
    d = row_numbers(x, [F.asc("parent"), F.asc("id")], "_i", by).join(x.groupBy(*by).agg(F.count("*").alias("_n")), by)
    return d.select("graph_id", "root", "id", "parent", *_xy(width * F.col("_i") / (F.col("_n") + 1), gap * (F.col("distance") + 1)))


def strongest(impacts: DataFrame, k: int = 20) -> DataFrame:
    """The k strongest paths over all roots, with their number of hops."""
    return impacts.orderBy(F.desc("strength"), "graph_id", "root", "id").limit(k).select("graph_id", "root", "id", "strength", (F.size("path") - 1).alias("hops"))

"""Impact of changes: scores, levels, critical paths, risk, grades and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from graphloom.operators.traverse import reach, steps
from graphloom.plans.rank import row_numbers
from graphloom.schema import GRADE_TYPE, IMPACT_LEVELS, NODE_COEFFICIENT, OTHER_COEFFICIENT, graded, lookup


#: Kinds of change.
CHANGES = ("MODIFY", "DELETE", "RENAME", "ADD", "MOVE")


def level(score: Column) -> Column:
    return graded(score, IMPACT_LEVELS, "NONE")


def impact(nodes: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int = 5, upstream: bool = True, downstream: bool = True, edge_types: list[str] | None = None, change: str = "MODIFY") -> DataFrame:
    """Nodes affected by a change of each root: graph_id, root, id, type, score, distance, level, role, strength, path.

    Downstream nodes depend on the root (in-neighbours) and count from a score above 0.1; upstream nodes are what it
    depends on, one level less deep (after a DELETE one level is added first, up to 6), at 0.7 of the score, from above
    0.05. An unknown kind of change is an error. A node reached both ways keeps its greatest
    score and least distance. Unknown types count with the coefficient of others; a null strength is 0.5.
    """
    if change not in CHANGES:
        raise ValueError(f"unknown kind of change: {change}")
    parts, up = [], max(1, (min(max_depth + 1, 6) if change == "DELETE" else max_depth) - 1)
    if downstream:
        parts.append((reach(steps(edges, "in", edge_types), roots, max_depth), "downstream", 1.0, 0.1))
    if upstream and max_depth >= 1:
        parts.append((reach(steps(edges, "out", edge_types), roots, up), "upstream", 0.7, 0.05))
    kinds = nodes.select("graph_id", "id", "type")
    out = None
    for found, role, factor, least in parts:
        score = F.least(F.lit(1.0), F.col("strength") / (1 + 0.3 * F.col("distance")) * lookup(NODE_COEFFICIENT, F.col("type"), OTHER_COEFFICIENT)) * factor
        rows = found.where("distance > 0").join(kinds, ["graph_id", "id"]).withColumn("score", score).where(F.col("score") > least).withColumn("role", F.lit(role))
        out = rows if out is None else out.unionByName(rows)
    best = F.max(F.struct("score", "role", "strength", "path")).alias("b")
    merged = out.groupBy("graph_id", "root", "id", "type").agg(best, F.min("distance").alias("distance"))
    return merged.select("graph_id", "root", "id", "type", F.round("b.score", 9).alias("score"), "distance", level(F.col("b.score")).alias("level"), "b.role", F.round("b.strength", 9).alias("strength"), "b.path")


def critical_paths(impacts: DataFrame, k: int = 10) -> DataFrame:
    """The k strongest paths to HIGH and CRITICAL nodes over all roots."""
    some = impacts.where(F.col("level").isin("HIGH", "CRITICAL"))
    return some.orderBy(F.desc("strength"), "graph_id", "root", "id").limit(k).select("graph_id", "root", "id", "path", "strength")


def level_summary(impacts: DataFrame) -> DataFrame:
    """Affected nodes per root and level, zeros included: one column a level."""
    names = ["NONE", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
    return impacts.groupBy("graph_id", "root").agg(*[F.count_if(F.col("level") == n).alias(n.lower()) for n in names], F.round(F.avg("score"), 6).alias("average"), F.max("distance").alias("max_depth"))


def change_risk(nodes: DataFrame, edges: DataFrame, change: str = "MODIFY") -> DataFrame:
    """Risk of a change for every node: base, connectivity, complexity, a constant history, the whole and its level."""
    e = edges.where("source_id <> target_id")
    near = lambda a, b, n: e.groupBy("graph_id", F.col(a).alias("id")).agg(F.countDistinct(b).alias(n))
    n = nodes.join(near("target_id", "source_id", "i"), ["graph_id", "id"], "left").join(near("source_id", "target_id", "o"), ["graph_id", "id"], "left")
    by_change = {"DELETE": 0.4, "RENAME": 0.3, "MODIFY": 0.2}.get(change, 0.0)
    base = F.least(F.lit(1.0), F.lit(0.3 + by_change) + F.when(F.col("type").isin("interface", "class"), 0.2).when(F.col("type").isin("module", "namespace"), 0.3).otherwise(0.0))
    links = F.coalesce("i", F.lit(0)) + F.coalesce("o", F.lit(0))
    connectivity = F.when(links >= 20, 0.9).when(links >= 10, 0.7).when(links >= 5, 0.5).when(links >= 2, 0.3).otherwise(0.1)
    c = F.coalesce("complexity", F.lit(1))
    complexity = F.when(c >= 20, 0.9).when(c >= 10, 0.7).when(c >= 5, 0.5).otherwise(0.2)
    total = F.round(0.3 * base + 0.4 * connectivity + 0.2 * complexity + F.lit(0.1 * 0.3), 9)
    named = graded(total, [(x, n.lower()) for x, n in IMPACT_LEVELS], "minimal")
    return n.select("graph_id", "id", F.round(base, 6).alias("base"), connectivity.alias("connectivity"), complexity.alias("complexity_risk"), total.alias("risk"), named.alias("risk_level"))


def recommendations(risks: DataFrame) -> DataFrame:
    """Advice for each node as a list of words for what to do."""
    r = F.col("risk_level")
    tips = F.array_compact(F.array(
        F.when(r.isin("critical", "high"), "review before the change"), F.when(r.isin("critical", "high", "medium"), "test the dependents"),
        F.when(F.col("connectivity") >= 0.7, "split the change"), F.when(F.col("complexity_risk") >= 0.7, "simplify first"),
    ))
    return risks.select("graph_id", "id", tips.alias("recommendations"))


def grade(impacts: DataFrame, connections: DataFrame | None = None) -> DataFrame:
    """Grades: weighted mean of score 0.4, distance 0.2, type 0.2 and connectivity 0.2, each within its root.

    connections: graph_id, id, connections; without it connectivity counts 0.5.
    """
    w = ["graph_id", "root"]
    top = impacts.groupBy(*w).agg(F.max("distance").alias("_d"))
    x = impacts.join(top, w)
    if connections is not None:
        x = x.join(connections, ["graph_id", "id"], "left")
        x = x.join(x.groupBy(*w).agg(F.max("connections").alias("_c")), w)
        linked = F.when(F.col("_c") > 0, F.coalesce("connections", F.lit(0)) / F.col("_c")).otherwise(0.5)
    else:
        linked = F.lit(0.5)
    near = F.when(F.col("_d") > 0, 1 - F.col("distance") / F.col("_d")).otherwise(1.0)
    kind = lookup(GRADE_TYPE, F.col("type"), 0.5)
    g = F.round(0.4 * F.col("score") + 0.2 * near + 0.2 * kind + 0.2 * linked, 9)
    return x.select(*w, "id", "type", "level", "score", "distance", F.round(near, 6).alias("near"), kind.alias("kind"), F.round(linked, 6).alias("linked"), g.alias("grade_score"), level(g).alias("grade"))


def ranked(grades: DataFrame, primary: str = "grade_score", secondary: str = "score", descending: bool = True) -> DataFrame:
    """Rank over all grades; one direction for both keys, the rest by id."""
    one = F.desc if descending else F.asc
    return row_numbers(grades, [one(primary), one(secondary), F.asc("graph_id"), F.asc("root"), F.asc("id")])


def distribution(grades: DataFrame) -> DataFrame:
    """Per grade: count, percent, mean, greatest and least score."""
    total = grades.agg(F.count("*").alias("n")).scalar()
    return grades.groupBy("grade").agg(F.count("*").alias("n"), F.round(F.avg("grade_score"), 6).alias("mean"), F.max("grade_score").alias("max"), F.min("grade_score").alias("min")).withColumn("percent", F.round(100 * F.col("n") / total, 6))


def transitions(grades: DataFrame) -> DataFrame:
    """Level before to grade after, with counts."""
    return grades.groupBy("level", "grade").agg(F.count("*").alias("n"))


def criteria_ranking(grades: DataFrame) -> DataFrame:
    """One ranking per criterion and root: criterion, id, value, rank."""
    long = grades.select("graph_id", "root", "id", F.expr("stack(4, 'score', score, 'near', near, 'kind', kind, 'linked', linked) AS (criterion, value)"))
    return row_numbers(long, [F.desc("value"), F.asc("id")], by=["graph_id", "root", "criterion"])


def top_by_root(impacts: DataFrame, k: int = 3) -> DataFrame:
    """The k strongest nodes of each root, kept apart by their root."""
    w = W.partitionBy("graph_id", "root").orderBy(F.desc("score"), "id")
    return impacts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("graph_id", "root", "id", "score", "rank")

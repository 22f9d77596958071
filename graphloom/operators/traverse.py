"""Traversals as loops of joins, one level a round, cut by checkpoints."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from graphloom.operators import whole as in_tasks
from graphloom.operators.clean import small
from graphloom.operators.whole import GRAPH_EDGES, by_graph, by_part
from graphloom.schema import HOP_WEIGHT, OTHER_HOP, lookup
from graphloom.session import forget, scratch_counted, scratch_table as checkpoint

KEY = ["graph_id", "root", "id"]
#: Edges left up to which one task finishes the strong components of a graph.
WHOLE = 200_000


def steps(edges: DataFrame, direction: str = "out", edge_types: list[str] | None = None) -> DataFrame:
    """graph_id, id, next and the edge's own columns, along, against or both ways of the edges. A null strength counts 0.5
    in products (strength) and 1.0 in sums (weight)."""
    e = edges.where(F.col("type").isin(edge_types)) if edge_types else edges
    e = e.select("graph_id", "source_id", "target_id", F.col("id").alias("edge_id"), "type", F.coalesce("strength", F.lit(0.5)).alias("strength"), F.coalesce("strength", F.lit(1.0)).alias("weight"))
    out = e.withColumnsRenamed({"source_id": "id", "target_id": "next"})
    back = e.withColumnsRenamed({"target_id": "id", "source_id": "next"}).select(out.columns)
    return {"out": out, "in": back}.get(direction, None) if direction != "both" else out.unionByName(back)


def reach(step: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """Nodes within max_depth hops of each root: graph_id, root, id, distance, strength, path.

    strength is the greatest product of hop weights among the shortest paths, path the one that has it (the greatest in
    order on ties). roots: graph_id, root. Parallel edges count as their strongest. A frontier is broadcast only if a
    count shows that it is small; else the join shuffles, and AQE splits hubs.
    """
    hop = step.groupBy("graph_id", "id", "next").agg(F.max(lookup(HOP_WEIGHT, F.col("type"), OTHER_HOP) * F.col("strength")).alias("w")).where("id <> next")
    seen = checkpoint(roots.select("graph_id", "root", F.col("root").alias("id"), F.lit(0).alias("distance"), F.lit(1.0).alias("strength"), F.array("root").alias("path")).distinct())
    front, n = seen, None
    for d in range(1, max_depth + 1):
        best = F.max(F.struct((F.col("strength") * F.col("w")).alias("strength"), F.concat("path", F.array("next")).alias("path")))
        new = hop.join(small(front, n), ["graph_id", "id"]).groupBy("graph_id", "root", F.col("next").alias("id")).agg(best.alias("b")).select("graph_id", "root", "id", F.lit(d).alias("distance"), "b.strength", "b.path")
        front, n = scratch_counted(new.join(seen.select(*KEY), KEY, "left_anti"), F.lit(True))
        if not n:
            break
        seen = seen.unionByName(front)
    return seen


def shortest(step: DataFrame, roots: DataFrame, max_nodes: int = 10, join: str | None = None, whole: int = GRAPH_EDGES, digits: int = 9) -> DataFrame:
    """Shortest paths of at most max_nodes nodes from each root to every node: graph_id, root, target, length, total_weight
    (sum of the strengths, null is 1.0, to 9 digits, then to ``digits``) and path (a list, or joined to a text), the first in
    order on ties.

    A root reaches itself in a path of length 0. Of parallel edges the one of least id counts. The rows grow with the roots
    times the nodes, so graphs of at most ``whole`` edges are walked by tasks that write none; larger ones by joins.
    """
    hop = checkpoint(step.where("id <> next").groupBy("graph_id", "id", "next").agg(F.min_by("weight", "edge_id").alias("w")))
    roots = checkpoint(roots.select("graph_id", "root").distinct())
    large = checkpoint(hop.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") > whole).select("graph_id"))
    schema = f"root string, target string, length int, total_weight double, path {'array<string>' if join is None else 'string'}"
    if not large.take(1):
        return by_graph(hop, roots, in_tasks.shortest(max_nodes, join, digits), schema)
    rest = by_graph(hop.join(large, "graph_id", "left_anti"), roots.join(large, "graph_id", "left_anti"), in_tasks.shortest(max_nodes, join, digits), schema)
    loop = _shortest_loop(hop.join(large, "graph_id", "left_semi"), roots.join(large, "graph_id", "left_semi"), max_nodes)
    loop = loop.withColumn("total_weight", F.round("total_weight", digits))
    return rest.unionByName(loop if join is None else loop.withColumn("path", F.array_join("path", join)))


def _shortest_loop(hop: DataFrame, roots: DataFrame, max_nodes: int) -> DataFrame:
    seen = checkpoint(roots.select("graph_id", "root", F.col("root").alias("id"), F.lit(0).alias("length"), F.lit(0.0).alias("weight"), F.array("root").alias("path")))
    front, n = seen, None
    for d in range(1, max_nodes):
        best = F.min(F.struct(F.concat("path", F.array("next")).alias("path"), (F.col("weight") + F.col("w")).alias("weight")))
        new = hop.join(small(front, n), ["graph_id", "id"]).groupBy("graph_id", "root", F.col("next").alias("id")).agg(best.alias("b")).select("graph_id", "root", "id", F.lit(d).alias("length"), "b.weight", "b.path")
        front, n = scratch_counted(new.join(seen.select(*KEY), KEY, "left_anti"), F.lit(True))
        if not n:
            break
        seen = seen.unionByName(front)
    return seen.select("graph_id", "root", F.col("id").alias("target"), "length", F.round("weight", 9).alias("total_weight"), "path")


def hops_to(step: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """graph_id, id and the least number of hops (at most ``most``) from there to any target."""
    seen = checkpoint(targets.select("graph_id", "id").distinct().withColumn("left", F.lit(0)))
    front, n = seen, None
    for d in range(1, most + 1):
        new = step.select("graph_id", "id", "next").join(small(front.select("graph_id", F.col("id").alias("next")), n), ["graph_id", "next"], "left_semi").select("graph_id", "id").distinct().join(seen, ["graph_id", "id"], "left_anti")
        front, n = scratch_counted(new.withColumn("left", F.lit(d)), F.lit(True))
        if not n:
            break
        seen = seen.unionByName(front)
    return checkpoint(seen)


def paths(step: DataFrame, roots: DataFrame, targets: DataFrame, max_nodes: int = 5, max_paths: int | None = None, join: str | None = None, whole: int = GRAPH_EDGES) -> DataFrame:
    """All simple paths of at most max_nodes nodes from roots to targets: graph_id, root, target, path, length,
    total_weight (sum of strengths, null is 1.0), strength (product of hop weights) and types (of the hops).

    Parallel edges give rows of their own; a target ends a path. targets: graph_id, target. With max_paths the first so
    many of each root and target by length, weight and path. A path goes on only where a target is near enough. With join,
    path is a text joined by it and types one joined by blanks. Graphs of at most ``whole`` edges are walked by tasks that
    write none; larger ones by joins.
    """
    hop = lookup(HOP_WEIGHT, F.col("type"), OTHER_HOP) * F.col("strength")
    edges = checkpoint(step.where("id <> next").select("graph_id", "id", "next", F.col("weight").alias("w"), hop.alias("product"), "type"))
    start = checkpoint(roots.select("graph_id", "root").distinct())
    goal = checkpoint(targets.select("graph_id", F.col("target").alias("id")).distinct())
    large = checkpoint(edges.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") > whole).select("graph_id"))
    kinds = ("array<string>", "array<string>") if join is None else ("string", "string")
    schema = f"root string, target string, path {kinds[0]}, length int, total_weight double, strength double, types {kinds[1]}"
    walk = in_tasks.paths(max_nodes, max_paths, join)
    if not large.take(1):
        return by_graph(edges, start, walk, schema, goal)
    rest = by_graph(edges.join(large, "graph_id", "left_anti"), start.join(large, "graph_id", "left_anti"), walk, schema, goal.join(large, "graph_id", "left_anti"))
    some = [df.join(large, "graph_id", "left_semi") for df in (step, roots, targets)]
    loop = _paths_loop(*some, max_nodes, max_paths)
    return rest.unionByName(loop if join is None else loop.withColumns({"path": F.array_join("path", join), "types": F.array_join("types", " ")}))


def _paths_loop(step: DataFrame, roots: DataFrame, targets: DataFrame, max_nodes: int, max_paths: int | None) -> DataFrame:
    goal = targets.select("graph_id", F.col("target").alias("id")).distinct().withColumn("_goal", F.lit(True))
    left = hops_to(step, goal, max_nodes - 1)
    at = roots.select("graph_id", "root", F.col("root").alias("id"), F.array("root").alias("path"), F.lit(0.0).alias("weight"), F.lit(1.0).alias("product"), F.expr("CAST(array() AS array<string>)").alias("types"))
    front = checkpoint(at.distinct().join(left.select("graph_id", "id"), ["graph_id", "id"], "left_semi"))
    found = front.join(goal, ["graph_id", "id"], "left_semi")
    front = front.join(goal, ["graph_id", "id"], "left_anti")
    hop = lookup(HOP_WEIGHT, F.col("type"), OTHER_HOP) * F.col("strength")
    more = None
    near = step.join(left.select("graph_id", F.col("id").alias("next"), "left"), ["graph_id", "next"]).withColumnRenamed("weight", "_w")
    for n in range(1, max_nodes):
        new = near.where(F.col("left") <= max_nodes - 1 - n).join(small(front, more), ["graph_id", "id"]).where(~F.array_contains("path", F.col("next")))
        new = new.select(
            "graph_id", "root", F.col("next").alias("id"), F.concat("path", F.array("next")).alias("path"), (F.col("weight") + F.col("_w")).alias("weight"),
            (F.col("product") * hop).alias("product"), F.concat("types", F.array("type")).alias("types"),
        )
        new, more = scratch_counted(new.join(goal, ["graph_id", "id"], "left"), F.col("_goal").isNull())
        found = found.unionByName(new.where("_goal").select(found.columns))
        front = new.where("_goal IS NULL").drop("_goal")
        if not more:
            break
    out = found.select("graph_id", "root", F.col("id").alias("target"), "path", (F.size("path") - 1).alias("length"), F.round("weight", 9).alias("total_weight"), F.round("product", 9).alias("strength"), "types")
    if max_paths is None:
        return out
    # a row number under a limit is cut before the shuffle, so the paths of a pair don't meet in one task
    order = W.partitionBy("graph_id", "root", "target").orderBy("length", "total_weight", "path", "types")
    return out.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_paths).drop("_n")


def cycles(edges: DataFrame, max_nodes: int = 4, edge_types: list[str] | None = None, join: str | None = None, whole: int = GRAPH_EDGES) -> DataFrame:
    """All simple cycles of 2 to max_nodes nodes, starting and ending at their least node: graph_id, cycle, length.

    Only edges within a strong component can lie on a cycle. With join, cycle is a text joined by it. Graphs of at most
    ``whole`` such edges are walked by tasks that write no paths; larger ones by joins.
    """
    some = edges.where(F.col("type").isin(edge_types)) if edge_types else edges
    some = checkpoint(some.where("source_id <> target_id").select("graph_id", "source_id", "target_id").distinct())
    part = strong_components(some)
    e = some.select("graph_id", F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    for c in "ab":
        e = e.join(part.select("graph_id", F.col("id").alias(c), F.col("component").alias(f"c{c}")), ["graph_id", c])
    e = instead(e.where("ca = cb").select("graph_id", "a", "b"), some, part)
    large = checkpoint(e.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") > whole).select("graph_id"))
    walk, schema = in_tasks.cycles(max_nodes, join), f"cycle {'array<string>' if join is None else 'string'}, length int"
    step = e.withColumnsRenamed({"a": "id", "b": "next"})
    if not large.take(1):
        forget(large)
        return by_part(step, walk, schema)
    loop = _cycles_loop(e.join(large, "graph_id", "left_semi"), max_nodes)
    loop = loop if join is None else loop.withColumn("cycle", F.array_join("cycle", join))
    return by_part(step.join(large, "graph_id", "left_anti"), walk, schema).unionByName(loop)


def instead(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """A scratch table in the place of those that nothing but ``df`` reads."""
    out = checkpoint(df)
    forget(*tables)
    return out


def _cycles_loop(edges: DataFrame, max_nodes: int) -> DataFrame:
    """From each start, half of a cycle is walked along the edges and half against them, over greater nodes; halves that meet
    in one node and share no other make a cycle, each once. edges: graph_id, a, b."""
    e = checkpoint(edges)
    ahead = [checkpoint(e.where("b > a").select("graph_id", F.col("a").alias("start"), F.col("b").alias("at"), F.array("a", "b").alias("path")))]
    back = [checkpoint(e.where("a > b").select("graph_id", F.col("b").alias("start"), F.col("a").alias("at"), F.array("a").alias("rest")))]
    free = lambda way: (F.col("next") > F.col("start")) & ~F.array_contains(way, F.col("next"))
    out = None
    for n in range(2, max_nodes + 1):
        half = (n + 1) // 2
        if len(ahead) < half:
            new = ahead[-1].join(e.select("graph_id", F.col("a").alias("at"), F.col("b").alias("next")), ["graph_id", "at"]).where(free("path"))
            ahead.append(checkpoint(new.select("graph_id", "start", F.col("next").alias("at"), F.concat("path", F.array("next")).alias("path"))))
        if len(back) < n - half:
            new = back[-1].join(e.select("graph_id", F.col("b").alias("at"), F.col("a").alias("next")), ["graph_id", "at"]).where(free("rest"))
            back.append(checkpoint(new.select("graph_id", "start", F.col("next").alias("at"), F.concat(F.array("next"), "rest").alias("rest"))))
        both = ahead[half - 1].join(back[n - half - 1], ["graph_id", "start", "at"]).withColumn("rest", F.expr("slice(rest, 2, size(rest))"))
        closed = both.where(~F.arrays_overlap("path", "rest")).select("graph_id", F.concat("path", "rest", F.array("start")).alias("cycle"))
        out = closed if out is None else out.unionByName(closed)
    return out.select("graph_id", "cycle", (F.size("cycle") - 1).alias("length"))


def _tarjan(edges: pd.DataFrame) -> pd.DataFrame:
    """Strong components of more than one node of one graph: graph_id, id, c (the greatest id in it)."""
    codes, ids = pd.factorize(pd.concat([edges["a"], edges["b"]], ignore_index=True))
    after: list[list[int]] = [[] for _ in ids]
    for a, b in zip(codes[: len(edges)].tolist(), codes[len(edges) :].tolist()):
        after[a].append(b)
    low, order, n = [0] * len(ids), [0] * len(ids), 0  # low is 0 off the stack, order before the visit
    stack, out = [], []
    for start in range(len(ids)):
        if order[start]:
            continue
        n += 1
        low[start] = order[start] = n
        stack.append(start)
        walk = [(start, iter(after[start]))]
        while walk:
            v, rest = walk[-1]
            for w in rest:
                if not order[w]:
                    n += 1
                    low[w] = order[w] = n
                    stack.append(w)
                    walk.append((w, iter(after[w])))
                    break
                if low[w] and order[w] < low[v]:
                    low[v] = order[w]
            else:
                walk.pop()
                if walk and low[v] < low[walk[-1][0]]:
                    low[walk[-1][0]] = low[v]
                if low[v] == order[v]:
                    own = [stack.pop()]
                    while own[-1] != v:
                        own.append(stack.pop())
                    for w in own:
                        low[w] = 0
                    if len(own) > 1:
                        most = max(ids[w] for w in own)
                        out += [(ids[w], most) for w in own]
    found = pd.DataFrame(out, columns=["id", "c"], dtype=object)
    found.insert(0, "graph_id", edges["graph_id"].iloc[0])
    return found


def strong_components(edges: DataFrame, whole: int = WHOLE) -> DataFrame:
    """Strongly connected components of more than one node: graph_id, id, component (the least id in it).

    Colouring: labels of the greatest ancestor spread forward; within a colour, nodes that reach its root backward form
    one component and leave; edges between colours are cut. Nodes without a way in or out are trimmed first. A round
    takes one component a colour, so a graph that has at most ``whole`` edges left is finished by Tarjan's algorithm in
    one task; the loop ends when no edges are left.
    """
    e = checkpoint(edges.where("source_id <> target_id").select("graph_id", F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct())
    done = None
    while True:
        few = checkpoint(e.groupBy("graph_id").agg(F.count("*").alias("n")).where(F.col("n") <= whole).select("graph_id"))
        if few.take(1):
            own = checkpoint(e.join(few, "graph_id", "left_semi").groupBy("graph_id").applyInPandas(_tarjan, "graph_id string, id string, c string"))
            done = own if done is None else done.unionByName(own)
            e = instead(e.join(few, "graph_id", "left_anti"), e)
        forget(few)
        size = e.count()
        while size:  # trim
            e2 = checkpoint(e.join(e.select("graph_id", F.col("b").alias("a")).distinct(), ["graph_id", "a"], "left_semi").join(e.select("graph_id", F.col("a").alias("b")).distinct(), ["graph_id", "b"], "left_semi"))
            left = e2.count()
            forget(e)
            e = e2
            if left == size:
                break
            size = left
        if not size:
            break
        colour = checkpoint(e.select("graph_id", F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("c", F.col("id")))
        while True:
            near = e.join(colour.select("graph_id", F.col("id").alias("a"), "c"), ["graph_id", "a"]).groupBy("graph_id", F.col("b").alias("id")).agg(F.max("c").alias("m"))
            new = checkpoint(colour.join(near, ["graph_id", "id"], "left").select("graph_id", "id", F.greatest("c", F.coalesce("m", "c")).alias("c"), (F.col("m") > F.col("c")).alias("changed")))
            forget(colour)
            colour = new.drop("changed")
            if not new.where("changed").take(1):
                break
        ca, cb = colour.select("graph_id", F.col("id").alias("a"), F.col("c").alias("ca")), colour.select("graph_id", F.col("id").alias("b"), F.col("c").alias("cb"))
        e = instead(e.join(ca, ["graph_id", "a"]).join(cb, ["graph_id", "b"]).where("ca = cb").select("graph_id", "a", "b", F.col("ca").alias("c")), e)
        own = front = colour.where("id = c").select("graph_id", "id", "c")
        while True:
            back = e.join(front.select("graph_id", F.col("id").alias("b")), ["graph_id", "b"]).select("graph_id", F.col("a").alias("id"), "c").distinct().join(own, ["graph_id", "id"], "left_anti")
            front = checkpoint(back)
            if not front.take(1):
                break
            own = own.unionByName(front)
        own = instead(own, colour, own, front)
        done = own if done is None else done.unionByName(own)
        e = instead(e.select("graph_id", "a", "b").join(own.select("graph_id", F.col("id").alias("a")), ["graph_id", "a"], "left_anti").join(own.select("graph_id", F.col("id").alias("b")), ["graph_id", "b"], "left_anti"), e)
    forget(e)
    if done is None:
        return edges.select("graph_id", F.col("source_id").alias("id"), F.col("source_id").alias("component")).limit(0)
    least = done.groupBy("graph_id", "c").agg(F.min("id").alias("component"), F.count("*").alias("n")).where("n > 1")
    return done.join(least, ["graph_id", "c"]).select("graph_id", "id", "component")

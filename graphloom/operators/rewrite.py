"""Graph rewrites: duplicates, similar nodes, isolated nodes, parallel edges, chains, components, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.session import forget, scratch_counted, scratch_table as checkpoint


def duplicate_map(nodes: DataFrame) -> DataFrame:
    """graph_id, id and the id that stands for it: the least among nodes of equal signature."""
    key = ["graph_id", "label", "type", "name", "file_path", "line_number"]
    n = nodes.withColumns({c: F.coalesce(c, F.lit(-1 if c == "line_number" else "")) for c in key[1:]})
    keep = n.groupBy(*key).agg(F.min("id").alias("keep"))
    return n.join(keep, key).select("graph_id", "id", "keep")


def remap(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with ends replaced through (graph_id, id, keep)."""
    out = edges
    for c in ("source_id", "target_id"):
        out = out.join(ids.select("graph_id", F.col("id").alias(c), F.col("keep").alias("_k")), ["graph_id", c], "left").withColumn(c, F.coalesce("_k", c)).drop("_k")
    return out


def remove_duplicates(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of one signature become the one with the least id; edges follow and stay unique by (source, target, type)."""
    ids = duplicate_map(nodes)
    kept = nodes.join(ids.where("id = keep").select("graph_id", "id"), ["graph_id", "id"], "left_semi")
    own = remap(edges, ids).groupBy("graph_id", "source_id", "target_id", "type").agg(F.min("id").alias("id"), F.max("strength").alias("strength"))
    return kept, own


def connected_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes on any edge."""
    ends = edges.select("graph_id", F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    return nodes.join(ends, ["graph_id", "id"], "left_semi")


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge per (source, target) whatever the type: that of greatest strength (null is 0.5; least id on ties),
    summed calls, joined contexts, strength raised by 0.1 for each further edge up to 1."""
    s = F.coalesce("strength", F.lit(0.5))
    best = F.min_by(F.struct("id", "type"), F.struct((-s).alias("s"), "id"))
    out = edges.groupBy("graph_id", "source_id", "target_id").agg(best.alias("b"), F.max(s).alias("s"), F.sum(F.coalesce("call_count", F.lit(1))).alias("call_count"), F.count("*").alias("merged"), F.array_join(F.array_sort(F.collect_set("context")), "; ").alias("context"))
    return out.select("graph_id", "source_id", "target_id", "b.id", "b.type", F.round(F.least(F.lit(1.0), F.col("s") + 0.1 * (F.col("merged") - 1)), 9).alias("strength"), "call_count", "merged", "context")


def similar(a, b):
    """Names that differ by at most two edits, or of which one begins or ends the other; empty names are similar to none."""
    near = F.levenshtein(F.lower(a), F.lower(b), 2) >= 0
    return (F.length(a) > 0) & (F.length(b) > 0) & (near | a.startswith(b) | b.startswith(a) | a.endswith(b) | b.endswith(a))


def similar_seeds(nodes: DataFrame) -> DataFrame:
    """For each node the smallest node of its graph, type and file (or label) that is similar to it and no one's follower.

    Nodes go by id; a seed is similar to no earlier seed of its block; every other node joins its earliest seed. Blocks
    are files and labels, which bounds the pairs that are compared. Returned: graph_id, id, keep.
    """
    a = nodes.select("graph_id", "type", "file_path", F.col("id").alias("keep"), F.col("name").alias("n1"), F.col("label").alias("l1"))
    b = nodes.select("graph_id", "type", "file_path", "id", F.col("name").alias("n2"), F.col("label").alias("l2"))
    pairs = a.join(b, ["graph_id", "type", "file_path"]).where((F.col("keep") < F.col("id")) & ((F.col("l1") == F.col("l2")) | similar(F.col("n1"), F.col("n2")))).select("graph_id", "keep", "id")
    same = a.select("graph_id", "type", F.col("l1").alias("label"), "keep").groupBy("graph_id", "type", "label").agg(F.min("keep").alias("keep"))
    by_label = nodes.join(same, ["graph_id", "type", "label"]).where("keep < id").select("graph_id", "keep", "id")
    open_pairs = checkpoint(pairs.unionByName(by_label).distinct())
    done = None
    while open_pairs.take(1):
        # nodes that no open pair puts after another are seeds; they take what is similar to them
        seeds = open_pairs.select("graph_id", F.col("keep").alias("id")).distinct().join(open_pairs.select("graph_id", "id").distinct(), ["graph_id", "id"], "left_anti")
        taken = open_pairs.join(seeds.withColumnRenamed("id", "keep"), ["graph_id", "keep"], "left_semi").groupBy("graph_id", "id").agg(F.min("keep").alias("keep"))
        taken = checkpoint(taken)
        done = taken if done is None else done.unionByName(taken)
        gone = taken.select("graph_id", "id")
        rest = open_pairs.join(gone, ["graph_id", "id"], "left_anti").join(gone.withColumnRenamed("id", "keep"), ["graph_id", "keep"], "left_anti")
        open_pairs = checkpoint(rest.join(seeds.withColumnRenamed("id", "keep"), ["graph_id", "keep"], "left_anti"))
    alone = nodes.select("graph_id", "id", F.col("id").alias("keep"))
    if done is None:
        return alone
    return done.select("graph_id", "id", "keep").unionByName(alone.join(done, ["graph_id", "id"], "left_anti"))


def linear_chains(edges: DataFrame, rounds: int = 62) -> DataFrame:
    """Chains of at least three nodes whose interior has one way in and one way out: graph_id, head, tail, edges (their number).

    A head has one way out and isn't the only follower of a node with one way out. Pointer doubling over interior nodes:
    the rounds grow with the logarithm of the longest chain. Pure cycles have no head and stay: after 2^rounds nodes, more
    than any table holds, only they are left.
    """
    on = ["graph_id", "id"]
    e = edges.select("graph_id", "source_id", "target_id").distinct()
    ways = e.groupBy("graph_id", F.col("source_id").alias("id")).agg(F.count("*").alias("o"), F.min("target_id").alias("next")).where("o = 1")
    only = e.groupBy("graph_id", F.col("target_id").alias("id")).agg(F.count("*").alias("i")).where("i = 1")
    inner = ways.join(only, on, "left_semi").select(*on, "next")
    heads = ways.join(inner.join(ways.select("graph_id", F.col("next").alias("id")), on, "left_semi"), on, "left_anti")
    jump = checkpoint(inner.select(*on, F.col("next").alias("far"), F.lit(1).alias("n")))
    # a node that still moves after more steps than there are nodes lies on or before a pure cycle
    for _ in range(min(rounds, jump.count().bit_length() + 1)):
        far = jump.select("graph_id", F.col("id").alias("far"), F.col("far").alias("far2"), F.col("n").alias("n2"))
        new = jump.join(far, ["graph_id", "far"], "left")
        new = checkpoint(new.select(*on, F.coalesce("far2", "far").alias("far"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.col("far2").isNotNull().alias("moved")))
        jump = new.drop("moved")
        if not new.where("moved").take(1):
            break
    chains = heads.select("graph_id", F.col("id").alias("head"), F.col("next").alias("id")).join(jump, on)
    return chains.select("graph_id", "head", F.col("far").alias("tail"), (F.col("n") + 1).alias("edges"))


def compress_chains(edges: DataFrame) -> DataFrame:
    """Edges with each chain replaced by one from head to tail, which keeps the first edge's id and type."""
    chains = linear_chains(edges)
    e = edges.select("graph_id", "id", "source_id", "target_id", "type")
    first = e.join(chains.select("graph_id", F.col("head").alias("source_id"), "tail", "edges"), ["graph_id", "source_id"])
    new = first.select("graph_id", "id", "source_id", F.col("tail").alias("target_id"), "type", F.lit(True).alias("compressed_chain"), (F.col("edges") + 1).cast("long").alias("original_length"))
    # edges out of an interior node of a chain with a head go
    deg_in = e.select("graph_id", "source_id", "target_id").distinct().groupBy("graph_id", F.col("target_id").alias("id")).agg(F.count("*").alias("i"))
    deg_out = e.select("graph_id", "source_id", "target_id").distinct().groupBy("graph_id", F.col("source_id").alias("id")).agg(F.count("*").alias("o"))
    inner = deg_in.join(deg_out, ["graph_id", "id"]).where("i = 1 AND o = 1").select("graph_id", "id")
    cyclic = components(inner, e.join(inner.withColumnRenamed("id", "source_id"), ["graph_id", "source_id"], "left_semi").join(inner.withColumnRenamed("id", "target_id"), ["graph_id", "target_id"], "left_semi"))
    entered = e.join(chains.select("graph_id", F.col("head").alias("source_id")), ["graph_id", "source_id"], "left_semi").select("graph_id", F.col("target_id").alias("id"))
    gone = cyclic.join(cyclic.join(entered, ["graph_id", "id"], "left_semi").select("graph_id", "component").distinct(), ["graph_id", "component"], "left_semi")
    gone = gone.select("graph_id", F.col("id").alias("source_id")).unionByName(chains.select("graph_id", F.col("head").alias("source_id"))).distinct()
    kept = e.join(gone, ["graph_id", "source_id"], "left_anti").select("*", F.lit(False).alias("compressed_chain"), F.lit(None).cast("long").alias("original_length"))
    return kept.unionByName(new)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Weak components per graph: graph_id, id, component (the least id in it).

    Labels fall to the least of the neighbours'; what a node learns is passed on to the node that its label names
    (hooking), and labels are replaced by their own labels (shortcut), so rounds are few. The loop ends when nothing
    changes. The minimum is combined before each shuffle, so hubs are no hot spot. Ends without a node take part.
    """
    ends = edges.select("graph_id", F.explode(F.array(F.struct(F.col("source_id").alias("a"), F.col("target_id").alias("b")), F.struct(F.col("target_id").alias("a"), F.col("source_id").alias("b")))).alias("p")).select("graph_id", "p.a", "p.b").where("a <> b").distinct()
    ends = checkpoint(ends)
    label = nodes.select("graph_id", "id").unionByName(ends.select("graph_id", F.col("a").alias("id"))).distinct().withColumn("component", F.col("id"))
    label = checkpoint(label)
    while True:
        near = ends.join(label.select("graph_id", F.col("id").alias("b"), "component"), ["graph_id", "b"]).groupBy("graph_id", F.col("a").alias("id")).agg(F.min("component").alias("c"))
        low, lower = scratch_counted(label.join(near, ["graph_id", "id"], "left").select("graph_id", "id", "component", F.least("component", F.coalesce("c", "component")).alias("c")), F.col("c") < F.col("component"))
        if not lower:  # no neighbour has a lower label, so none will fall
            forget(low)
            return label
        hook = low.where("c < component").groupBy("graph_id", F.col("component").alias("id")).agg(F.min("c").alias("h"))
        hooked = checkpoint(low.join(hook, ["graph_id", "id"], "left").select("graph_id", "id", F.least("c", F.coalesce("h", "c")).alias("c")))
        short = hooked.select("graph_id", F.col("id").alias("c"), F.col("c").alias("c2"))
        new = checkpoint(hooked.join(short, ["graph_id", "c"], "left").select("graph_id", "id", F.least("c", F.coalesce("c2", "c")).alias("component")))
        forget(label, low, hooked)
        label = new


def merge_graphs(nodes: list[DataFrame], edges: list[DataFrame], graph_id: str) -> tuple[DataFrame, DataFrame]:
    """The union of graphs as one graph, without duplicates."""
    n, e = nodes[0], edges[0]
    for x in nodes[1:]:
        n = n.unionByName(x)
    for x in edges[1:]:
        e = e.unionByName(x)
    return remove_duplicates(n.withColumn("graph_id", F.lit(graph_id)), e.withColumn("graph_id", F.lit(graph_id)))

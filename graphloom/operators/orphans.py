"""References to records that do not exist (problem 1).

A Bloom filter of all parent keys, sized from their number, proves most orphans at once; only the references that it
lets through are verified by an exact join with the parents' lifetimes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from graphloom.session import scratch_table

#: Bits of the filter for each parent, and the bits that a key sets: under 1 % of the missing keys pass, however many parents there are.
BITS_A_KEY, BLOOM_HASHES = 12, 4
#: The filter is broadcast up to this size; a larger one is joined by its blocks, where the references of each block lie.
BROADCAST_BYTES = 256 << 20
#: A key counts as hot if it holds at least this share of all references; so at most 1 / HOT_SHARE keys can be hot.
HOT_SHARE = 0.002
#: Parts into which the references of a hot key are spread.
SALTS = 32
#: Parents with more distinct lifetimes than this aren't put into one array but counted along time slices.
MAX_LIFETIMES = 64
_BLOCK = 32768  # bits of a block; all bits of a key lie in one
_WORDS = _BLOCK // 64


def clean_id(c: Column) -> Column:
    """Ids agree apart from letter case and from blanks or tabs at the ends; null and blank become null."""
    x = F.lower(F.regexp_replace(c, r"^[ \t]+|[ \t]+$", ""))
    return F.when(F.length(x) > 0, x)


def _places(blocks: int, hashes: int, *key: Column) -> tuple[Column, list[Column]]:
    """The block of a key and its bits there."""
    h = F.xxhash64(*key, F.lit(7))
    a, b = h.bitwiseAND(_BLOCK - 1), F.shiftright(h, 15).bitwiseAND(_BLOCK - 1).bitwiseOR(F.lit(1))
    return F.pmod(F.xxhash64(*key), F.lit(blocks)), [(a + F.lit(i) * b).bitwiseAND(_BLOCK - 1) for i in range(hashes)]


def bloom_filter(keys: DataFrame, cols: list[str], blocks: int, hashes: int = BLOOM_HASHES) -> DataFrame:
    """The filter as a table: _block and _words (its bits in longs). Executors combine bits before they are shuffled."""
    block, bits = _places(blocks, hashes, *cols)
    p = F.col("_p")
    set_ = keys.select(block.alias("_block"), F.explode(F.array(*bits)).alias("_p")).select("_block", F.shiftright(p, 6).alias("_word"), F.expr("shiftleft(1L, CAST(_p & 63 AS INT))").alias("_bits"))
    every = keys.sparkSession.range(blocks * _WORDS).select(F.floor(F.col("id") / _WORDS).alias("_block"), F.pmod("id", F.lit(_WORDS)).alias("_word"), F.lit(0).cast("long").alias("_bits"))
    words = set_.unionByName(every).groupBy("_block", "_word").agg(F.bit_or("_bits").alias("_bits"))
    return words.groupBy("_block").agg(F.array_sort(F.collect_list(F.struct("_word", "_bits"))).alias("_words")).select("_block", F.col("_words._bits").alias("_words"))


def might_contain(df: DataFrame, cols: list[str], keys: DataFrame, blocks: int, hashes: int = BLOOM_HASHES) -> DataFrame:
    """``df`` with _may, which is False where the filter of ``keys`` proves that the key isn't among them.

    The probe is a join with the filter's blocks: broadcast if they are small enough, which their number tells.
    """
    block, bits = _places(blocks, hashes, *cols)
    table = bloom_filter(keys, cols, blocks, hashes)
    hit = None
    for b in bits:
        one = F.call_function("getbit", F.get("_words", F.shiftright(b, 6)), b.bitwiseAND(63).cast("int")) == 1
        hit = one if hit is None else hit & one
    near = F.broadcast(table) if blocks * _BLOCK // 8 <= BROADCAST_BYTES else table
    return df.withColumn("_block", block).join(near, "_block", "left").withColumn("_may", hit).drop("_block", "_words")


def _counted(refs: DataFrame, parents: DataFrame, salted) -> DataFrame:
    """The status of references to keys with very many lifetimes, by running counts along (key, salt, month) slices.

    No list is built: a parent lives at t if more lifetimes began than ended until then. Each slice is one window
    group and gets the counts of the slices before it. Hot keys keep their salts, to each of which their lifetimes are
    copied by ``salted``.
    """
    cols = [c for c in refs.columns if c != "_salt"]
    begins = parents.where("begin IS NOT NULL").select("scope", "key", F.col("begin").alias("t"), F.lit(1).alias("_born"), F.lit(1).alias("_live"))
    ends = parents.where("begin IS NOT NULL AND end IS NOT NULL").select("scope", "key", F.greatest("begin", "end").alias("t"), F.lit(0).alias("_born"), F.lit(-1).alias("_live"))
    marks = salted(begins.unionByName(ends)).withColumn("_slice", F.date_trunc("month", "t"))
    both = refs.withColumn("_ref", F.lit(True)).withColumn("_slice", F.date_trunc("month", "t")).unionByName(marks, allowMissingColumns=True)
    sums = both.groupBy("scope", "key", "_salt", "_slice").agg(F.sum("_born").alias("_born0"), F.sum("_live").alias("_live0"))
    before = W.partitionBy("scope", "key", "_salt").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)  # one row a month
    carry = sums.select("scope", "key", "_salt", "_slice", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_born0", "_live0")])
    # at equal times lifetimes begin and end before a reference looks
    order = W.partitionBy("scope", "key", "_salt", "_slice").orderBy("t", F.col("_ref").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    run = both.select("*", *[F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"{c}_run") for c in ("_born", "_live")])
    known = run.where("_ref").join(carry, ["scope", "key", "_salt", "_slice"])
    reason = F.when(F.col("_live0") + F.col("_live_run") > 0, None).when(F.col("_born0") + F.col("_born_run") > 0, "deleted").otherwise("late")
    return known.withColumn("reason", reason).where("reason IS NOT NULL").select(*cols, "reason")


def find_orphans(refs: DataFrame, parents: DataFrame, max_lifetimes: int = MAX_LIFETIMES, hot_share: float = HOT_SHARE, blocks: int | None = None) -> DataFrame:
    """One row for each distinct reference without a parent alive at its time.

    refs has scope (string), key (a cleaned id), t (timestamp) and any further columns, which are kept; parents has
    scope, key, begin, end. Added is ``reason``: ``missing`` if no parent has the key in its scope, ``deleted`` if one
    began at or before t, else ``late``. Rows that are equal in all columns count once. References with a null key are
    none; a null scope matches no parent, so such a reference is missing; one with a null t comes out only if its key
    is missing; a parent with a null begin exists but never lives. Empty tables give no rows or only ``missing``.

    The parents' lifetimes are written once; their number sizes the filter (``blocks`` overrides it). References are
    probed once: those that the filter proves to be orphans carry a salt that no parent has, so the join that verifies
    the others leaves them alone. Skew: keys that hold more than ``hot_share`` of the references (at most 1 / hot_share
    keys, so their list is broadcast) are spread over SALTS salts. Parents with more than ``max_lifetimes`` lifetimes
    are counted along time slices, so no list grows without bound. Column names that begin with an underscore are taken.
    """
    cols, on = refs.columns, ["scope", "key"]
    refs = refs.where("key IS NOT NULL")
    parents = scratch_table(parents.where("key IS NOT NULL AND scope IS NOT NULL").select("scope", "key", "begin", "end").distinct(), "parents")
    blocks = blocks or max(1, -(-parents.count() * BITS_A_KEY // _BLOCK))
    total = refs.groupBy(F.xxhash64(*on).alias("_h")).agg(F.count("*").alias("_n"))
    # a few hundred keys at most, written once
    hot = scratch_table(total.where(F.col("_n") > F.lit(hot_share) * total.agg(F.sum("_n").alias("n")).scalar()).select("_h", F.lit(True).alias("_hot")), "hot")
    marked = lambda df: df.withColumn("_h", F.xxhash64(*on)).join(F.broadcast(hot), "_h", "left").drop("_h")
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salted = lambda df: marked(df).withColumn("_salt", F.explode(salts)).drop("_hot")
    proven = ~F.col("_may") | F.col("scope").isNull()
    salt = F.when(proven, -1).when(F.col("_hot"), F.pmod(F.xxhash64(*cols), F.lit(SALTS))).otherwise(0).cast("int")
    probed = marked(might_contain(refs, on, parents, blocks)).withColumn("_salt", salt).select(*cols, "_salt")

    counts = parents.groupBy(*on).agg(F.count("*").alias("_n"))
    busy = counts.where(F.col("_n") > max_lifetimes).select(*on)
    rare = bool(busy.take(1))  # decided once, on the parents' counts
    few = parents.join(busy, on, "left_anti") if rare else parents
    lives = few.groupBy(*on).agg(F.collect_list(F.struct("begin", "end")).alias("_lives"))
    if rare:
        lives = lives.unionByName(busy, allowMissingColumns=True)
    known = probed.join(salted(lives.withColumn("_there", F.lit(True))), [*on, "_salt"], "left")
    began = F.exists("_lives", lambda x: x["begin"] <= F.col("t"))
    alive = F.exists("_lives", lambda x: (x["begin"] <= F.col("t")) & (x["end"].isNull() | (x["end"] > F.col("t"))))
    counted = F.col("_there").isNotNull() & F.col("_lives").isNull()
    reason = F.when(F.col("_there").isNull(), "missing").when(F.col("t").isNull() | counted | alive, None).when(began, "deleted").otherwise("late")
    result = known.withColumn("reason", reason).where("reason IS NOT NULL").select(*cols, "reason")
    if rare:
        open_ = known.where(counted & F.col("t").isNotNull()).select(*cols, "_salt")
        result = result.unionByName(_counted(open_, parents.join(busy, on, "left_semi"), salted))
    return result.distinct()


def graph_references(relationships: DataFrame, edges: DataFrame, library_nodes: DataFrame) -> DataFrame:
    """Ends of relationships and targets of edges as references; ends at library nodes always live and are left out."""
    end = lambda field: F.struct(F.lit(field).alias("ref_field"), clean_id(F.col(field)).alias("key"))
    rel = relationships.select(F.lit("relationships").alias("ref_table"), F.col("id").alias("ref_id"), F.lit("element").alias("scope"), F.col("recorded_at").alias("t"), F.explode(F.array(end("source_id"), end("target_id"))).alias("_e"))
    rel = rel.select("ref_table", "ref_id", "_e.ref_field", "scope", "_e.key", "t")
    edge = edges.select(F.lit("edges").alias("ref_table"), F.col("id").alias("ref_id"), F.lit("target_id").alias("ref_field"), F.concat(F.lit("graph:"), F.col("graph_id")).alias("scope"), clean_id(F.col("target_id")).alias("key"), F.col("created_at").alias("t"))
    library = library_nodes.select(clean_id(F.col("id")).alias("key")).where("key IS NOT NULL").distinct()
    return rel.unionByName(edge.join(library, "key", "left_anti"))


def graph_parents(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Lifetimes of elements and nodes."""
    a = elements.select(F.lit("element").alias("scope"), clean_id(F.col("id")).alias("key"), F.col("recorded_at").alias("begin"), F.col("deleted_at").alias("end"))
    b = nodes.select(F.concat(F.lit("graph:"), F.col("graph_id")).alias("scope"), clean_id(F.col("id")).alias("key"), F.col("created_at").alias("begin"), F.col("removed_at").alias("end"))
    return a.unionByName(b)


def orphan_rows(relationships: DataFrame, edges: DataFrame, elements: DataFrame, nodes: DataFrame, library_nodes: DataFrame, **kw) -> DataFrame:
    """Orphan ends: ref_table, ref_id, ref_field, reason, ref_month (``2025-03``)."""
    found = find_orphans(graph_references(relationships, edges, library_nodes), graph_parents(elements, nodes), **kw)
    return found.select("ref_table", "ref_id", "ref_field", "reason", F.date_format("t", "yyyy-MM").alias("ref_month")).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, field, reason and month."""
    return found.groupBy("ref_table", "ref_field", "reason", "ref_month").agg(F.count("*").alias("orphans"))

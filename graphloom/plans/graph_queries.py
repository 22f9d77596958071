"""Queries of the graph operators, each over its whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions import text as tx
from graphloom.operators import build, clean, impact as im, ops, query as qu, rewrite as rw, risk, search, traverse as tr, viz
from graphloom.plans import sql as q
from graphloom.plans.rank import row_numbers
from graphloom.schema import GRADE_TYPE, HOP_WEIGHT, SECURITY_RULES
from graphloom.session import scratch_table
from graphloom.sources import parse, store
from graphloom.sources.tables import table
from graphloom.streaming import changes as ch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Depth of impacts, as the survey has it.
DEPTH = 5
#: Nodes of the longest cycles, as the survey has it.
LONGEST_CYCLE = 10


def query(name: str, sql: str | None = None):
    """Register a function of (session, folder) and its SQL."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def nodes(s: SparkSession, d: str) -> DataFrame:
    return clean.latest_nodes(table(s, d, "nodes"))


def edges(s: SparkSession, d: str) -> DataFrame:
    return clean.distinct_edges(table(s, d, "edges"))


def elements(s: SparkSession, d: str) -> DataFrame:
    return build.latest_elements(table(s, d, "elements"))


def issues(s: SparkSession, d: str) -> DataFrame:
    return risk.standard_issues(table(s, d, "issues"))


def log(s: SparkSession, d: str) -> DataFrame:
    return ch.clean_changes(table(s, d, "changes"))


def roots(n: DataFrame) -> DataFrame:
    """The stated query set: every node whose id's hash is divisible by 20, against all nodes."""
    return n.where("CAST(conv(substring(md5(id), 1, 6), 16, 10) AS BIGINT) % 20 = 0").select("graph_id", F.col("id").alias("root")).distinct()


def impacts(s: SparkSession, d: str) -> DataFrame:
    n = scratch_table(nodes(s, d), "nodes")
    e = scratch_table(edges(s, d), "edges")
    return im.impact(n, e, roots(n), DEPTH)


def grades(s: SparkSession, d: str) -> DataFrame:
    return im.grade(scratch_table(impacts(s, d), "impacts"))


def joined(c: str = "path"):
    return F.array_join(c, ",").alias(c)


# build
@query("b1_nodes", q.with_(q.ELEMENTS) + "SELECT sha256(concat_ws('|', name, type, file_path, line_number::VARCHAR)) AS id, name AS label, type, id AS element_id, file_path, line_number, complexity, coalesce(visibility, 'public') AS visibility FROM elements_c")
def _(s, d):
    return build.create_nodes(elements(s, d))


_STRENGTH = """least(1.0::DOUBLE, (CASE type WHEN 'inherits' THEN 0.9::DOUBLE WHEN 'implements' THEN 0.8::DOUBLE WHEN 'composes' THEN 0.7::DOUBLE WHEN 'calls' THEN 0.6::DOUBLE WHEN 'depends' THEN 0.5::DOUBLE WHEN 'imports' THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END)
  + (CASE WHEN length(context) > 50 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN call_count > 10 THEN 0.2::DOUBLE WHEN call_count > 5 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END))"""
_RESOLVED = "rels_c r WHERE source_id IN (SELECT id FROM elements_c) AND target_id IN (SELECT id FROM elements_c)"


@query("b2_edges", q.with_(q.ELEMENTS, q.RELATIONSHIPS) + f"SELECT id, source_id, target_id, type, round({_STRENGTH}, 6) AS strength, call_count FROM {_RESOLVED}")
def _(s, d):
    return build.create_edges(table(s, d, "relationships"), elements(s, d)).select("id", "source_id", "target_id", "type", F.round("strength", 6).alias("strength"), "call_count")


@query("b2_unresolved", q.with_(q.ELEMENTS, q.RELATIONSHIPS) + f"SELECT id, type FROM rels_c WHERE id NOT IN (SELECT id FROM {_RESOLVED})")
def _(s, d):
    return build.unresolved(table(s, d, "relationships"), elements(s, d))


@query("b3_strength", q.with_(q.RELATIONSHIPS) + f"SELECT type, round({_STRENGTH}, 6) AS strength, count(*) AS n FROM rels_c GROUP BY ALL")
def _(s, d):
    r = clean.once(table(s, d, "relationships"))
    return r.select("type", F.round(build.relationship_strength(), 6).alias("strength")).groupBy("type", "strength").agg(F.count("*").alias("n"))


_LANG = r"regexp_extract(file_path, '\.(py|java|js|ts|go)$', 1)"


@query("b4_metadata", q.with_(q.NODES, q.EDGES) + f"""SELECT graph_id, 'nodes' AS metric, '' AS key, count(*) AS value FROM nodes_c GROUP BY graph_id
  UNION ALL SELECT graph_id, 'edges', '', count(*) FROM edges_c GROUP BY graph_id UNION ALL SELECT graph_id, 'files', '', count(DISTINCT file_path) FROM nodes_c GROUP BY graph_id
  UNION ALL SELECT graph_id, 'language', {_LANG}, count(*) FROM nodes_c WHERE {_LANG} <> '' GROUP BY 1, 3 UNION ALL SELECT graph_id, 'node_type', type, count(*) FROM nodes_c GROUP BY 1, 3
  UNION ALL SELECT graph_id, 'edge_type', type, count(*) FROM edges_c GROUP BY 1, 3""")
def _(s, d):
    return build.graph_metadata(nodes(s, d), edges(s, d))


@query("b5_node_metrics", q.with_(q.NODES, q.EDGES, q.DEGREES) + "SELECT graph_id, id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree, coalesce(i, 0) + coalesce(o, 0) AS total_degree FROM nodes_c LEFT JOIN deg USING (graph_id, id)")
def _(s, d):
    return build.node_metrics(nodes(s, d), edges(s, d))


_NEAR = "near AS (SELECT DISTINCT graph_id, id, neighbour FROM (SELECT graph_id, source_id AS id, target_id AS neighbour FROM edges_c UNION ALL SELECT graph_id, target_id, source_id FROM edges_c) WHERE id <> neighbour)"


@query("b6_connected", q.with_(q.EDGES, _NEAR) + "SELECT graph_id, id, neighbour FROM near")
def _(s, d):
    return build.connected(edges(s, d))


_DUP = """dup AS (SELECT graph_id, id, min(id) OVER (PARTITION BY graph_id, coalesce(label, ''), coalesce(type, ''), coalesce(name, ''), coalesce(file_path, ''), coalesce(line_number, -1)) AS keep FROM nodes_c)"""


@query("o1_nodes", q.with_(q.NODES, _DUP) + "SELECT graph_id, id FROM dup WHERE id = keep")
def _(s, d):
    n = nodes(s, d)
    return rw.remove_duplicates(n, edges(s, d))[0].select("graph_id", "id")


_MAPPED = "mapped AS (SELECT e.graph_id, coalesce(a.keep, e.source_id) AS source_id, coalesce(b.keep, e.target_id) AS target_id, e.type, e.id, e.strength FROM edges_c e LEFT JOIN dup a ON a.graph_id = e.graph_id AND a.id = e.source_id LEFT JOIN dup b ON b.graph_id = e.graph_id AND b.id = e.target_id)"


@query("o1_edges", q.with_(q.NODES, q.EDGES, _DUP, _MAPPED) + "SELECT graph_id, source_id, target_id, type, min(id) AS id, max(strength) AS strength FROM mapped GROUP BY ALL")
def _(s, d):
    return rw.remove_duplicates(nodes(s, d), edges(s, d))[1]


@query("b8_merged_nodes", q.with_(q.NODES) + "SELECT graph_id, name, type, file_path, min(id) AS id, max(complexity) AS complexity, count(*) AS merged FROM nodes_c GROUP BY ALL")
def _(s, d):
    return build.merge_nodes(nodes(s, d))


@query("b9_compressed", q.with_(q.NODES) + "SELECT graph_id, id, (CASE WHEN label <> '' THEN 1 ELSE 0 END + CASE WHEN type <> '' THEN 1 ELSE 0 END + CASE WHEN element_id <> '' THEN 1 ELSE 0 END + CASE WHEN name <> '' THEN 1 ELSE 0 END + CASE WHEN file_path <> '' THEN 1 ELSE 0 END + CASE WHEN visibility <> '' THEN 1 ELSE 0 END + CASE WHEN docstring <> '' THEN 1 ELSE 0 END) AS properties, CASE WHEN docstring <> '' THEN least(length(docstring), 1003) ELSE -1 END AS doc_length FROM nodes_c")
def _(s, d):
    p = build.compress_properties(nodes(s, d))
    return p.select("graph_id", "id", F.size("props").alias("properties"), F.coalesce(F.length(F.col("props")["docstring"]), F.lit(-1)).alias("doc_length"))


@query("o2_similar")
def _(s, d):
    return rw.similar_seeds(scratch_table(nodes(s, d), "nodes"))


@query("o3_connected", q.with_(q.NODES, q.EDGES) + "SELECT graph_id, id FROM nodes_c WHERE (graph_id, id) IN (SELECT (graph_id, source_id) FROM edges_c UNION SELECT (graph_id, target_id) FROM edges_c)")
def _(s, d):
    return rw.connected_nodes(nodes(s, d), edges(s, d)).select("graph_id", "id")


@query("o4_merged_edges", q.with_(q.EDGES) + """SELECT graph_id, source_id, target_id, arg_min(id, (-s, id)) AS id, arg_min(type, (-s, id)) AS type, round(least(1.0::DOUBLE, max(s) + 0.1::DOUBLE * (count(*) - 1)), 9) AS strength,
  sum(coalesce(call_count, 1))::BIGINT AS call_count, count(*) AS merged, coalesce(string_agg(DISTINCT context, '; ' ORDER BY context), '') AS context FROM (SELECT *, coalesce(strength, 0.5::DOUBLE) AS s FROM edges_c) GROUP BY graph_id, source_id, target_id""")
def _(s, d):
    return rw.merge_edges(edges(s, d))


_CHAINS = """pairs AS (SELECT DISTINCT graph_id, source_id, target_id FROM edges_c), ways AS (SELECT graph_id, source_id AS id, min(target_id) AS nxt FROM pairs GROUP BY ALL HAVING count(*) = 1),
only_in AS (SELECT graph_id, target_id AS id FROM pairs GROUP BY ALL HAVING count(*) = 1), inner_n AS (SELECT w.* FROM ways w JOIN only_in USING (graph_id, id)),
heads AS (SELECT * FROM ways w WHERE (graph_id, id) NOT IN (SELECT (i.graph_id, i.id) FROM inner_n i JOIN ways v ON v.graph_id = i.graph_id AND v.nxt = i.id)),
walk AS (SELECT h.graph_id, h.id AS head, i.nxt AS tail, 2 AS n FROM heads h JOIN inner_n i ON i.graph_id = h.graph_id AND i.id = h.nxt
  UNION ALL SELECT w.graph_id, w.head, i.nxt, w.n + 1 FROM walk w JOIN inner_n i ON i.graph_id = w.graph_id AND i.id = w.tail WHERE w.n < 1000)"""


@query("o5_chains", q.with_(q.EDGES, _CHAINS, recursive=True) + "SELECT graph_id, head, arg_max(tail, n) AS tail, max(n) AS edges FROM walk GROUP BY graph_id, head")
def _(s, d):
    return rw.linear_chains(scratch_table(edges(s, d), "edges"))


@query("o5_compressed")
def _(s, d):
    return rw.compress_chains(scratch_table(edges(s, d), "edges"))


_CLOSED = "r AS (SELECT graph_id, id, id AS other FROM ends UNION SELECT r.graph_id, r.id, b.nxt FROM r JOIN {0} b ON b.graph_id = r.graph_id AND b.id = r.other)"
_ENDS = "ends AS (SELECT graph_id, id FROM nodes_c UNION SELECT graph_id, source_id FROM edges_c UNION SELECT graph_id, target_id FROM edges_c)"


@query("o6_components", q.with_(q.NODES, q.EDGES, _ENDS, "both_e AS (SELECT graph_id, source_id AS id, target_id AS nxt FROM edges_c UNION SELECT graph_id, target_id, source_id FROM edges_c)", _CLOSED.format("both_e"), recursive=True) + "SELECT graph_id, id, min(other) AS component FROM r GROUP BY graph_id, id")
def _(s, d):
    return rw.components(nodes(s, d), edges(s, d))


@query("o6_component_nodes", q.with_(q.NODES, q.EDGES) + "SELECT graph_id, count(*) AS nodes FROM (SELECT graph_id, id FROM nodes_c UNION SELECT graph_id, source_id FROM edges_c UNION SELECT graph_id, target_id FROM edges_c) GROUP BY graph_id")
def _(s, d):
    return rw.components(nodes(s, d), edges(s, d)).groupBy("graph_id").agg(F.count("*").alias("nodes"))


@query("o7_merged_graph", q.with_(q.NODES) + "SELECT label, type, name, file_path, line_number, min(id) AS id FROM nodes_c GROUP BY coalesce(label, ''), coalesce(type, ''), coalesce(name, ''), coalesce(file_path, ''), coalesce(line_number, -1), label, type, name, file_path, line_number")
def _(s, d):
    n, e = nodes(s, d), edges(s, d)
    half = F.pmod(F.xxhash64("graph_id"), F.lit(2)) == 0
    return rw.merge_graphs([n.where(half), n.where(~half)], [e.where(half), e.where(~half)], "all")[0].select("label", "type", "name", "file_path", "line_number", "id")


@query("o8_statistics", q.with_(q.NODES, q.EDGES, _DUP) + "SELECT (SELECT count(*) FROM nodes_c) AS nodes_before, (SELECT count(*) FROM dup WHERE id = keep) AS nodes_after, (SELECT count(*) FROM edges_c) AS edges_before, (SELECT count(*) FROM (SELECT DISTINCT graph_id, source_id, target_id FROM edges_c)) AS edges_after")
def _(s, d):
    n, e = nodes(s, d), edges(s, d)
    kept, _ = rw.remove_duplicates(n, e)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [one(n, "nodes_before"), one(kept, "nodes_after"), one(e, "edges_before"), one(rw.merge_edges(e), "edges_after")]
    return s.range(1).select(*[p.scalar().alias(p.columns[0]) for p in parts])


# queries
@query("g1_shortest", q.with_(q.NODES, q.EDGES, q.ROOTS, *q.shortest(LONGEST_CYCLE - 1)) + "SELECT graph_id, root, id AS target, distance AS length, round(b.w, 6) AS total_weight, array_to_string(b.p, ',') AS path FROM way")
def _(s, d):
    n = nodes(s, d)
    w = tr.shortest(tr.steps(scratch_table(edges(s, d), "edges")), roots(n), LONGEST_CYCLE, ",", digits=6)
    return w.select("graph_id", "root", "target", "length", "total_weight", "path")


def _paths(most: int, weight: str, start: str) -> str:
    return f"""start AS (SELECT graph_id, id AS root FROM nodes_c WHERE type = 'method'), goal AS (SELECT graph_id, id AS target FROM nodes_c WHERE type IN ('class', 'struct')),
st AS (SELECT graph_id, source_id AS id, target_id AS nxt, {weight} AS w, type FROM edges_c),
walk AS (SELECT graph_id, root, root AS id, [root] AS path, {start}::DOUBLE AS weight, ''::VARCHAR AS types, 0 AS n FROM start
  UNION ALL SELECT k.graph_id, k.root, s.nxt, list_append(k.path, s.nxt), k.weight {'+' if start == '0.0' else '*'} s.w, k.types || s.type || ' ', k.n + 1 FROM walk k JOIN st s ON s.graph_id = k.graph_id AND s.id = k.id
  WHERE k.n < {most - 1} AND NOT list_contains(k.path, s.nxt) AND (k.graph_id, k.id) NOT IN (SELECT (graph_id, target) FROM goal)),
hit AS (SELECT * FROM walk WHERE (graph_id, id) IN (SELECT (graph_id, target) FROM goal))"""


@query("g2_all_paths", q.with_(q.NODES, q.EDGES, _paths(5, "coalesce(strength, 1.0::DOUBLE)", "0.0"), recursive=True) + "SELECT graph_id, root, target, path, length, total_weight FROM (SELECT graph_id, root, id AS target, array_to_string(path, ',') AS path, n AS length, round(weight, 6) AS total_weight, row_number() OVER (PARTITION BY graph_id, root, id ORDER BY n, round(weight, 9), path, types) AS k FROM hit) WHERE k <= 10")
def _(s, d):
    n = nodes(s, d)
    start = n.where("type = 'method'").select("graph_id", F.col("id").alias("root"))
    goal = n.where("type IN ('class', 'struct')").select("graph_id", F.col("id").alias("target"))
    p = tr.paths(tr.steps(scratch_table(edges(s, d), "edges")), start, goal, 5, 10, ",")
    return p.select("graph_id", "root", "target", "path", "length", F.round("total_weight", 6).alias("total_weight"))


@query("g3_impact_edges", q.with_(q.NODES, q.EDGES, q.ROOTS, *q.reach("way", 5, "source_id", "target_id")) + "SELECT DISTINCT e.graph_id, e.id FROM edges_c e JOIN way w ON w.graph_id = e.graph_id AND w.id = e.source_id WHERE w.distance < 5")
def _(s, d):
    n, e = nodes(s, d), scratch_table(edges(s, d), "edges")
    inside = tr.reach(tr.steps(e), roots(n), 5).where("distance < 5").select("graph_id", F.col("id").alias("source_id")).distinct()
    return e.join(inside, ["graph_id", "source_id"], "left_semi").select("graph_id", "id")


_BOTH = "both_e AS (SELECT graph_id, source_id AS id, target_id AS nxt FROM edges_c UNION ALL SELECT graph_id, target_id, source_id FROM edges_c)"


@query("g4_neighbours", q.with_(q.NODES, q.EDGES, q.ROOTS, _BOTH) + "SELECT graph_id, root, id AS neighbour FROM (SELECT DISTINCT r.graph_id, r.root, b.nxt AS id FROM roots r JOIN both_e b ON b.graph_id = r.graph_id AND b.id = r.root WHERE b.nxt <> r.root)")
def _(s, d):
    n = nodes(s, d)
    return tr.reach(tr.steps(scratch_table(edges(s, d), "edges"), "both"), roots(n), 1).where("distance = 1").select("graph_id", "root", F.col("id").alias("neighbour"))


_CYCLE = """e2 AS (SELECT DISTINCT graph_id, source_id AS a, target_id AS b FROM edges_c WHERE source_id <> target_id AND type IN ({types})),
walk AS (SELECT graph_id, a AS st, b AS at, [a, b] AS path FROM e2 WHERE b > a
  UNION ALL SELECT w.graph_id, w.st, e.b, list_append(w.path, e.b) FROM walk w JOIN e2 e ON e.graph_id = w.graph_id AND e.a = w.at WHERE e.b > w.st AND NOT list_contains(w.path, e.b) AND len(w.path) < 4)"""
_CYCLE_OUT = "SELECT DISTINCT w.graph_id, array_to_string(list_append(w.path, w.st), ',') AS cycle, len(w.path) AS length FROM walk w JOIN e2 e ON e.graph_id = w.graph_id AND e.a = w.at AND e.b = w.st"


@query("g5_cycles", q.with_(q.EDGES, _CYCLE.replace(" AND type IN ({types})", "").replace("len(w.path) < 4", "len(w.path) < 10"), recursive=True) + _CYCLE_OUT)
def _(s, d):
    return tr.cycles(edges(s, d), LONGEST_CYCLE, join=",").select("graph_id", "cycle", "length")


@query("g6_scc", q.with_(q.NODES, q.EDGES, _ENDS, "one_e AS (SELECT DISTINCT graph_id, source_id AS id, target_id AS nxt FROM edges_c WHERE source_id <> target_id)", _CLOSED.format("one_e"), recursive=True) + "SELECT a.graph_id, a.id, min(a.other) AS component FROM r a JOIN r b ON a.graph_id = b.graph_id AND a.id = b.other AND a.other = b.id GROUP BY a.graph_id, a.id HAVING count(*) > 1")
def _(s, d):
    return tr.strong_components(edges(s, d))


@query("g7_pattern", q.with_(q.NODES) + "SELECT graph_id, id, name FROM nodes_c WHERE type = 'class' AND (complexity IS NULL OR complexity = 1) AND (visibility IS NULL OR visibility = 'public')")
def _(s, d):
    return qu.pattern_match(nodes(s, d), {"type": "class", "complexity": 1, "visibility": "public"}).select("graph_id", "id", "name")


@query("g8_adjacency", q.with_(q.EDGES) + "SELECT graph_id, source_id AS id, count(DISTINCT target_id) AS targets, count(*) AS edges FROM edges_c GROUP BY ALL")
def _(s, d):
    return edges(s, d).groupBy("graph_id", F.col("source_id").alias("id")).agg(F.countDistinct("target_id").alias("targets"), F.count("*").alias("edges"))


@query("g9_without_docs", q.with_(q.NODES) + "SELECT graph_id, id FROM nodes_c WHERE docstring IS NULL")
def _(s, d):
    return qu.find_by_property(nodes(s, d), "docstring", None).select("graph_id", "id")


@query("g10_statistics", q.with_(q.NODES, q.EDGES) + "SELECT 'node' AS kind, type, count(*) AS n FROM nodes_c GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges_c GROUP BY type")
def _(s, d):
    return qu.statistics(nodes(s, d), edges(s, d))


@query("g11_query_nodes", q.with_(q.NODES) + "SELECT graph_id, id, complexity FROM nodes_c WHERE type = 'method' AND visibility = 'private'")
def _(s, d):
    return qu.query_rows(nodes(s, d), {"type": "method", "visibility": "private"}).select("graph_id", "id", "complexity")


@query("g12_query_edges", q.with_(q.NODES, q.EDGES) + "SELECT e.graph_id, e.id, a.label AS source_label, a.type AS source_type, b.label AS target_label, b.type AS target_type FROM edges_c e LEFT JOIN nodes_c a ON a.graph_id = e.graph_id AND a.id = e.source_id LEFT JOIN nodes_c b ON b.graph_id = e.graph_id AND b.id = e.target_id WHERE e.type = 'inherits'")
def _(s, d):
    return qu.with_endpoints(edges(s, d).where("type = 'inherits'"), nodes(s, d)).select("graph_id", "id", "source_label", "source_type", "target_label", "target_type")


@query("g13_remove_nodes", q.with_(q.NODES, q.EDGES) + "SELECT graph_id, id FROM edges_c WHERE (graph_id, source_id) NOT IN (SELECT (graph_id, id) FROM nodes_c WHERE visibility = 'private') AND (graph_id, target_id) NOT IN (SELECT (graph_id, id) FROM nodes_c WHERE visibility = 'private')")
def _(s, d):
    n = nodes(s, d)
    return qu.remove_nodes(n, edges(s, d), n.where("visibility = 'private'").select("graph_id", "id"))[1].select("graph_id", "id")


@query("g14_subgraph", q.with_(q.NODES, q.EDGES) + "SELECT graph_id, id FROM edges_c WHERE (graph_id, source_id) IN (SELECT (graph_id, id) FROM nodes_c WHERE type IN ('class', 'method')) AND (graph_id, target_id) IN (SELECT (graph_id, id) FROM nodes_c WHERE type IN ('class', 'method'))")
def _(s, d):
    return qu.subgraph(nodes(s, d), edges(s, d), F.col("type").isin("class", "method"))[1].select("graph_id", "id")


@query("g15_page", q.with_(q.NODES) + "SELECT graph_id, id, name FROM nodes_c ORDER BY graph_id, id LIMIT 100 OFFSET 200")
def _(s, d):
    return qu.page(nodes(s, d), ["graph_id", "id"], 200, 100).select("graph_id", "id", "name")


@query("g16_page_info", q.with_(q.NODES) + "SELECT count(*) AS total, ceil(count(*) / 100.0)::BIGINT AS total_pages, 3 < ceil(count(*) / 100.0) AS has_next, true AS has_prev FROM nodes_c")
def _(s, d):
    return qu.page_info(nodes(s, d), 100, 3)


@query("i10_dependency_paths", q.with_(q.NODES, q.EDGES, _paths(6, f"{q.case(HOP_WEIGHT, 'type', 0.5)} * coalesce(strength, 0.5::DOUBLE)", "1.0"), recursive=True) + "SELECT graph_id, root, id AS target, array_to_string(path, ',') AS path, round(round(weight, 9), 6) AS strength, trim(types) AS types FROM hit")
def _(s, d):
    n = nodes(s, d)
    start = n.where("type = 'method'").select("graph_id", F.col("id").alias("root"))
    goal = n.where("type IN ('class', 'struct')").select("graph_id", F.col("id").alias("target"))
    p = tr.paths(tr.steps(scratch_table(edges(s, d), "edges")), start, goal, 6, join=",")
    return p.select("graph_id", "root", "target", "path", F.round("strength", 6).alias("strength"), "types")


# impact
@query("i1_impact", q.with_(*q.impacts(DEPTH)) + "SELECT graph_id, root, id, type, round(score, 6) AS score, distance, level, role, round(strength, 6) AS strength, array_to_string(path, ',') AS path FROM imp")
def _(s, d):
    return impacts(s, d).select("graph_id", "root", "id", "type", F.round("score", 6).alias("score"), "distance", "level", "role", F.round("strength", 6).alias("strength"), joined())


@query("i1_delete", q.with_(*q.impacts(DEPTH, 5)) + "SELECT graph_id, root, id, round(score, 6) AS score, distance, level, role FROM imp")
def _(s, d):
    n, e = scratch_table(nodes(s, d), "nodes"), scratch_table(edges(s, d), "edges")
    return im.impact(n, e, roots(n), DEPTH, change="DELETE").select("graph_id", "root", "id", F.round("score", 6).alias("score"), "distance", "level", "role")


@query("i8_critical_paths", q.with_(*q.impacts(DEPTH)) + "SELECT graph_id, root, id, array_to_string(path, ',') AS path, strength FROM imp WHERE level IN ('HIGH', 'CRITICAL') ORDER BY strength DESC, graph_id, root, id LIMIT 10")
def _(s, d):
    return im.critical_paths(impacts(s, d)).select("graph_id", "root", "id", joined(), "strength")


@query("i9_summary", q.with_(*q.impacts(DEPTH)) + """SELECT graph_id, root, count(*) FILTER (level = 'NONE') AS none, count(*) FILTER (level = 'LOW') AS low, count(*) FILTER (level = 'MEDIUM') AS medium, count(*) FILTER (level = 'HIGH') AS high,
  count(*) FILTER (level = 'CRITICAL') AS critical, round(avg(score), 6) AS average, max(distance) AS max_depth FROM imp GROUP BY graph_id, root""")
def _(s, d):
    return im.level_summary(impacts(s, d))


_RISK = """links AS (SELECT graph_id, id, coalesce(i, 0) + coalesce(o, 0) AS n, type, complexity FROM nodes_c
  LEFT JOIN (SELECT graph_id, target_id AS id, count(DISTINCT source_id) AS i FROM edges_c WHERE source_id <> target_id GROUP BY ALL) USING (graph_id, id)
  LEFT JOIN (SELECT graph_id, source_id AS id, count(DISTINCT target_id) AS o FROM edges_c WHERE source_id <> target_id GROUP BY ALL) USING (graph_id, id)),
risks AS (SELECT graph_id, id, least(1.0::DOUBLE, 0.5::DOUBLE + CASE WHEN type IN ('interface', 'class') THEN 0.2::DOUBLE WHEN type IN ('module', 'namespace') THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) AS base,
  (CASE WHEN n >= 20 THEN 0.9 WHEN n >= 10 THEN 0.7 WHEN n >= 5 THEN 0.5 WHEN n >= 2 THEN 0.3 ELSE 0.1 END)::DOUBLE AS connectivity,
  (CASE WHEN coalesce(complexity, 1) >= 20 THEN 0.9 WHEN coalesce(complexity, 1) >= 10 THEN 0.7 WHEN coalesce(complexity, 1) >= 5 THEN 0.5 ELSE 0.2 END)::DOUBLE AS complexity_risk FROM links),
total AS (SELECT *, round(0.3::DOUBLE * base + 0.4::DOUBLE * connectivity + 0.2::DOUBLE * complexity_risk + 0.03::DOUBLE, 9) AS risk FROM risks)"""


@query("i11_change_risk", q.with_(q.NODES, q.EDGES, _RISK) + "SELECT graph_id, id, round(base, 6) AS base, connectivity, complexity_risk, risk, CASE WHEN risk >= 0.8 THEN 'critical' WHEN risk >= 0.6 THEN 'high' WHEN risk >= 0.4 THEN 'medium' WHEN risk >= 0.2 THEN 'low' ELSE 'minimal' END AS risk_level FROM total")
def _(s, d):
    return im.change_risk(nodes(s, d), edges(s, d))


_LEVEL = "CASE WHEN risk >= 0.8 THEN 'critical' WHEN risk >= 0.6 THEN 'high' WHEN risk >= 0.4 THEN 'medium' WHEN risk >= 0.2 THEN 'low' ELSE 'minimal' END"


@query("i11_recommendations", q.with_(q.NODES, q.EDGES, _RISK) + f"SELECT graph_id, id, concat_ws(', ', CASE WHEN l IN ('critical', 'high') THEN 'review before the change' END, CASE WHEN l IN ('critical', 'high', 'medium') THEN 'test the dependents' END, CASE WHEN connectivity >= 0.7 THEN 'split the change' END, CASE WHEN complexity_risk >= 0.7 THEN 'simplify first' END) AS recommendations FROM (SELECT *, {_LEVEL} AS l FROM total)")
def _(s, d):
    return im.recommendations(im.change_risk(nodes(s, d), edges(s, d))).withColumn("recommendations", F.array_join("recommendations", ", "))


_GRADES = [*q.impacts(DEPTH), q.GRADES % q.case(GRADE_TYPE, "type", 0.5)]


@query("i12_grades", q.with_(*_GRADES) + f"SELECT graph_id, root, id, type, level, score, distance, near, kind, linked, grade_score, {q.level('grade_score')} AS grade FROM grades")
def _(s, d):
    return grades(s, d)


@query("i13_ranked", q.with_(*_GRADES) + "SELECT graph_id, root, id, row_number() OVER (ORDER BY grade_score DESC, score DESC, graph_id, root, id) AS rank FROM grades")
def _(s, d):
    return im.ranked(grades(s, d)).select("graph_id", "root", "id", "rank")


@query("i14_distribution", q.with_(*_GRADES) + f"SELECT {q.level('grade_score')} AS grade, count(*) AS n, round(avg(grade_score), 6) AS mean, max(grade_score) AS max, min(grade_score) AS min, round(100 * count(*) / (SELECT count(*) FROM grades), 6) AS percent FROM grades GROUP BY 1")
def _(s, d):
    return im.distribution(scratch_table(grades(s, d), "grades"))


@query("i14_transitions", q.with_(*_GRADES) + f"SELECT level, {q.level('grade_score')} AS grade, count(*) AS n FROM grades GROUP BY 1, 2")
def _(s, d):
    return im.transitions(grades(s, d))


@query("i15_criteria", q.with_(*_GRADES) + "SELECT graph_id, root, id, criterion, value, row_number() OVER (PARTITION BY graph_id, root, criterion ORDER BY value DESC, id) AS rank FROM (SELECT graph_id, root, id, unnest(['score', 'near', 'kind', 'linked']) AS criterion, unnest([score, near, kind, linked]) AS value FROM grades)")
def _(s, d):
    return im.criteria_ranking(grades(s, d))


@query("i16_top", q.with_(*q.impacts(DEPTH)) + "SELECT * FROM (SELECT graph_id, root, id, score, row_number() OVER (PARTITION BY graph_id, root ORDER BY score DESC, id) AS rank FROM imp) WHERE rank <= 3")
def _(s, d):
    return im.top_by_root(impacts(s, d))


# visual products
@query("v1_edges", q.with_(*q.impacts(DEPTH)) + "SELECT graph_id, root, id, k - 1 AS hop, path[k] AS source, path[k + 1] AS target, round(1 + 4 * strength, 6) AS width FROM (SELECT *, unnest(range(1, len(path))) AS k FROM imp)")
def _(s, d):
    return viz.visual_edges(impacts(s, d))


@query("v2_nodes", q.with_(*q.impacts(DEPTH)) + "SELECT graph_id, root, id, level, distance, round(8 + 17 * score, 6) AS size, round(least(0.8::DOUBLE, score + 0.3::DOUBLE), 6) AS opacity, CASE level " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in viz.LEVEL_COLOUR.items()) + " END AS colour FROM imp")
def _(s, d):
    return viz.visual_nodes(impacts(s, d))


@query("v3_clusters", q.with_(*q.impacts(DEPTH)) + "SELECT graph_id, root, type, count(*) AS members, min(id) AS first FROM imp GROUP BY ALL HAVING count(*) > 1")
def _(s, d):
    return viz.clusters(impacts(s, d))


_RING = "(row_number() OVER (PARTITION BY {by} ORDER BY id) - 1) AS k, count(*) OVER (PARTITION BY {by}) AS n"


@query("v4_ring", q.with_(*q.impacts(DEPTH)) + f"SELECT graph_id, root, id, round(400 + (80 + 60 * distance) * cos(2 * pi() * k / n), 4) + 0 AS x, round(300 + (80 + 60 * distance) * sin(2 * pi() * k / n), 4) + 0 AS y FROM (SELECT *, {_RING.format(by='graph_id, root, distance')} FROM imp)")
def _(s, d):
    return viz.ring_layout(scratch_table(impacts(s, d), "impacts"))


@query("v5_rows", q.with_(*q.impacts(DEPTH)) + f"SELECT graph_id, root, id, round(800::DOUBLE * (k + 1) / (n + 1), 4) AS x, round(100::DOUBLE * (distance + 1), 4) AS y FROM (SELECT *, {_RING.format(by='graph_id, root, distance')} FROM imp)")
def _(s, d):
    return viz.row_layout(scratch_table(impacts(s, d), "impacts"))


@query("v5_tree", q.with_(*q.impacts(DEPTH)) + ", t AS (SELECT *, path[len(path) - 1] AS parent FROM imp) SELECT graph_id, root, id, parent, round(800::DOUBLE * row_number() OVER (PARTITION BY graph_id, root, distance ORDER BY parent, id) / (count(*) OVER (PARTITION BY graph_id, root, distance) + 1), 4) AS x, round(100::DOUBLE * (distance + 1), 4) AS y FROM t")
def _(s, d):
    return viz.tree_layout(scratch_table(impacts(s, d), "impacts"))


@query("v12_strongest", q.with_(*q.impacts(DEPTH)) + "SELECT graph_id, root, id, strength, len(path) - 1 AS hops FROM imp ORDER BY strength DESC, graph_id, root, id LIMIT 20")
def _(s, d):
    return viz.strongest(impacts(s, d))


@query("v6_circle", q.with_(*q.impacts(DEPTH)) + f"SELECT graph_id, root, id, round(400 + 200 * cos(2 * pi() * k / n), 4) AS x, round(300 + 200 * sin(2 * pi() * k / n), 4) AS y FROM (SELECT *, {_RING.format(by='graph_id, root')} FROM imp)")
def _(s, d):
    return viz.circle_layout(scratch_table(impacts(s, d), "impacts"))


@query("v7_heat_map", q.with_(*q.impacts(DEPTH)) + "SELECT graph_id, root, level, id, k % 10 AS x, k // 10 AS y, score FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, root, level ORDER BY score DESC, id) - 1 AS k FROM imp)")
def _(s, d):
    return viz.heat_map(impacts(s, d))


@query("v8_timeline", "SELECT strftime(detected_at, '%Y-%m') AS month, coalesce(lower(level), 'low') AS level, count(*) AS n FROM (SELECT DISTINCT ON (id) * FROM issues) GROUP BY 1, 2")
def _(s, d):
    return viz.timeline(clean.once(table(s, d, "issues")))


@query("v9_matrix", q.with_(*q.impacts(DEPTH)) + ", t AS (SELECT type, avg(score) AS s, avg(strength) AS t FROM imp GROUP BY type) SELECT a.type AS row, b.type AS col, round(0.7::DOUBLE * (a.s + b.s) / 2 + 0.3::DOUBLE * (a.t + b.t) / 2, 6) AS value FROM t a JOIN t b ON a.type <= b.type")
def _(s, d):
    return viz.type_matrix(scratch_table(impacts(s, d), "impacts"))


@query("v10_ranking", q.with_(*q.impacts(DEPTH)) + "SELECT graph_id, root, id, row_number() OVER (PARTITION BY graph_id, root ORDER BY distance, score DESC, id) AS rank FROM imp")
def _(s, d):
    return row_numbers(impacts(s, d), [F.asc("distance"), F.desc("score"), F.asc("id")], by=["graph_id", "root"]).select("graph_id", "root", "id", "rank")


@query("v12_strength_classes", q.with_(*q.impacts(DEPTH)) + "SELECT CASE WHEN strength >= 0.8 THEN 'very strong' WHEN strength >= 0.6 THEN 'strong' WHEN strength >= 0.4 THEN 'medium' WHEN strength >= 0.2 THEN 'weak' ELSE 'very weak' END AS strength_class, count(*) AS paths FROM imp GROUP BY 1")
def _(s, d):
    return viz.strength_classes(impacts(s, d))


@query("v13_layers", q.with_(*q.impacts(DEPTH)) + ", every AS (SELECT graph_id, root, unnest(range(0, max(distance) + 1)) AS distance FROM imp GROUP BY graph_id, root) SELECT graph_id, root, distance, count(imp.id) AS nodes, round(avg(score), 6) AS mean, max(score) AS max FROM every LEFT JOIN imp USING (graph_id, root, distance) GROUP BY ALL")
def _(s, d):
    return viz.layers(scratch_table(impacts(s, d), "impacts"))


@query("v14_view", q.with_(q.NODES, q.EDGES) + ", top AS (SELECT graph_id, id, type FROM nodes_c ORDER BY graph_id, id LIMIT 200) SELECT type, count(*) AS nodes, (SELECT count(*) FROM edges_c WHERE (graph_id, source_id) IN (SELECT (graph_id, id) FROM top) AND (graph_id, target_id) IN (SELECT (graph_id, id) FROM top)) AS edges FROM top GROUP BY 1")
def _(s, d):
    n = nodes(s, d)
    top, inside = qu.subgraph(scratch_table(n.orderBy("graph_id", "id").limit(200), "view"), edges(s, d), F.lit(True))
    return top.groupBy("type").agg(F.count("*").alias("nodes")).withColumn("edges", inside.agg(F.count("*").alias("n")).scalar())


@query("v15_related", q.with_(q.NODES, q.EDGES, _NEAR) + ", hit AS (SELECT graph_id, id FROM nodes_c WHERE contains(lower(label), 'watcher') OR contains(lower(type), 'watcher') OR contains(lower(name), 'watcher')) SELECT graph_id, id FROM hit UNION SELECT near.graph_id, neighbour FROM near JOIN hit USING (graph_id, id)")
def _(s, d):
    return viz.related(nodes(s, d), build.connected(edges(s, d)), "Watcher")


# risks
@query("r1_security")
def _(s, d):
    return risk.security_scan(elements(s, d))


@query("r2_circular", q.with_(q.EDGES, _CYCLE.format(types="'depends', 'imports'").replace("len(w.path) < 4", "len(w.path) < 10"), recursive=True) + _CYCLE_OUT.replace("AS length", "AS length, 'high' AS level"))
def _(s, d):
    return risk.circular_dependencies(edges(s, d), LONGEST_CYCLE).select("graph_id", joined("cycle"), "length", "level")


def _deep(k: int) -> str:
    e = "e1 AS (SELECT DISTINCT graph_id, source_id AS id, target_id AS up FROM edges_c WHERE type = 'inherits' AND source_id <> target_id), w1 AS (SELECT DISTINCT graph_id, id FROM e1)"
    steps = [f"w{i} AS (SELECT DISTINCT e1.graph_id, e1.id FROM e1 JOIN w{i - 1} w ON w.graph_id = e1.graph_id AND w.id = e1.up)" for i in range(2, k + 1)]
    return q.with_(q.NODES, q.EDGES, e, *steps) + f"SELECT graph_id, id FROM nodes_c WHERE type = 'class' AND (graph_id, id) IN (SELECT (graph_id, id) FROM w{k})"


@query("r3_deep_inheritance", _deep(2))
def _(s, d):
    return risk.deep_inheritance(nodes(s, d), edges(s, d), 2).select("graph_id", "id")


_DEF = "d AS (SELECT e.* FROM edges_c e JOIN nodes_c a ON a.graph_id = e.graph_id AND a.id = e.source_id AND a.type IN ('class', 'struct') JOIN nodes_c b ON b.graph_id = e.graph_id AND b.id = e.target_id AND b.type IN ('method', 'function') WHERE e.type = 'defines')"


@query("r4_god_class", q.with_(q.NODES, q.EDGES, _DEF) + "SELECT graph_id, source_id AS id, count(*) AS methods FROM d GROUP BY ALL HAVING count(*) > 1")
def _(s, d):
    return risk.god_classes(nodes(s, d), edges(s, d), 1)


_ENVY = """own AS (SELECT e.graph_id, e.target_id AS id, arg_min(e.source_id, e.id) AS owner FROM edges_c e JOIN nodes_c b ON b.graph_id = e.graph_id AND b.id = e.target_id AND b.type IN ('method', 'function') WHERE e.type = 'defines' GROUP BY ALL),
per AS (SELECT e.graph_id, e.source_id AS id, b.owner AS other, count(*) AS n FROM edges_c e JOIN own a ON a.graph_id = e.graph_id AND a.id = e.source_id JOIN own b ON b.graph_id = e.graph_id AND b.id = e.target_id WHERE e.type = 'calls' AND a.owner <> b.owner GROUP BY ALL)"""


@query("r5_feature_envy", q.with_(q.NODES, q.EDGES, _ENVY) + "SELECT graph_id, id, sum(n)::BIGINT AS calls, arg_min(other, (-n, other)) AS envied, round(max(n) / sum(n), 6) AS share FROM per GROUP BY graph_id, id HAVING sum(n) > 1 AND max(n) / sum(n) > 0.4")
def _(s, d):
    return risk.feature_envy(nodes(s, d), edges(s, d), 1, 0.4)


@query("r6_smells")
def _(s, d):
    n, e = scratch_table(nodes(s, d), "nodes"), scratch_table(edges(s, d), "edges")
    return risk.architecture_smells(n, e, max_depth=2, max_methods=1, least_calls=1, least_share=0.4).withColumn("measure", F.round("measure", 6))


@query("r6_by_kind", q.with_(q.NODES, q.EDGES, _DEF, _ENVY, _CYCLE.format(types="'depends', 'imports'").replace("len(w.path) < 4", "len(w.path) < 10"), recursive=True) + f"""SELECT 'circular_dependency' AS smell, count(*) AS n FROM ({_CYCLE_OUT}) HAVING count(*) > 0
  UNION ALL SELECT 'god_class', count(*) FROM (SELECT 1 FROM d GROUP BY graph_id, source_id HAVING count(*) > 1) HAVING count(*) > 0
  UNION ALL SELECT 'feature_envy', count(*) FROM (SELECT 1 FROM per GROUP BY graph_id, id HAVING sum(n) > 1 AND max(n) / sum(n) > 0.4) HAVING count(*) > 0
  UNION ALL SELECT 'deep_inheritance', count(*) FROM (SELECT DISTINCT a.graph_id, a.source_id FROM edges_c a JOIN edges_c b ON a.graph_id = b.graph_id AND a.target_id = b.source_id AND b.type = 'inherits' AND b.source_id <> b.target_id JOIN nodes_c n ON n.graph_id = a.graph_id AND n.id = a.source_id AND n.type = 'class' WHERE a.type = 'inherits' AND a.source_id <> a.target_id) HAVING count(*) > 0""")
def _(s, d):
    return QUERIES["r6_smells"](s, d).groupBy("smell").agg(F.count("*").alias("n"))


_SECURITY = " UNION ALL ".join(f"SELECT id, '{n}' AS rule, '{lv}' AS level, len(regexp_extract_all(text, '(?is)" + p.replace("'", "''") + "')) AS matches FROM t" for n, p, lv in SECURITY_RULES)


@query("r1_counts", q.with_(q.ELEMENTS, "t AS (SELECT id, CASE WHEN length(docstring) > 0 THEN docstring ELSE code END AS text FROM elements_c)") + f"SELECT id, rule, level, matches FROM ({_SECURITY}) WHERE matches > 0")
def _(s, d):
    return risk.security_scan(elements(s, d)).groupBy("id", "rule", "level").agg(F.count("*").alias("matches"))


_UP = "e1 AS (SELECT DISTINCT graph_id, source_id AS id, target_id AS up FROM edges_c WHERE type = 'inherits' AND source_id <> target_id), w1 AS (SELECT DISTINCT graph_id, id FROM e1), " + ", ".join(f"w{i} AS (SELECT DISTINCT e1.graph_id, e1.id FROM e1 JOIN w{i - 1} w ON w.graph_id = e1.graph_id AND w.id = e1.up)" for i in range(2, 4))


@query("r9_report", q.with_(q.ELEMENTS, q.NODES, q.EDGES, _DEF, _ENVY, _UP, "t AS (SELECT id, CASE WHEN length(docstring) > 0 THEN docstring ELSE code END AS text FROM elements_c)", _CYCLE.format(types="'depends', 'imports'").replace("len(w.path) < 4", "len(w.path) < 10"), recursive=True) + f"""SELECT * FROM (
  SELECT 'security' AS category, rule AS kind, level, sum(matches)::BIGINT AS findings FROM ({_SECURITY}) GROUP BY rule, level
  UNION ALL SELECT 'architecture', 'circular_dependency', 'high', count(*) FROM ({_CYCLE_OUT})
  UNION ALL SELECT 'architecture', 'god_class', 'high', count(*) FROM (SELECT 1 FROM d GROUP BY graph_id, source_id HAVING count(*) > 2)
  UNION ALL SELECT 'architecture', 'feature_envy', 'medium', count(*) FROM (SELECT 1 FROM per GROUP BY graph_id, id HAVING sum(n) > 2 AND max(n) / sum(n) > 0.5)
  UNION ALL SELECT 'architecture', 'deep_inheritance', 'medium', count(*) FROM nodes_c WHERE type = 'class' AND (graph_id, id) IN (SELECT (graph_id, id) FROM w3)
  UNION ALL SELECT 'quality', 'complex_functions', 'medium', count(*) FROM (SELECT 1 FROM nodes_c WHERE type IN ('method', 'function') GROUP BY graph_id HAVING count(*) FILTER (complexity > 10) > 0 OR coalesce(round(avg(complexity) FILTER (complexity > 0), 6), 0) > 8)) WHERE findings > 0""")
def _(s, d):
    n, e = scratch_table(nodes(s, d), "nodes"), scratch_table(edges(s, d), "edges")
    return risk.enhanced_report(elements(s, d), n, e, max_depth=3, max_methods=2, least_calls=2, least_share=0.5)


@query("r13_categories", q.with_(q.ISSUES) + "SELECT category, count(*) AS issues, count(DISTINCT level) AS levels FROM issues_c GROUP BY 1")
def _(s, d):
    return risk.categories(issues(s, d))


@query("e18_risk_context", q.with_(q.NODES, q.EDGES, q.ISSUES) + "SELECT (SELECT count(*) FROM nodes_c) AS nodes, (SELECT count(*) FROM edges_c) AS edges, (SELECT count(*) FROM issues_c) AS issues, (SELECT count(*) FROM issues_c WHERE level IN ('critical', 'high')) AS high_issues, (SELECT count(*) FROM nodes_c WHERE regexp_matches(lower(label), 'auth|login|password|token|session|database|sql|query|connection')) AS keyword_components")
def _(s, d):
    return risk.risk_context(nodes(s, d), edges(s, d), issues(s, d))


@query("r7_quality", q.with_(q.NODES) + "SELECT graph_id, count(*) AS functions, round(avg(complexity) FILTER (complexity > 0), 6) AS mean_complexity, count(*) FILTER (complexity > 3) AS too_complex, greatest(0, 100 - least(5 * count(*) FILTER (complexity > 3), 30)) AS score, count(*) FILTER (complexity > 3) > 0 OR coalesce(round(avg(complexity) FILTER (complexity > 0), 6), 0) > 8 AS advice FROM nodes_c WHERE type IN ('method', 'function') GROUP BY graph_id")
def _(s, d):
    return risk.quality(nodes(s, d), 3)


@query("r8_report", q.with_(q.ISSUES) + "SELECT category, level, count(*) AS issues, count(DISTINCT file_path) AS files FROM issues_c GROUP BY 1, 2")
def _(s, d):
    return risk.issue_report(issues(s, d))


@query("r10_standardised", q.with_(q.ISSUES) + "SELECT id, title, category, level, file_path, line_number, element_id FROM issues_c")
def _(s, d):
    return issues(s, d).drop("detected_at")


@query("r11_high_risk_files", q.with_(q.ISSUES) + "SELECT file_path, count(*) AS issues FROM issues_c WHERE file_path IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(s, d):
    return risk.high_risk_files(issues(s, d))


@query("r12_keyword_components", q.with_(q.NODES) + "SELECT * FROM (SELECT graph_id, id, label, CASE WHEN regexp_matches(lower(label), 'auth|login|password|token|session') THEN 'authentication' WHEN regexp_matches(lower(label), 'database|sql|query|connection') THEN 'data access' END AS component FROM nodes_c) WHERE component IS NOT NULL")
def _(s, d):
    return risk.keyword_components(nodes(s, d))


@query("r14_filtered", q.with_(q.ISSUES) + "SELECT level, count(*) AS issues FROM issues_c WHERE level IN ('critical', 'high') AND category = 'security' GROUP BY 1")
def _(s, d):
    return risk.filter_issues(issues(s, d), ["critical", "high"], ["security"])


# changes
_WATCH = r"regexp_matches(path, '\.(py|java|js|jsx|ts|tsx|go|json|yaml|yml|properties|sh)$') AND NOT regexp_matches(path, '(^|/)(\.git|node_modules|__pycache__|\.venv|venv|dist|build|target|\.idea|\.vscode|\.pytest_cache)(/|$)')"


@query("t2_watched", q.with_(q.CHANGES) + f"SELECT path, change_type, count(*) AS n FROM changes_c WHERE {_WATCH} GROUP BY 1, 2")
def _(s, d):
    return ch.watched(log(s, d)).groupBy("path", "change_type").agg(F.count("*").alias("n"))


@query("t1_detected", q.with_(q.CHANGES) + """, snap AS (SELECT path, arg_max(coalesce(file_hash, ''), (ts, change_type, coalesce(file_hash, ''))) AS h, arg_max(change_type, (ts, change_type, coalesce(file_hash, ''))) AS c, part FROM (SELECT path, change_type, ts, file_hash, unnest([1, 2]) AS part FROM changes_c) WHERE part = 2 OR ts < TIMESTAMP '2025-07-01' GROUP BY path, part),
a AS (SELECT * FROM snap WHERE part = 1 AND c <> 'deleted'), b AS (SELECT * FROM snap WHERE part = 2 AND c <> 'deleted')
SELECT * FROM (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'created' WHEN b.path IS NULL THEN 'deleted' WHEN a.h IS DISTINCT FROM b.h THEN 'modified' END AS change_type FROM a FULL JOIN b ON a.path = b.path) WHERE change_type IS NOT NULL""")
def _(s, d):
    c = log(s, d).withColumn("old_path", F.lit(None).cast("string"))
    snap = lambda x: ch.snapshot(x).where("change_type <> 'deleted'").select("path", F.col("file_hash").alias("hash"))
    return ch.detect(snap(c.where("ts < TIMESTAMP '2025-07-01'")), snap(c))


@query("t3_debounced", q.with_(q.CHANGES) + "SELECT path, change_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM (SELECT *, lead(ts) OVER (PARTITION BY path ORDER BY ts, change_type, coalesce(file_hash, '')) AS nxt FROM changes_c) WHERE nxt IS NULL OR nxt - ts >= INTERVAL '1 hour'")
def _(s, d):
    return ch.debounced(log(s, d), 3600).select("path", "change_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


@query("t4_snapshot", q.with_(q.CHANGES) + """SELECT path, arg_max(change_type, (ts, change_type, h)) AS change_type, arg_max(h, (ts, change_type, h)) AS file_hash FROM (SELECT path, change_type, ts, coalesce(file_hash, '') AS h FROM changes_c
  UNION ALL SELECT old_path, 'deleted', ts, '' FROM changes_c WHERE change_type = 'moved' AND old_path IS NOT NULL) GROUP BY path""")
def _(s, d):
    return ch.snapshot(log(s, d)).select("path", "change_type", "file_hash")


@query("t5_update", q.with_(q.ELEMENTS) + f", o AS (SELECT DISTINCT file_path, {q.clean('id')} AS id FROM elements WHERE {q.clean('id')} IS NOT NULL AND recorded_at < TIMESTAMP '2025-02-15'), n AS (SELECT DISTINCT file_path, {q.clean('id')} AS id FROM elements WHERE {q.clean('id')} IS NOT NULL AND (deleted_at IS NULL OR deleted_at > TIMESTAMP '2025-06-01')) SELECT coalesce(o.file_path, n.file_path) AS file_path, coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'updated' END AS action FROM o FULL JOIN n ON o.file_path = n.file_path AND o.id = n.id")
def _(s, d):
    from graphloom.operators.orphans import clean_id

    e = table(s, d, "elements").withColumn("id", clean_id(F.col("id"))).where("id IS NOT NULL")
    old, new = e.where("recorded_at < TIMESTAMP '2025-02-15'"), e.where("deleted_at IS NULL OR deleted_at > TIMESTAMP '2025-06-01'")
    return ch.file_update(old.select("file_path", "id").distinct(), new.select("file_path", "id").distinct())


_GONE = "gone AS (SELECT path FROM (SELECT path, arg_max(change_type, (ts, change_type, coalesce(file_hash, ''))) AS c FROM changes_c GROUP BY path) WHERE c = 'deleted'), dead AS (SELECT graph_id, id FROM nodes_c WHERE file_path IN (SELECT path FROM gone))"


@query("t6_deleted_files", q.with_(q.NODES, q.EDGES, q.CHANGES, _GONE) + "SELECT graph_id, id FROM edges_c WHERE (graph_id, source_id) IN (SELECT (graph_id, id) FROM dead) OR (graph_id, target_id) IN (SELECT (graph_id, id) FROM dead)")
def _(s, d):
    n, e = nodes(s, d), edges(s, d)
    gone = ch.snapshot(log(s, d).withColumn("old_path", F.lit(None).cast("string"))).where("change_type = 'deleted'").select(F.col("path").alias("file_path"))
    dead = n.join(gone, "file_path", "left_semi").select("graph_id", "id")
    return e.join(qu.remove_nodes(n, e, dead)[1].select("id"), "id", "left_anti").select("graph_id", "id")


@query("t7_dependents", q.with_(q.NODES, q.EDGES, q.ROOTS, *q.reach("dep", 3, "target_id", "source_id")).replace("FROM edges_c WHERE source_id <> target_id GROUP BY ALL", "FROM edges_c WHERE source_id <> target_id AND type IN ('calls', 'depends', 'inherits') GROUP BY ALL") + "SELECT graph_id, root, id, distance FROM dep WHERE distance > 0")
def _(s, d):
    n = nodes(s, d)
    step = tr.steps(scratch_table(edges(s, d), "edges"), "in", ["calls", "depends", "inherits"])
    return tr.reach(step, roots(n), 3).where("distance > 0").select("graph_id", "root", "id", "distance")


@query("t8_mapping", q.with_(q.ELEMENTS) + "SELECT file_path, count(DISTINCT id) AS elements, min(id) AS first, max(id) AS last FROM elements_c GROUP BY 1")
def _(s, d):
    return ch.file_mapping(elements(s, d))


@query("t9_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def _(s, d):
    return ch.windowed_counts(table(s, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("t9_sessions", """SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (
  SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL '30 minutes' THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, k""")
def _(s, d):
    f = "yyyy-MM-dd HH:mm:ss"
    return ch.sessions(table(s, d, "events")).select("user_id", F.date_format("start", f).alias("start"), F.date_format("last", f).alias("last"), "events")


# search
_TYPES = "CASE " + " ".join("WHEN regexp_matches(lower(text), '" + p + f"') THEN '{n}'" for n, p in search.QUESTION_TYPES) + " ELSE 'general' END"


@query("q1_question_types", f"SELECT {_TYPES} AS question_type, count(*) AS n FROM documents WHERE text IS NOT NULL AND doc_kind = 'qa' GROUP BY 1")
def _(s, d):
    return table(s, d, "documents").where("text IS NOT NULL AND doc_kind = 'qa'").select(search.question_type(F.col("text")).alias("question_type")).groupBy("question_type").agg(F.count("*").alias("n"))


_STOP = "[" + ", ".join(f"'{w}'" for w in search.STOP_WORDS) + "]"
_KEYS = f"SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '([a-z_][a-z0-9_]*|[一-鿿]+)', 1), lambda w: length(w) > 1 AND NOT list_contains({_STOP}, w))) AS keywords FROM eval_items WHERE text IS NOT NULL"


@query("q2_keywords", f"SELECT item_id, array_to_string(list_sort(keywords), ',') AS keywords FROM ({_KEYS})")
def _(s, d):
    return table(s, d, "eval_items").where("text IS NOT NULL").select("item_id", F.array_join(F.array_sort(search.keywords(F.col("text"))), ",").alias("keywords"))


_MATCH = f"""keys AS ({_KEYS}), k AS (SELECT item_id AS question_id, unnest(keywords) AS keyword FROM keys),
nm AS (SELECT graph_id, id, lower(name) AS lname FROM nodes_c WHERE name <> ''),
best AS (SELECT keyword, lname, CASE WHEN keyword = lname THEN 1.0::DOUBLE WHEN contains(lname, keyword) THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS score FROM (SELECT DISTINCT keyword FROM k) a JOIN (SELECT DISTINCT lname FROM nm) b ON contains(lname, keyword) OR contains(keyword, lname)),
m AS (SELECT question_id, graph_id, id, keyword, score FROM k JOIN best USING (keyword) JOIN nm USING (lname))"""


def _matches(s, d):
    qs = table(s, d, "eval_items").where("text IS NOT NULL").select(F.col("item_id").alias("question_id"), search.keywords(F.col("text")).alias("keywords"))
    return search.match_names(qs, nodes(s, d))


@query("q3_matches", q.with_(q.NODES, _MATCH) + "SELECT question_id, count(*) AS matches, count(DISTINCT keyword) AS words, round(sum(score), 6) AS score FROM m GROUP BY 1")
def _(s, d):
    return _matches(s, d).groupBy("question_id").agg(F.count("*").alias("matches"), F.countDistinct("keyword").alias("words"), F.round(F.sum("score"), 6).alias("score"))


@query("q4_by_type", q.with_(q.NODES) + "SELECT graph_id, id, type, name FROM nodes_c WHERE type IN ('class', 'interface') ORDER BY graph_id, id LIMIT 10")
def _(s, d):
    return search.by_question_type(nodes(s, d), "inheritance")


@query("q6_ranked", q.with_(q.NODES, _MATCH) + f"""SELECT * FROM (SELECT question_id, graph_id, id, type, name, hits, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, graph_id, id) AS rank FROM (
  SELECT question_id, graph_id, id, n.type, n.name, count(DISTINCT keyword) AS hits, round(sum(score) * {q.case(search.TYPE_WEIGHT, 'n.type', 1.0)}, 6) AS score FROM m JOIN nodes_c n USING (graph_id, id) GROUP BY question_id, graph_id, id, n.type, n.name)) WHERE rank <= 20""")
def _(s, d):
    return search.rank_matches(_matches(s, d), nodes(s, d))


_KIND_TYPES = ", ".join(f"('{k}', ['" + "', '".join(t) + "'])" for k, t in search.TYPES_FOR.items())


@query("q7_locate", q.with_(q.NODES, _MATCH, f"kinds AS (SELECT item_id AS question_id, {_TYPES} AS kind FROM eval_items WHERE text IS NOT NULL)", f"tf AS (SELECT * FROM (VALUES {_KIND_TYPES}) t(kind, types))",
    "typed AS (SELECT kind, graph_id, id FROM (SELECT kind, graph_id, id, row_number() OVER (PARTITION BY kind ORDER BY graph_id, id) AS r FROM tf JOIN nodes_c ON list_contains(types, type)) WHERE r <= 10)",
    "every AS (SELECT question_id, graph_id, id, keyword, score FROM m UNION ALL SELECT question_id, graph_id, id, '', 0.3::DOUBLE FROM kinds JOIN typed USING (kind))") + f"""SELECT * FROM (SELECT question_id, graph_id, id, type, name, hits, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, graph_id, id) AS rank FROM (
  SELECT question_id, graph_id, id, n.type, n.name, count(DISTINCT keyword) AS hits, round(sum(score) * {q.case(search.TYPE_WEIGHT, 'n.type', 1.0)}, 6) AS score FROM every JOIN nodes_c n USING (graph_id, id) GROUP BY question_id, graph_id, id, n.type, n.name)) WHERE rank <= 20""")  # fmt: skip
def _(s, d):
    return search.locate(table(s, d, "eval_items").where("text IS NOT NULL").select(F.col("item_id").alias("question_id"), "text"), nodes(s, d))


@query("q8_callers", q.with_(q.EDGES) + ", c AS (SELECT DISTINCT graph_id, target_id AS id, source_id AS caller FROM edges_c WHERE lower(type) IN ('calls', 'uses', 'depends')) SELECT graph_id, id, string_agg(caller, ',' ORDER BY caller) FILTER (r <= 10) AS callers, count(*) AS all FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, id ORDER BY caller) AS r FROM c) GROUP BY 1, 2".replace(" AS all", ' AS "all"'))
def _(s, d):
    return search.calls(edges(s, d))


@query("q10_context", q.with_(q.NODES) + "SELECT graph_id, type, count(*) AS nodes, count(DISTINCT file_path) AS files, min(complexity) AS least, max(complexity) AS most, round(avg(complexity), 6) AS mean FROM nodes_c GROUP BY 1, 2")
def _(s, d):
    return search.context_statistics(nodes(s, d))


@query("q11_confidence", q.with_(q.NODES, _MATCH) + "SELECT question_id, round(least(1.0::DOUBLE, hits::DOUBLE / (words * elements) * CASE WHEN elements >= 3 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END), 6) AS confidence FROM (SELECT question_id, count(*) AS hits, count(DISTINCT keyword) AS words, count(DISTINCT (graph_id, id)) AS elements FROM m GROUP BY 1)")
def _(s, d):
    x = _matches(s, d).groupBy("question_id").agg(F.count("*").alias("hits"), F.countDistinct("keyword").alias("words"), F.countDistinct("graph_id", "id").alias("elements"))
    return x.select("question_id", F.round(search.confidence(F.col("hits"), F.col("words"), F.col("elements")), 6).alias("confidence"))


@query("q5_cosine", "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_transform(range(64), lambda i: (i % 7 - 3)::DOUBLE)), 6) AS cosine FROM embeddings ORDER BY cosine DESC, vec_id LIMIT 10")
def _(s, d):
    v = table(s, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return search.cosine_top(v, [float(i % 7 - 3) for i in range(64)])


_CALLS = "c AS (SELECT DISTINCT graph_id, target_id AS id, source_id AS caller FROM edges_c WHERE lower(type) IN ('calls', 'uses', 'depends')), k AS (SELECT graph_id, caller AS id, id AS callee FROM c)"
_TOP = "string_agg({0}, ',' ORDER BY {0}) FILTER (r <= 10) AS {1} FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, id ORDER BY {0}) AS r FROM {2}) GROUP BY 1, 2"


@query("q9_call_chains", q.with_(q.NODES, q.EDGES, q.ROOTS, _CALLS, "up AS (SELECT graph_id, id, " + _TOP.format("caller", "up", "c") + ")", "down AS (SELECT graph_id, id, " + _TOP.format("callee", "down", "k") + ")") + "SELECT graph_id, root AS id, concat_ws(',', up, root) AS callers, concat_ws(',', root, down) AS callees FROM roots LEFT JOIN up ON up.graph_id = roots.graph_id AND up.id = root LEFT JOIN down ON down.graph_id = roots.graph_id AND down.id = root".replace("SELECT graph_id, root", "SELECT roots.graph_id, root"))
def _(s, d):
    return search.call_chains(edges(s, d), roots(nodes(s, d)).withColumnRenamed("root", "id"))


@query("q12_answers", q.with_(q.NODES, _MATCH) + f"SELECT item_id AS question_id, {_TYPES} AS question_type, coalesce(round(least(1.0::DOUBLE, hits::DOUBLE / (words * elements) * CASE WHEN elements >= 3 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END), 6), 0.0::DOUBLE) AS confidence FROM eval_items LEFT JOIN (SELECT question_id, count(*) AS hits, count(DISTINCT keyword) AS words, count(DISTINCT (graph_id, id)) AS elements FROM m GROUP BY 1) ON question_id = item_id WHERE text IS NOT NULL")
def _(s, d):
    qs = table(s, d, "eval_items").where("text IS NOT NULL").select(F.col("item_id").alias("question_id"), "text")
    return search.answer_context(qs, nodes(s, d)).select("question_id", "question_type", F.round("confidence", 6).alias("confidence"))


# documentation
_SIG = "'def ' || name || '(' || coalesce(array_to_string(parameters, ', '), '') || ')' || CASE WHEN length(return_type) > 0 THEN ' -> ' || return_type ELSE '' END || ':'"


@query("a5_signatures", q.with_(q.ELEMENTS) + f"SELECT id, {_SIG} AS signature FROM elements_c WHERE type IN ('function', 'method')")
def _(s, d):
    e = elements(s, d).where("type IN ('function', 'method')")
    return e.select("id", tx.signature(F.col("name"), F.col("parameters"), F.col("return_type")).alias("signature"))


@query("a1_prompts", q.with_(q.ELEMENTS) + f"SELECT id, concat_ws(chr(10), concat_ws(': ', 'Name', name), concat_ws(': ', 'Type', type), concat_ws(': ', 'File', file_path), 'Signature: ' || {_SIG}) AS prompt FROM elements_c")
def _(s, d):
    return tx.element_prompt(elements(s, d))


@query("a3_module_dependencies", q.with_(q.NODES, q.EDGES) + "SELECT e.graph_id, a.file_path AS file, count(DISTINCT CASE WHEN b.file_path <> a.file_path THEN b.file_path END) AS internal, count(DISTINCT CASE WHEN b.file_path IS NULL THEN e.target_id END) AS external FROM edges_c e JOIN nodes_c a ON a.graph_id = e.graph_id AND a.id = e.source_id LEFT JOIN nodes_c b ON b.graph_id = e.graph_id AND b.id = e.target_id WHERE e.type IN ('imports', 'depends') GROUP BY 1, 2")
def _(s, d):
    return tx.module_dependencies(edges(s, d), nodes(s, d))


@query("a6_sections", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '(?m)^#+[ \t]+([^\r\n]+)$', 1), '|') AS headings FROM documents WHERE doc_kind = 'readme' AND text IS NOT NULL")
def _(s, d):
    x = table(s, d, "documents").where("doc_kind = 'readme' AND text IS NOT NULL")
    return x.select("doc_id", F.array_join(tx.headings(F.col("text")), "|").alias("headings"))


_MODULE = """lines AS (SELECT file_path, line_number, id, CASE WHEN type IN ('class', 'struct', 'interface') THEN '## Class ' ELSE '### ' END || coalesce(name, '') || CASE WHEN length(docstring) > 0 THEN ': ' || regexp_extract(docstring, '([^\\n.]+)', 1) ELSE '' END AS line
  FROM elements_c WHERE type IN ('class', 'struct', 'interface', 'function', 'method') AND file_path IS NOT NULL),
docs AS (SELECT file_path, '# ' || file_path || chr(10) || string_agg(line, chr(10) ORDER BY line_number NULLS FIRST, id) AS document FROM lines GROUP BY file_path)"""


@query("a6_modules", q.with_(q.ELEMENTS, _MODULE) + "SELECT * FROM docs")
def _(s, d):
    return tx.module_documents(elements(s, d))


_SIG0 = _SIG.replace("|| name ||", "|| coalesce(name, '') ||")


@query("a6_classes", q.with_(q.ELEMENTS, "c AS (SELECT id, '# ' || coalesce(name, '') || CASE WHEN length(docstring) > 0 THEN chr(10) || docstring ELSE '' END AS head FROM elements_c WHERE type IN ('class', 'struct', 'interface'))",
    f"g AS (SELECT lower(trim(parent_id)) AS up, line_number AS n, id AS k, '- ' || {_SIG0} AS line FROM elements_c WHERE type IN ('function', 'method') AND parent_id IS NOT NULL)",
    "l AS (SELECT up AS id, string_agg(line, chr(10) ORDER BY n NULLS FIRST, k) AS lines FROM g GROUP BY up)") + "SELECT c.id, head || coalesce(chr(10) || lines, '') AS document FROM c LEFT JOIN l ON l.id = c.id")
def _(s, d):
    return tx.class_documents(elements(s, d))


@query("a6_html", q.with_(q.ELEMENTS, _MODULE) + r"SELECT file_path, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(document, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?m)^### ([^\n]*)', '<h3>\1</h3>', 'g'), '(?m)^## ([^\n]*)', '<h2>\1</h2>', 'g'), '(?m)^# ([^\n]*)', '<h1>\1</h1>', 'g'), '(?m)^- ([^\n]*)', '<li>\1</li>', 'g'), '\*\*([^*\n]+)\*\*', '<b>\1</b>', 'g'), '`([^`\n]+)`', '<code>\1</code>', 'g') AS html FROM docs")
def _(s, d):
    return tx.module_documents(elements(s, d)).select("file_path", tx.to_html(F.col("document")).alias("html"))


@query("a7_truncated", "SELECT doc_id, CASE WHEN length(text) > 100 THEN text[1:97] || '...' ELSE text END AS head FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", tx.truncate(F.col("text"), 100).alias("head"))


# operations
@query("c4_hot_nodes", q.with_(q.NODES, q.EDGES, q.DEGREES, _NEAR) + "SELECT t.graph_id, t.id, total_degree, count(near.neighbour) AS neighbours FROM (SELECT graph_id, id, coalesce(i, 0) + coalesce(o, 0) AS total_degree FROM nodes_c LEFT JOIN deg USING (graph_id, id) ORDER BY 3 DESC, 1, 2 LIMIT 10) t LEFT JOIN near ON near.graph_id = t.graph_id AND near.id = t.id GROUP BY ALL")
def _(s, d):
    e = edges(s, d)
    return ops.hot_nodes(build.node_metrics(nodes(s, d), e), build.connected(e))


@query("c2_ttl", "SELECT event_type, (CASE event_type WHEN 'click' THEN 1800 ELSE 1800 END * CASE WHEN n > 1000 THEN 1.5 WHEN n > 100 THEN 1.2 ELSE 1.0 END)::INT AS ttl FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def _(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", ops.ttl(F.col("event_type"), F.col("n")).alias("ttl"))


_HOURLY = "SELECT date_trunc('hour', ts) AS hour, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(100 * count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate, round(avg(value), 6) AS mean_value, max(value) AS max_value FROM events GROUP BY 1"


@query("m4_hourly", f"SELECT strftime(hour, '%Y-%m-%d %H') AS hour, * EXCLUDE (hour) FROM ({_HOURLY})")
def _(s, d):
    return ops.hourly_metrics(table(s, d, "events")).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


@query("m4_recent_mean", "SELECT event_id, user_id, sum(round(value * 1000000)::BIGINT) OVER w / count(value) OVER w / 1000000 AS recent_mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)")
def _(s, d):
    return ops.recent_mean(table(s, d, "events"))


_ALERTS = """b AS (SELECT user_id, ts, event_id, value, coalesce(value > 5, false) AS bad FROM events), g AS (SELECT *, CASE WHEN bad AND NOT coalesce(lag(bad) OVER (PARTITION BY user_id ORDER BY ts), false) THEN 1 ELSE 0 END AS new FROM b),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)"""


@query("m5_alerts", q.with_(_ALERTS) + "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, round(max(value), 6) AS peak, (epoch(date_trunc('second', max(ts)))::BIGINT - epoch(date_trunc('second', min(ts)))::BIGINT - 3600) // 86400 + 1 AS alerts FROM r WHERE bad GROUP BY user_id, run HAVING epoch(date_trunc('second', max(ts)))::BIGINT - epoch(date_trunc('second', min(ts)))::BIGINT >= 3600")
def _(s, d):
    a = ops.alerts(table(s, d, "events"), "ts", "value", 5.0, 3600, 86400, by=["user_id"])
    return a.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.round("peak", 6).alias("peak"), "alerts")


@query("m2_summary", "SELECT event_type, n, mean, max, CASE WHEN mean >= 95 THEN 'critical' WHEN mean >= 80 THEN 'warning' ELSE 'normal' END AS status FROM (SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS max FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1440 MINUTES GROUP BY 1)")
def _(s, d):
    return ops.recent_summary(table(s, d, "events"), 1440)


@query("m3_growth", "SELECT event_type, strftime(start, '%Y-%m-%d %H') AS start, n, before FROM (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY start) AS before FROM (SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2)) WHERE n - before >= 5")
def _(s, d):
    return ops.growth(table(s, d, "events"), 60, 5).withColumn("start", F.date_format("start", "yyyy-MM-dd HH"))


@query("m8_error_alerts", "SELECT event_type AS kind, count(*) AS errors, count(*) >= 20 AS alert FROM events GROUP BY 1")
def _(s, d):
    return ops.error_alerts(table(s, d, "events").withColumnRenamed("event_type", "kind"))


@query("m10_rate_limited", "SELECT event_id, user_id, recent FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM events) WHERE recent > 4")
def _(s, d):
    return ops.rate_limited(table(s, d, "events"), 4, 86400)


# stores and parsing
@query("s9_graphs", q.with_(q.NODES, q.EDGES) + "SELECT coalesce(n.graph_id, e.graph_id) AS graph_id, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges FROM (SELECT graph_id, count(*) AS nodes FROM nodes_c GROUP BY 1) n FULL JOIN (SELECT graph_id, count(*) AS edges FROM edges_c GROUP BY 1) e ON n.graph_id = e.graph_id")
def _(s, d):
    return store.list_graphs(nodes(s, d), edges(s, d))


@query("s10_round_trip", q.with_(q.NODES) + "SELECT graph_id, id, label, type, name, file_path, line_number, complexity FROM nodes_c")
def _(s, d):
    return store.import_rows(store.export_rows(nodes(s, d)))


@query("s8_documents")
def _(s, d):
    return store.graph_documents(nodes(s, d), edges(s, d))


_X = lambda c: "replace(replace(replace(replace(coalesce(" + c + ", ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;')"


@query("s12_graphml", q.with_(q.NODES, q.EDGES) + f"SELECT graph_id, 'node' AS part, id, '<node id=\"' || {_X('id')} || '\"><data key=\"label\">' || {_X('label')} || '</data><data key=\"type\">' || {_X('type')} || '</data></node>' AS xml FROM nodes_c UNION ALL SELECT graph_id, 'edge', id, '<edge id=\"' || {_X('id')} || '\" source=\"' || {_X('source_id')} || '\" target=\"' || {_X('target_id')} || '\"><data key=\"type\">' || {_X('type')} || '</data></edge>' FROM edges_c")
def _(s, d):
    return store.graphml_rows(nodes(s, d), edges(s, d))


@query("s14_retained", "SELECT id, name, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM (SELECT event_id AS id, user_id AS name, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS n, max(ts) OVER (PARTITION BY user_id) AS last FROM events) WHERE n <= 30 AND ts >= last - INTERVAL 7 DAYS")
def _(s, d):
    b = table(s, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("name"), "ts")
    return store.retained(b).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def parsed(s, d):
    return parse.parse_texts(table(s, d, "source_files").where("content IS NOT NULL AND length(content) > 0"))


@query("x1_parsed_elements")
def _(s, d):
    return parse.element_rows(parsed(s, d)).select("id", "file_path", "name", "type", "line_number", "end_line_number", "complexity", "visibility", "return_type", "parent")


@query("x2_import_graph")
def _(s, d):
    return parse.import_edges(parsed(s, d))


@query("x3_relationships")
def _(s, d):
    e = scratch_table(parse.element_rows(parsed(s, d)), "elements")
    files = scratch_table(parsed(s, d), "parsed")
    imports = parse.import_edges(files).select(F.col("source_file").alias("source_id"), F.col("target_file").alias("target_id"), F.lit("imports").alias("type"))
    usage = parse.cross_file_usage(e, files).select("source_id", "target_id", F.lit("uses").alias("type"))
    every = parse.inheritance(e)
    for part in (parse.call_edges(e), parse.defines(e), parse.cross_file_inheritance(e), parse.dependencies(e), parse.compositions(e), imports, usage):
        every = every.unionByName(part)
    return every.groupBy("source_id", "target_id", "type").agg(F.count("*").alias("sites"))


@query("x4_usage")
def _(s, d):
    return parse.cross_file_usage(scratch_table(parse.element_rows(parsed(s, d)), "elements"), scratch_table(parsed(s, d), "parsed"))


@query("x3_types")
def _(s, d):
    e = scratch_table(parse.element_rows(parsed(s, d)), "elements")
    return parse.dependencies(e).unionByName(parse.compositions(e))


@query("x6_file_cycles")
def _(s, d):
    return parse.file_cycles(parse.import_edges(parsed(s, d), itself=True)).select(joined("cycle"), "length")


@query("e7_call_kinds")
def _(s, d):
    return parse.call_kinds(parse.element_rows(parsed(s, d)))


@query("e19_project")
def _(s, d):
    return parse.project_summary(parsed(s, d))


@query("a4_class_split")
def _(s, d):
    return parse.class_split(scratch_table(parse.element_rows(parsed(s, d)), "elements"))


@query("x5_exports")
def _(s, d):
    return parse.exports(parse.element_rows(parsed(s, d)))

"""Common table expressions of the queries' SQL."""

from __future__ import annotations

from graphloom.schema import HOP_WEIGHT, NODE_COEFFICIENT


def clean(c: str) -> str:
    return f"nullif(lower(trim({c}, chr(32) || chr(9))), '')"


def case(values: dict, key: str, other) -> str:
    return f"(CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + f" ELSE {other}::DOUBLE END)"


NODES = f"""nodes_c AS (SELECT graph_id, cid AS id, label, type, element_id, name, file_path, line_number, complexity, visibility, docstring FROM (
  SELECT *, {clean('id')} AS cid, row_number() OVER (PARTITION BY graph_id, {clean('id')} ORDER BY created_at DESC NULLS LAST) AS rn FROM nodes)
  WHERE rn = 1 AND cid IS NOT NULL AND graph_id IS NOT NULL)"""
EDGES = f"""edges_c AS (SELECT * FROM (SELECT DISTINCT ON (id) graph_id, id, {clean('source_id')} AS source_id, {clean('target_id')} AS target_id, type, strength, call_count, context, line_number FROM edges)
  WHERE graph_id IS NOT NULL AND source_id IS NOT NULL AND target_id IS NOT NULL)"""
ELEMENTS = f"""elements_c AS (SELECT * EXCLUDE (rn, id, cid), cid AS id FROM (
  SELECT *, {clean('id')} AS cid, row_number() OVER (PARTITION BY {clean('id')} ORDER BY recorded_at DESC NULLS LAST) AS rn FROM elements) WHERE rn = 1 AND cid IS NOT NULL)"""
RELATIONSHIPS = f"""rels_c AS (SELECT DISTINCT ON (id) id, {clean('source_id')} AS source_id, {clean('target_id')} AS target_id, type, strength, call_count, context FROM relationships)"""
ISSUES = """issues_c AS (SELECT DISTINCT ON (id) id, title, coalesce(lower(trim(category)), 'quality') AS category,
  CASE WHEN lower(trim(level)) IN ('critical', 'high', 'medium', 'low') THEN lower(trim(level)) ELSE 'low' END AS level, file_path, line_number, element_id, detected_at FROM issues)"""
CHANGES = "changes_c AS (SELECT DISTINCT path, lower(trim(change_type)) AS change_type, ts, old_path, file_hash FROM changes WHERE path IS NOT NULL AND ts IS NOT NULL)"
ROOTS = "roots AS (SELECT DISTINCT graph_id, id AS root FROM nodes_c WHERE ('0x' || substr(md5(id), 1, 6))::BIGINT % 20 = 0)"
DEGREES = """deg AS (SELECT graph_id, id, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o FROM (
  SELECT graph_id, target_id AS id, 1 AS i, 0 AS o FROM edges_c UNION ALL SELECT graph_id, source_id, 0, 1 FROM edges_c WHERE source_id <> target_id) GROUP BY ALL)"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(ctes) + "\n"


def reach(name: str, depth: int, source: str, target: str) -> list[str]:
    """Levels 0 to depth of a scored traversal from ``roots``, and their union under ``name``."""
    w = f"max({case(HOP_WEIGHT, 'type', 0.5)} * coalesce(strength, 0.5::DOUBLE))"
    out = [
        f"{name}_hop AS (SELECT graph_id, {source} AS id, {target} AS nxt, {w} AS w FROM edges_c WHERE source_id <> target_id GROUP BY ALL)",
        f"{name}0 AS (SELECT graph_id, root, root AS id, 0 AS distance, {{'s': 1.0::DOUBLE, 'p': [root]}} AS b FROM roots)",
    ]
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT graph_id, root, id FROM {name}{k}" for k in range(d))
        out.append(
            f"{name}{d} AS (SELECT f.graph_id, f.root, h.nxt AS id, {d} AS distance, max({{'s': f.b.s * h.w, 'p': list_append(f.b.p, h.nxt)}}) AS b FROM {name}{d - 1} f JOIN {name}_hop h ON f.graph_id = h.graph_id AND f.id = h.id "
            f"WHERE (f.graph_id, f.root, h.nxt) NOT IN ({seen}) GROUP BY ALL)"
        )
    return [*out, f"{name} AS ({' UNION ALL '.join(f'SELECT * FROM {name}{k}' for k in range(depth + 1))})"]


def shortest(depth: int) -> list[str]:
    """Shortest paths from ``roots`` with the first path in order, as ``way``."""
    out = [
        "way_hop AS (SELECT e.graph_id, e.source_id AS id, e.target_id AS nxt, arg_min(coalesce(e.strength, 1.0::DOUBLE), e.id) AS w FROM edges_c e WHERE e.source_id <> e.target_id GROUP BY e.graph_id, e.source_id, e.target_id)",
        "way0 AS (SELECT graph_id, root, root AS id, 0 AS distance, {'p': [root], 'w': 0.0::DOUBLE} AS b FROM roots)",
    ]
    for d in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT graph_id, root, id FROM way{k}" for k in range(d))
        out.append(
            f"way{d} AS (SELECT f.graph_id, f.root, h.nxt AS id, {d} AS distance, min({{'p': list_append(f.b.p, h.nxt), 'w': f.b.w + h.w}}) AS b FROM way{d - 1} f JOIN way_hop h ON f.graph_id = h.graph_id AND f.id = h.id "
            f"WHERE (f.graph_id, f.root, h.nxt) NOT IN ({seen}) GROUP BY f.graph_id, f.root, h.nxt)"
        )
    return [*out, f"way AS ({' UNION ALL '.join(f'SELECT * FROM way{k}' for k in range(depth + 1))})"]


def level(x: str) -> str:
    return f"(CASE WHEN {x} >= 0.8 THEN 'CRITICAL' WHEN {x} >= 0.6 THEN 'HIGH' WHEN {x} >= 0.4 THEN 'MEDIUM' WHEN {x} >= 0.2 THEN 'LOW' ELSE 'NONE' END)"


def impacts(depth: int, up: int | None = None) -> list[str]:
    """The rows of ``impact`` with that depth, and that depth upstream, as ``imp``."""
    score = f"least(1.0::DOUBLE, b.s / (1 + 0.3::DOUBLE * distance) * {case(NODE_COEFFICIENT, 'n.type', 0.5)})"
    rows = f"""imp_rows AS (
      SELECT r.graph_id, r.root, r.id, n.type, r.distance, {score} * 1.0::DOUBLE AS score, 'downstream' AS role, b FROM down r JOIN nodes_c n USING (graph_id, id) WHERE distance > 0
      UNION ALL SELECT r.graph_id, r.root, r.id, n.type, r.distance, {score} * 0.7::DOUBLE, 'upstream', b FROM up r JOIN nodes_c n USING (graph_id, id) WHERE distance > 0)"""
    best = """imp_best AS (SELECT graph_id, root, id, type, min(distance) AS distance, max({'score': score, 'role': role, 's': b.s, 'p': b.p}) AS m FROM imp_rows
      WHERE (role = 'downstream' AND score > 0.1) OR (role = 'upstream' AND score > 0.05) GROUP BY ALL)"""
    imp = f"imp AS (SELECT graph_id, root, id, type, round(m.score, 9) AS score, distance, {level('m.score')} AS level, m.role AS role, round(m.s, 9) AS strength, m.p AS path FROM imp_best)"
    return [NODES, EDGES, ROOTS, *reach("down", depth, "target_id", "source_id"), *reach("up", up or max(1, depth - 1), "source_id", "target_id"), rows, best, imp]


GRADES = """grades AS (SELECT i.graph_id, i.root, i.id, i.type, i.level, i.score, i.distance,
  round(CASE WHEN d > 0 THEN 1 - i.distance::DOUBLE / d ELSE 1.0::DOUBLE END, 6) AS near, kind, 0.5::DOUBLE AS linked,
  round(0.4::DOUBLE * i.score + 0.2::DOUBLE * (CASE WHEN d > 0 THEN 1 - i.distance::DOUBLE / d ELSE 1.0::DOUBLE END) + 0.2::DOUBLE * kind + 0.2::DOUBLE * 0.5::DOUBLE, 9) AS grade_score
  FROM (SELECT *, max(distance) OVER (PARTITION BY graph_id, root) AS d, %s AS kind FROM imp) i)"""

"""Queries of the general problems (1 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.operators import orphans, tree_aggregate
from graphloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_rows(*[table(spark, d, t) for t in ("relationships", "edges", "elements", "nodes", "library_nodes")])


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p1_found(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return tree_aggregate.heavy_nodes(table(spark, d, "edges"))


def p5_degrees(spark: SparkSession, d: str) -> DataFrame:
    return tree_aggregate.node_degrees(table(spark, d, "edges")).select("side", "node_id", "edges", F.round("share", 9).alias("share"), F.round("mean_strength", 6).alias("mean_strength"), "max_strength")


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p5_found": p5_found, "p5_degrees": p5_degrees}

_CLEAN = "nullif(lower(trim({0}, chr(32) || chr(9))), '')"
_ORPHANS = f"""
WITH refs AS (
  SELECT DISTINCT 'relationships' AS ref_table, id AS ref_id, 'source_id' AS ref_field, 'element' AS scope, {_CLEAN.format('source_id')} AS key, recorded_at AS t FROM relationships
  UNION SELECT 'relationships', id, 'target_id', 'element', {_CLEAN.format('target_id')}, recorded_at FROM relationships
  UNION SELECT 'edges', id, 'target_id', 'graph:' || graph_id, {_CLEAN.format('target_id')}, created_at FROM edges
  WHERE {_CLEAN.format('target_id')} NOT IN (SELECT {_CLEAN.format('id')} FROM library_nodes WHERE {_CLEAN.format('id')} IS NOT NULL)
), parents AS (
  SELECT 'element' AS scope, {_CLEAN.format('id')} AS key, recorded_at AS b, deleted_at AS e FROM elements
  UNION ALL SELECT 'graph:' || graph_id, {_CLEAN.format('id')}, created_at, removed_at FROM nodes
), status AS (
  SELECT r.ref_table, r.ref_id, r.ref_field, r.t, count(p.key) AS n,
         count(CASE WHEN p.b <= r.t THEN 1 END) AS began, count(CASE WHEN p.b <= r.t AND (p.e IS NULL OR p.e > r.t) THEN 1 END) AS alive
  FROM refs r LEFT JOIN parents p ON r.scope = p.scope AND r.key = p.key
  WHERE r.key IS NOT NULL GROUP BY ALL
), found AS (
  SELECT DISTINCT ref_table, ref_id, ref_field, CASE WHEN n = 0 THEN 'missing' WHEN began > 0 THEN 'deleted' ELSE 'late' END AS reason,
         strftime(t, '%Y-%m') AS ref_month
  FROM status WHERE n = 0 OR (t IS NOT NULL AND alive = 0)
)"""
_DEGREES = f"""
WITH once AS (SELECT id, min({_CLEAN.format('source_id')}) AS source, min({_CLEAN.format('target_id')}) AS target, min(strength) AS strength FROM edges GROUP BY id),
ends AS (SELECT 'source' AS side, source AS node_id, strength FROM once UNION ALL SELECT 'target', target, strength FROM once),
degrees AS (
  SELECT side, node_id, count(*) AS edges, count(*) / (SELECT count(*) FROM once) AS share, avg(strength) AS mean_strength, max(strength) AS max_strength
  FROM ends WHERE node_id IS NOT NULL GROUP BY side, node_id)"""
ORACLES = {
    "p1_found": _ORPHANS + " SELECT * FROM found",
    "p1_report": _ORPHANS + " SELECT ref_table, ref_field, reason, ref_month, count(*) AS orphans FROM found GROUP BY ALL",
    "p5_found": _DEGREES + " SELECT side, node_id FROM degrees WHERE share >= 0.01",
    "p5_degrees": _DEGREES + " SELECT side, node_id, edges, round(share, 9) AS share, round(mean_strength, 6) AS mean_strength, max_strength FROM degrees",
}

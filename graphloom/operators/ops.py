"""Cache policy, performance, alerts, errors and rate limits over logs of events."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Seconds to live by kind of query, and errors of a kind that raise an alert.
TTL = {"graph_stats": 7200, "node_search": 1800, "path_query": 3600, "impact_analysis": 3600, "qa": 600}
ALERT_ERRORS = {"parse": 10, "database": 5, "ai": 3, "unavailable": 2}


COMPARE = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq, "!=": operator.ne}


def ttl(kind: Column, rows: Column) -> Column:
    """Seconds to live, longer for large results."""
    base = F.coalesce(*[F.when(kind == k, v) for k, v in TTL.items()], F.lit(1800))
    return (base * F.when(rows > 1000, 1.5).when(rows > 100, 1.2).otherwise(1.0)).cast("int")


def should_cache(size: Column) -> Column:
    return F.coalesce(size, F.lit(0)) >= 50


def cache_key(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + ":"), F.md5(F.concat_ws(":", *parts)))


def health(rate: Column) -> Column:
    return F.when(rate >= 0.8, "excellent").when(rate >= 0.6, "good").when(rate >= 0.4, "fair").otherwise("poor")


def hot_nodes(metrics: DataFrame, neighbours: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes of greatest degree and the number of their neighbours."""
    top = metrics.orderBy(F.desc("total_degree"), "graph_id", "id").limit(k)
    n = neighbours.join(F.broadcast(top.select("graph_id", "id")), ["graph_id", "id"], "left_semi").groupBy("graph_id", "id").agg(F.count("*").alias("neighbours"))
    return top.select("graph_id", "id", "total_degree").join(n, ["graph_id", "id"], "left").select("graph_id", "id", "total_degree", F.coalesce("neighbours", F.lit(0)).alias("neighbours"))


def hourly_metrics(events: DataFrame) -> DataFrame:
    """Per hour: requests, errors, their rate, mean and greatest value."""
    err = F.count_if(F.col("event_type") == "error")
    return events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("requests"), err.alias("errors"), F.round(100 * err / F.count("*"), 6).alias("error_rate"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("max_value"))


def recent_mean(events: DataFrame, rows: int = 100) -> DataFrame:
    """For each user and event the mean value of the last ``rows`` events."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-(rows - 1), 0)
    micro = F.round(F.col("value") * 1_000_000).cast("long")  # whole numbers, so that sums don't depend on their order
    return events.select("event_id", "user_id", (F.sum(micro).over(w) / F.count("value").over(w) / 1_000_000).alias("recent_mean"))


def recent_summary(events: DataFrame, minutes: int = 10, by: str = "event_type") -> DataFrame:
    """Mean and greatest value per kind over the last minutes of the log, and a status by thresholds 80 and 95."""
    last = events.agg(F.max("ts").alias("t")).scalar()
    x = events.where(F.col("ts") > last - F.expr(f"INTERVAL {minutes} MINUTES")).groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("max"))
    return x.withColumn("status", F.when(F.col("mean") >= 95, "critical").when(F.col("mean") >= 80, "warning").otherwise("normal"))


def growth(events: DataFrame, minutes: int = 60, least: int = 10) -> DataFrame:
    """Windows in which a kind has at least ``least`` events more than in its window before."""
    win = F.window("ts", f"{minutes} minutes")
    x = events.groupBy("event_type", win.alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n")
    x = x.withColumn("before", F.lag("n").over(W.partitionBy("event_type").orderBy("start")))  # one row a window
    return x.where(F.col("n") - F.col("before") >= least)


def alerts(series: DataFrame, at: str, value: str, threshold: float, duration: int, silence: int = 300, by: list[str] | None = None, comparator: str = ">") -> DataFrame:
    """Alerts of a condition ``value comparator threshold`` (> >= < <= == !=; null breaks none) that held for ``duration`` seconds: run start, first alert and their number.

    A run is a stretch of rows that all break the threshold; within it an alert comes again every ``silence`` seconds.
    """
    by = by or []
    w = W.partitionBy(*by).orderBy(at)
    x = series.withColumn("_b", F.coalesce(COMPARE[comparator](F.col(value), threshold), F.lit(False)))
    x = x.withColumn("_new", (F.col("_b") & ~F.coalesce(F.lag("_b").over(w), F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = x.where("_b").groupBy(*by, "_run").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.max(value).alias("peak"))
    held = F.unix_timestamp("end") - F.unix_timestamp("start")
    return runs.where(held >= duration).select(*by, "start", "end", "peak", (F.floor((held - duration) / silence) + 1).alias("alerts"))


def error_alerts(errors: DataFrame, kind: str = "kind") -> DataFrame:
    """Errors per kind and whether they reach the kind's threshold."""
    least = F.coalesce(*[F.when(F.col(kind) == k, v) for k, v in ALERT_ERRORS.items()], F.lit(20))
    return errors.groupBy(kind).agg(F.count("*").alias("errors")).withColumn("alert", F.col("errors") >= least)


def rate_limited(events: DataFrame, limit: int = 100, seconds: int = 60) -> DataFrame:
    """Events that come when their user already had ``limit`` events in the ``seconds`` before."""
    w = W.partitionBy("user_id").orderBy(F.col("ts").cast("timestamp").cast("double")).rangeBetween(-seconds, 0)
    return events.withColumn("recent", F.count("*").over(w)).where(F.col("recent") > limit).select("event_id", "user_id", "recent")


def all_healthy(checks: DataFrame) -> DataFrame:
    """Overall health: all checks passed."""
    return checks.agg(F.bool_and("ok").alias("healthy"), F.count_if(~F.col("ok")).alias("failed"))


def memory_level(used: Column, limit: Column) -> Column:
    """``critical`` from 90 % of the limit, ``warning`` from 80 %, else ``normal``; null where either is null or the limit is 0."""
    part = F.when(limit > 0, used / limit)
    return F.when(part >= 0.9, "critical").when(part >= 0.8, "warning").when(part.isNotNull(), "normal")


def stale_keys(keys: DataFrame, changed: DataFrame) -> DataFrame:
    """Cached results (key, graph_id, node_id) to drop after a change of nodes (graph_id, id); a null node_id is a result of
    the whole graph."""
    c = changed.select("graph_id", "id").distinct()
    whole = keys.where("node_id IS NULL").join(c.select("graph_id").distinct(), "graph_id", "left_semi").select("key")
    own = keys.join(c.withColumnRenamed("id", "node_id"), ["graph_id", "node_id"], "left_semi").select("key")
    return whole.unionByName(own).distinct()

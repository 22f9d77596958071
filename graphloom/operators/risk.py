"""Risks: security patterns, architecture smells, quality, and reports over issues."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.operators.traverse import cycles
from graphloom.schema import SECURITY_RULES
from graphloom.session import scratch_table as checkpoint

LEVELS = ("critical", "high", "medium", "low")


def security_scan(elements: DataFrame, rules=SECURITY_RULES) -> DataFrame:
    """One row per non-overlapping match of a rule in an element's docstring, or where that is null or empty its code:
    id, rule, level, line_number (the element's line plus the line ends before the match). Null texts give none.

    A JVM-side filter by the same patterns keeps texts without any match out of Python.
    """
    text = F.when(F.length("docstring") > 0, F.col("docstring")).otherwise(F.col("code"))
    any_rule = F.lit(False)
    for _, pattern, _ in rules:
        any_rule |= F.col("text").rlike("(?is)" + pattern)
    some = elements.select("id", "line_number", text.alias("text")).where(any_rule)

    def run(it):
        compiled = [(n, re.compile(p, re.I | re.S), lv) for n, p, lv in rules]
        for batch in it:
            rows = []
            for i, line, t in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows += [(i, n, lv, (line or 0) + t.count("\n", 0, m.start())) for n, p, lv in compiled for m in p.finditer(t)]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int32()))], names=["id", "rule", "level", "line_number"])

    return some.mapInArrow(run, "id string, rule string, level string, line_number int")


def circular_dependencies(edges: DataFrame, max_nodes: int = 4) -> DataFrame:
    return cycles(edges, max_nodes, ["depends", "imports"]).withColumn("level", F.lit("high"))


def deep_inheritance(nodes: DataFrame, edges: DataFrame, max_depth: int = 5) -> DataFrame:
    """Classes with an inheritance path of more than max_depth classes, themselves included: graph_id, id.

    A path of that length is followed level by level; on cycles a path still has to exist with as many hops, so the walk
    keeps the set of nodes only and stops at max_depth.
    """
    e = edges.where("type = 'inherits' AND source_id <> target_id").select("graph_id", F.col("source_id").alias("id"), F.col("target_id").alias("up")).distinct()
    classes = nodes.where("type = 'class'").select("graph_id", "id")
    # ends[k]: nodes from which a walk of k hops starts
    e = checkpoint(e)
    ends = e.select("graph_id", "id").distinct()
    for _ in range(max_depth - 1):
        ends = checkpoint(e.join(ends.select("graph_id", F.col("id").alias("up")), ["graph_id", "up"], "left_semi").select("graph_id", "id").distinct())
    return classes.join(ends, ["graph_id", "id"], "left_semi")


def god_classes(nodes: DataFrame, edges: DataFrame, max_methods: int = 20) -> DataFrame:
    """Classes that define more than max_methods methods, counted by edges."""
    classes = nodes.where("type IN ('class', 'struct')").select("graph_id", F.col("id").alias("source_id"))
    methods = nodes.where("type IN ('method', 'function')").select("graph_id", F.col("id").alias("target_id"))
    d = edges.where("type = 'defines'").join(classes, ["graph_id", "source_id"], "left_semi").join(methods, ["graph_id", "target_id"], "left_semi")
    return d.groupBy("graph_id", F.col("source_id").alias("id")).agg(F.count("*").alias("methods")).where(F.col("methods") > max_methods)


def feature_envy(nodes: DataFrame, edges: DataFrame, least_calls: int = 5, least_share: float = 0.6) -> DataFrame:
    """Methods with more than least_calls calls of other classes' methods of which one class gets more than least_share."""
    methods = nodes.where("type IN ('method', 'function')").select("graph_id", "id")
    owner = edges.where("type = 'defines'").join(methods.withColumnRenamed("id", "target_id"), ["graph_id", "target_id"], "left_semi").groupBy("graph_id", F.col("target_id").alias("id")).agg(F.min_by("source_id", "id").alias("owner"))
    calls = edges.where("type = 'calls'")
    a, b = owner.select("graph_id", F.col("id").alias("source_id"), F.col("owner").alias("own")), owner.select("graph_id", F.col("id").alias("target_id"), F.col("owner").alias("other"))
    per = calls.join(a, ["graph_id", "source_id"]).join(b, ["graph_id", "target_id"]).where("own <> other").groupBy("graph_id", F.col("source_id").alias("id"), "other").agg(F.count("*").alias("n"))
    out = per.groupBy("graph_id", "id").agg(F.sum("n").alias("calls"), F.max("n").alias("most"), F.min_by("other", F.struct((-F.col("n")).alias("n"), "other")).alias("envied"))
    return out.where((F.col("calls") > least_calls) & (F.col("most") / F.col("calls") > least_share)).select("graph_id", "id", "calls", "envied", F.round(F.col("most") / F.col("calls"), 6).alias("share"))


def quality(nodes: DataFrame, limit: int = 10) -> DataFrame:
    """Per graph: functions, their mean complexity (above 0), those above the limit, a score, and whether advice is due."""
    f = nodes.where("type IN ('method', 'function')")
    many = F.count_if(F.col("complexity") > limit)
    mean = F.avg(F.when(F.col("complexity") > 0, F.col("complexity")))
    out = f.groupBy("graph_id").agg(F.count("*").alias("functions"), F.round(mean, 6).alias("mean_complexity"), many.alias("too_complex"))
    return out.withColumns({"score": F.greatest(F.lit(0), 100 - F.least(5 * F.col("too_complex"), F.lit(30))), "advice": (F.col("too_complex") > 0) | (F.coalesce("mean_complexity", F.lit(0.0)) > 8)})


def standard_issues(issues: DataFrame) -> DataFrame:
    """Issues once each, with category and level in lower case; null or unknown levels are low, null categories quality."""
    lv = F.lower(F.trim("level"))
    return issues.dropDuplicates(["id"]).select("id", "title", F.coalesce(F.lower(F.trim("category")), F.lit("quality")).alias("category"), F.when(lv.isin(*LEVELS), lv).otherwise("low").alias("level"), "file_path", "line_number", "element_id", "detected_at")


def issue_report(issues: DataFrame) -> DataFrame:
    """Issues per category and level."""
    return issues.groupBy("category", "level").agg(F.count("*").alias("issues"), F.countDistinct("file_path").alias("files"))


def high_risk_files(issues: DataFrame, k: int = 5) -> DataFrame:
    """The k files with most issues."""
    return issues.where("file_path IS NOT NULL").groupBy("file_path").agg(F.count("*").alias("issues")).orderBy(F.desc("issues"), "file_path").limit(k)


def keyword_components(nodes: DataFrame) -> DataFrame:
    """Nodes whose label speaks of authentication or of data access."""
    lb = F.lower("label")
    kind = F.when(lb.rlike("auth|login|password|token|session"), "authentication").when(lb.rlike("database|sql|query|connection"), "data access")
    return nodes.select("graph_id", "id", "label", kind.alias("component")).where("component IS NOT NULL")


def filter_issues(issues: DataFrame, levels: list[str] | None = None, categories: list[str] | None = None) -> DataFrame:
    """Counts per level of the issues that pass the filters."""
    x = issues.where(F.col("level").isin(levels)) if levels else issues
    x = x.where(F.col("category").isin(categories)) if categories else x
    return x.groupBy("level").agg(F.count("*").alias("issues"))


def report_markdown(counts: list, title: str = "Risk report") -> str:
    """A Markdown report from collected rows of ``issue_report`` (few by nature)."""
    order = {lv: k for k, lv in enumerate(LEVELS)}
    lines = [f"# {title}", ""]
    for r in sorted(counts, key=lambda r: (order.get(r["level"], 9), r["category"])):
        lines.append(f"- **{r['level']}** {r['category']}: {r['issues']} in {r['files']} files")
    return "\n".join(lines)


def architecture_smells(nodes: DataFrame, edges: DataFrame, max_nodes: int = 10, max_depth: int = 5, max_methods: int = 20, least_calls: int = 5, least_share: float = 0.6) -> DataFrame:
    """All smells in one table: smell, graph_id, subject (a node, or a cycle's nodes), level, measure."""
    row = lambda df, smell, subject, level, measure: df.select(F.lit(smell).alias("smell"), "graph_id", subject.alias("subject"), F.lit(level).alias("level"), measure.cast("double").alias("measure"))
    parts = [
        row(circular_dependencies(edges, max_nodes), "circular_dependency", F.array_join("cycle", ","), "high", F.col("length")),
        row(deep_inheritance(nodes, edges, max_depth), "deep_inheritance", F.col("id"), "medium", F.lit(max_depth + 1)),
        row(god_classes(nodes, edges, max_methods), "god_class", F.col("id"), "high", F.col("methods")),
        row(feature_envy(nodes, edges, least_calls, least_share), "feature_envy", F.col("id"), "medium", F.col("share")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def enhanced_report(elements: DataFrame, nodes: DataFrame, edges: DataFrame, **kw) -> DataFrame:
    """Security matches, smells and quality advice counted together: category, kind, level, findings."""
    count = lambda df, category, kind, level: df.select(F.lit(category).alias("category"), kind.alias("kind"), level.alias("level")).groupBy("category", "kind", "level").agg(F.count("*").alias("findings"))
    security = count(security_scan(elements), "security", F.col("rule"), F.col("level"))
    smells = count(architecture_smells(nodes, edges, **kw), "architecture", F.col("smell"), F.col("level"))
    advice = count(quality(nodes).where("advice"), "quality", F.lit("complex_functions"), F.lit("medium"))
    return security.unionByName(smells).unionByName(advice)


def categories(issues: DataFrame) -> DataFrame:
    """Issues of each category and how many levels it has."""
    return issues.groupBy("category").agg(F.count("*").alias("issues"), F.countDistinct("level").alias("levels"))


def risk_context(nodes: DataFrame, edges: DataFrame, issues: DataFrame) -> DataFrame:
    """One row with what an assistant is told about risks: nodes, edges, issues, high ones and components named by keywords."""
    one = lambda df, name: df.agg(F.count("*").alias(name)).scalar().alias(name)
    high = issues.where(F.col("level").isin("critical", "high"))
    return nodes.sparkSession.range(1).select(one(nodes, "nodes"), one(edges, "edges"), one(issues, "issues"), one(high, "high_issues"), one(keyword_components(nodes), "keyword_components"))

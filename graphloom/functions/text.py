"""Text helpers for documentation and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def signature(name: Column, parameters: Column, return_type: Column) -> Column:
    """``def name(a, b) -> type:``; null parameters are none, a null type is left out."""
    args = F.coalesce(F.array_join(parameters, ", "), F.lit(""))
    return F.concat(F.lit("def "), name, F.lit("("), args, F.lit(")"), F.when(F.length(return_type) > 0, F.concat(F.lit(" -> "), return_type)).otherwise(""), F.lit(":"))


def truncate(text: Column, longest: int, suffix: str = "...") -> Column:
    """Texts beyond ``longest`` letters are cut so that they fit with the suffix."""
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest - len(suffix)), F.lit(suffix))).otherwise(text)


def strip_fences(text: Column) -> Column:
    """The inside of a fenced answer."""
    return F.trim(F.regexp_replace(text, r"^\s*```[a-zA-Z]*\s*\n?|\n?\s*```\s*$", ""))


def code_blocks(text: Column) -> Column:
    """Contents of all fenced blocks."""
    return F.regexp_extract_all(text, F.lit(r"```[a-zA-Z]*\n([^`]*)```"), 1)


def headings(text: Column) -> Column:
    """Markdown headings."""
    return F.regexp_extract_all(text, F.lit(r"(?m)^#+[ \t]+([^\r\n]+)$"), 1)


def missing_sections(text: Column, wanted: list[str]) -> Column:
    """Wanted headings that a document lacks, in any case."""
    have = F.transform(headings(text), lambda h: F.lower(F.trim(h)))
    return F.filter(F.array(*[F.lit(w) for w in wanted]), lambda w: ~F.array_contains(have, F.lower(w)))


def parse_answer(text: Column, schema: str) -> Column:
    """A JSON answer as a struct, null where it isn't JSON."""
    return F.from_json(strip_fences(text), schema)


def element_prompt(df: DataFrame) -> DataFrame:
    """id and prompt for the documentation of each element."""
    p = F.concat_ws("\n", F.concat_ws(": ", F.lit("Name"), "name"), F.concat_ws(": ", F.lit("Type"), "type"), F.concat_ws(": ", F.lit("File"), "file_path"), F.concat(F.lit("Signature: "), signature(F.col("name"), F.col("parameters"), F.col("return_type"))))
    return df.select("id", p.alias("prompt"))


def listing(df: DataFrame) -> DataFrame:
    """A line of documentation for each class, function and method: file_path, line."""
    head = F.when(F.col("type").isin("class", "struct"), "## Class ").otherwise("### ")
    return df.select("file_path", "line_number", F.concat(head, F.col("name"), F.coalesce(F.concat(F.lit(": "), F.regexp_extract("docstring", r"([^\n.]+)", 1)), F.lit(""))).alias("line"))


def module_dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per file the distinct labels it imports or depends on, inside and outside of its graph's files."""
    src = nodes.select("graph_id", F.col("id").alias("source_id"), F.col("file_path").alias("file"))
    dst = nodes.select("graph_id", F.col("id").alias("target_id"), F.col("file_path").alias("other"))
    e = edges.where(F.col("type").isin("imports", "depends")).join(src, ["graph_id", "source_id"]).join(dst, ["graph_id", "target_id"], "left")
    inside = F.col("other").isNotNull() & (F.col("other") != F.col("file"))
    return e.groupBy("graph_id", "file").agg(F.countDistinct(F.when(inside, F.col("other"))).alias("internal"), F.countDistinct(F.when(F.col("other").isNull(), F.col("target_id"))).alias("external"))


def with_model(df: DataFrame, prompt: str, call=None, answer: str = "answer") -> DataFrame:
    """Answers of an injected callable (list of prompts to list of answers) per batch; without one they are null."""
    if call is None:
        return df.withColumn(answer, F.lit(None).cast("string"))

    @F.pandas_udf("string")
    def ask(p):
        import pandas as pd

        return pd.Series(call(p.tolist()))

    return df.withColumn(answer, ask(prompt))


def module_documents(elements: DataFrame) -> DataFrame:
    """A Markdown document of each file: its path as heading and a line for each class, function and method, in order."""
    some = elements.where(F.col("type").isin("class", "struct", "interface", "function", "method")).withColumn("_k", F.struct("line_number", "id"))
    head = F.when(F.col("type").isin("class", "struct", "interface"), "## Class ").otherwise("### ")
    said = F.when(F.length("docstring") > 0, F.concat(F.lit(": "), F.regexp_extract("docstring", r"([^\n.]+)", 1))).otherwise("")
    lines = some.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("_k", F.concat(head, F.coalesce("name", F.lit("")), said).alias("line")))).alias("x"))
    return lines.where("file_path IS NOT NULL").select("file_path", F.concat(F.lit("# "), "file_path", F.lit("\n"), F.array_join("x.line", "\n")).alias("document"))


def class_documents(elements: DataFrame) -> DataFrame:
    """A Markdown document of each class: id and document, with the signatures of what names it as parent."""
    c = elements.where(F.col("type").isin("class", "struct", "interface")).select("id", F.concat(F.lit("# "), F.coalesce("name", F.lit("")), F.when(F.length("docstring") > 0, F.concat(F.lit("\n"), "docstring")).otherwise("")).alias("head"))
    m = elements.where(F.col("type").isin("function", "method") & F.col("parent_id").isNotNull())
    m = m.select(F.lower(F.trim("parent_id")).alias("id"), F.struct("line_number", F.col("id").alias("k"), F.concat(F.lit("- "), signature(F.coalesce("name", F.lit("")), F.col("parameters"), F.col("return_type"))).alias("line")).alias("x"))
    lines = m.groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return c.join(lines, "id", "left").select("id", F.concat("head", F.when(F.col("x").isNotNull(), F.concat(F.lit("\n"), F.array_join("x.line", "\n"))).otherwise("")).alias("document"))


def to_html(markdown: Column) -> Column:
    """Headings, bold text, code and list items of Markdown as HTML, with the marks of HTML escaped first."""
    out = markdown
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    for k in (3, 2, 1):
        out = F.regexp_replace(out, rf"(?m)^{'#' * k} ([^\n]*)", f"<h{k}>$1</h{k}>")
    out = F.regexp_replace(out, r"(?m)^- ([^\n]*)", "<li>$1</li>")
    return F.regexp_replace(F.regexp_replace(out, r"\*\*([^*\n]+)\*\*", "<b>$1</b>"), r"`([^`\n]+)`", "<code>$1</code>")

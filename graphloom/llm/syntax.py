"""Source files that do not parse (problem 3)."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.arrow import map_rows, strings
from graphloom.llm.grammar_brace import Go, Java, Json
from graphloom.llm.grammar_js import JavaScript, TypeScript
from graphloom.llm.grammar_py import File
from graphloom.llm.lex import TOKEN, language_of

GRAMMARS = {"python": File, "java": Java, "javascript": JavaScript, "typescript": TypeScript, "go": Go, "json": Json}


def syntax_errors(language: str, text: str) -> list[tuple[int, str]]:
    """All errors as (line, cause), in the order of lines. A blank text is valid, except as JSON."""
    if sys.getrecursionlimit() < 100_000:
        sys.setrecursionlimit(100_000)
    if not text.strip("\ufeff \t\r\n\f"):
        return [(1, "no value")] if language == "json" else []
    try:
        found = GRAMMARS[language](text).errors
    except RecursionError:
        return [(1, "nested too deeply")]
    if not found:
        return []
    body = "\n" + text.removeprefix("\ufeff") if language == "python" else text
    starts = [m.start(1) for m in TOKEN[language].finditer(body)]
    line = lambda k: body.count("\n", 0, starts[min(k, len(starts) - 1)]) + (language != "python") if starts else 1
    return sorted((line(k), why) for k, why in found)


def parse_files(files: DataFrame) -> DataFrame:
    """One row for each file row with content whose language is parsed: file_path, repo, language (in one spelling) and
    errors, an array of (line, cause), empty for valid files; its first element is the first cause.

    Rows with null content, and languages without a grammar, are left out; a null path stays null; repeated rows stay
    repeated. Texts are read whole. There is no shuffle.
    """

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            paths, repos, languages, texts = (strings(batch, c) for c in ("file_path", "repo", "language", "content"))
            rows = []
            for path, repo, lang, text in zip(paths, repos, languages, texts):
                lang = language_of(lang, path)
                if text is not None and lang in GRAMMARS:
                    rows.append((path, repo, lang, [{"line": a, "cause": b} for a, b in syntax_errors(lang, text)]))
            cols = list(zip(*rows)) or [[], [], [], []]
            kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.struct([("line", pa.int32()), ("cause", pa.string())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["file_path", "repo", "language", "errors"])

        return run

    return map_rows(files.select("file_path", "repo", "language", "content"), make, "file_path string, repo string, language string, errors array<struct<line: int, cause: string>>")


def broken_files(files: DataFrame) -> DataFrame:
    """file_path of each file with an error, once."""
    return parse_files(files).where(F.size("errors") > 0).select("file_path").distinct()


def error_rows(files: DataFrame) -> DataFrame:
    """All errors of each broken file, once: file_path, language, line, cause, and whether it is the file's first."""
    rows = parse_files(files).select("file_path", "language", F.posexplode("errors").alias("n", "e"))
    return rows.select("file_path", "language", "e.line", "e.cause", (F.col("n") == 0).alias("first")).distinct()


def acceptance(files: DataFrame) -> DataFrame:
    """Files, broken files and the rate of valid ones per repo and language; null repos form a group."""
    once = parse_files(files).select("file_path", "repo", "language", (F.size("errors") > 0).alias("broken"))
    once = once.groupBy("file_path", "repo", "language").agg(F.max("broken").alias("broken"))
    out = once.groupBy("repo", "language").agg(F.count("*").alias("files"), F.sum(F.col("broken").cast("long")).alias("broken"))
    return out.withColumn("acceptance", F.round(1 - F.col("broken") / F.col("files"), 6))

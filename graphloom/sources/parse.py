"""Code elements and relationships from source texts."""

from __future__ import annotations

import ast
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.errors import UnsupportedLanguageError
from graphloom.operators.traverse import cycles
from graphloom.session import scratch_table

#: Suffixes that are parsed, folders that are not.
SUFFIX = {"py": "python", "java": "java", "js": "javascript", "jsx": "javascript", "ts": "javascript", "tsx": "javascript", "cs": "csharp"}
IGNORED = r"/(\.git|node_modules|__pycache__|\.venv|venv|dist|build|target|\.idea|\.vscode|\.pytest_cache)/"
MAX_BYTES = 10 * 1024 * 1024
SCHEMA = (
    "file_path string, success boolean, error_message string, language string, name string, type string, line_number int, end_line_number int, complexity int, visibility string, is_static boolean, "
    "parameters array<string>, return_type string, docstring string, parent string, bases array<string>, calls array<string>, imports array<string>, "
    "is_abstract boolean, call_kinds array<string>, import_kinds array<string>, items array<string>, types array<string>, field_types array<string>, tree_size int"
)
_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.IfExp, ast.comprehension, ast.match_case)


def project_files(spark: SparkSession, path: str) -> DataFrame:
    """Source files under a folder as file_path, content; ignored folders and large files are filtered before they are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{py,java,js,jsx,ts,tsx,cs}").load(path)
    raw = raw.where(~F.col("path").rlike(IGNORED) & (F.col("length") < MAX_BYTES))

    @F.pandas_udf("string")
    def gbk(x):
        return x.map(lambda b: None if b is None else bytes(b).decode("gbk", errors="replace"))

    plain = F.col("content").cast("string")
    text = F.when(F.is_valid_utf8(plain), plain).otherwise(gbk("content"))
    return raw.select(F.col("path").alias("file_path"), text.alias("content"))


#: Columns that hold lists.
_LISTS = ("parameters", "bases", "calls", "imports", "call_kinds", "import_kinds", "items", "types", "field_types")


def _python(text: str) -> list[dict]:
    out = []

    def name_of(x) -> str | None:
        return x.id if isinstance(x, ast.Name) else x.attr if isinstance(x, ast.Attribute) else None

    def names_in(x) -> list[str]:
        """Names of an annotation, also of one written as a string."""
        if isinstance(x, ast.Constant) and isinstance(x.value, str):
            return re.findall(r"\w+", x.value)
        return [n for y in ast.walk(x) if (n := name_of(y))] if x is not None else []

    def made(x) -> list[str]:
        """The class that a value is made of, if it is a call of one."""
        return [n] if isinstance(x, ast.Call) and (n := name_of(x.func)) and n[:1].isupper() else []

    def fields(node) -> list[str]:
        """Types of a class's fields: annotated ones, and what values are made of."""
        found = []
        for x in ast.walk(node):
            if isinstance(x, ast.AnnAssign):
                found += names_in(x.annotation)
            elif isinstance(x, ast.Assign) and any(isinstance(t, ast.Attribute) or x in node.body for t in x.targets):
                found += made(x.value)
        return found

    def variables(body, parent) -> None:
        for x in body:
            for t in x.targets if isinstance(x, ast.Assign) else [x.target] if isinstance(x, ast.AnnAssign) else []:
                if isinstance(t, ast.Name):
                    out.append({"name": t.id, "type": "field" if parent else "variable", "line_number": x.lineno, "end_line_number": x.end_lineno, "complexity": 1, "visibility": "private" if t.id.startswith("_") else "public", "is_static": bool(parent), "parent": parent, "return_type": ast.unparse(x.annotation) if isinstance(x, ast.AnnAssign) else None} | {c: [] for c in _LISTS})

    def own(node):
        """Nodes below, without nested definitions."""
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                yield child
                yield from own(child)

    def complexity(node) -> int:
        return 1 + sum(isinstance(x, _BRANCH) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0) for x in ast.walk(node))

    def visit(node, parent):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                a = None if is_class else child.args
                out.append({
                    "name": child.name, "type": "class" if is_class else "function", "line_number": child.lineno, "end_line_number": child.end_lineno, "complexity": complexity(child),
                    "visibility": "private" if child.name.startswith("_") else "public", "is_static": any(name_of(d) == "staticmethod" for d in child.decorator_list),
                    "parameters": [x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs]] if a else [], "return_type": ast.unparse(child.returns) if a and child.returns else None,
                    "docstring": ast.get_docstring(child), "parent": parent, "bases": [n for b in child.bases if (n := name_of(b))] if is_class else [],
                    "calls": [] if is_class else [n for x in own(child) if isinstance(x, ast.Call) and (n := name_of(x.func))], "imports": [],
                    "call_kinds": [] if is_class else ["method_call" if isinstance(x.func, ast.Attribute) else "function_call" for x in own(child) if isinstance(x, ast.Call) and name_of(x.func)],
                    "is_abstract": any(name_of(d) == "abstractmethod" for d in child.decorator_list) or is_class and any(name_of(b) == "ABC" for b in child.bases),
                    "types": [n for y in ([*a.posonlyargs, *a.args, *a.kwonlyargs]) for n in names_in(y.annotation)] + names_in(child.returns) if a else [],
                    "field_types": fields(child) if is_class else [], "import_kinds": [], "items": [],
                })
                if is_class:
                    variables(child.body, child.name)
                visit(child, child.name)
            else:
                visit(child, parent)

    tree = ast.parse(text.removeprefix("﻿"))
    visit(tree, None)
    variables(tree.body, None)
    direct = [a.name for x in ast.walk(tree) if isinstance(x, ast.Import) for a in x.names]
    froms = [x for x in ast.walk(tree) if isinstance(x, ast.ImportFrom) and x.module]
    imports, items = direct + [x.module for x in froms], [a.name for x in froms for a in x.names if a.name != "*"]
    out.append({"name": None, "type": "module", "line_number": 1, "end_line_number": text.count("\n") + 1, "complexity": complexity(tree), "visibility": "public", "is_static": False, "parameters": [], "return_type": None, "docstring": ast.get_docstring(tree), "parent": None, "bases": [], "calls": [], "imports": imports, "is_abstract": False, "call_kinds": [], "import_kinds": ["direct_import"] * len(direct) + ["from_import"] * len(froms), "items": items, "types": [], "field_types": [], "tree_size": sum(1 for _ in ast.walk(tree))})
    return out


_BLANK = re.compile(r"/\*.*?\*/|//[^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_CLASS = re.compile(r"\b(class|interface|enum|record)\s+(\w+)(?:\s*<[^{]*?>)?(?:\s+extends\s+([\w.]+))?(?:[^{;]*?\bimplements\s+([\w., ]+))?[^{;]*\{")
_BODY = re.compile(r"\)\s*(?:throws\s+[\w, .]+?)?(?::\s*[\w<>\[\]| .]+?)?\s*\{")
_HEAD = re.compile(r"(?:(?P<mods>(?:(?:public|private|protected|static|final|abstract|async|export|default|synchronized)\s+)*))(?P<function>function\s*\*?\s*)?(?P<ret>[\w<>\[\], .?]*?)\s*(?P<name>\w+)\s*$")
_IMPORT = re.compile(r"\bimport\s+(?:static\s+)?([\w.*]+)\s*;|\bfrom\s+[\"']([^\"']+)[\"']|\brequire\([\"']([^\"']+)[\"']\)")
_BRANCH_WORD = re.compile(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?![.?])")
_FIELD = re.compile(r"(?m)^[ \t]*(?:(?:public|private|protected|internal|static|final|readonly)[ \t]+)+(?:([\w<>\[\], .?]+?)[ \t]+)?(\w+)[ \t]*(?:[?!]?:[ \t]*([\w<>\[\] .|]+?))?[ \t]*(?:=(?!>)[^;{]*)?;")
_NAMESPACE = re.compile(r"\b(?:package|namespace)\s+([\w.]+)\s*[;{]")
_ITEMS = re.compile(r"\bimport\s*(?:type\s+)?(?:(\w+)\s*,?\s*)?(?:\{([^}]*)\})?\s*from\b")
_WORDS = re.compile(r"\w+|[^\w\s]")
_CLASS_NAME = re.compile(r"\b[A-Z]\w*")
_NO_METHOD = set("if for while switch catch return new function synchronized else do try".split())


def _braced(text: str) -> list[dict]:
    bare = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    docs = [m.span() for m in _BLANK.finditer(text) if m.group().startswith("/**")]
    doc_starts = [a for a, _ in docs]
    end, stack = {}, []
    for m in re.finditer(r"[{}]", bare):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            end[stack.pop()] = m.start()
    line = lambda k: bare.count("\n", 0, k) + 1
    found = []
    for m in _CLASS.finditer(bare):
        found.append((m.start(), m.end() - 1, m[2], m[1] if m[1] in ("interface", "enum") else "class", "", [], None, [x.strip() for x in [m[3] or "", *(m[4] or "").split(",")] if x.strip()]))
    opening, stack = {}, []
    for m in re.finditer(r"[()]", bare):
        if m.group() == "(":
            stack.append(m.start())
        elif stack:
            opening[m.start()] = stack.pop()
    for m in _BODY.finditer(bare):
        if (at := opening.get(m.start())) is None:
            continue
        start = max(bare.rfind(c, 0, at) for c in ";{}") + 1
        h = _HEAD.fullmatch(re.sub(r"@\w+(?:\([^()]*\))?", "", bare[start:at]).strip())
        if not h or h["name"] in _NO_METHOD or (h["ret"] or "").split(" ")[0] in ("new", "return", "else", "throw"):
            continue
        params = [p.split(":")[0].split("=")[0].split()[-1] for p in bare[at + 1 : m.start()].split(",") if p.split(":")[0].split("=")[0].split()]
        found.append((bare.rindex(h["name"], start, at), m.end() - 1, h["name"], "method", h["mods"] or "", params, h["ret"] or None, []))
    out = []
    for a, brace, name, kind, mods, params, ret, bases in sorted(found):
        b = end.get(brace, len(bare))
        around = [f for f in found if f[1] < a < end.get(f[1], len(bare))]
        inner = max(around, key=lambda f: f[1], default=None)
        if kind == "method" and (inner is None or inner[3] == "method"):
            kind = "function"
        body = bare[brace:b]
        begin = max(bare.rfind(c, 0, a) for c in ";{}") + 1
        k = bisect_right(doc_starts, a) - 1
        doc = re.sub(r"(?m)^\s*\*+ ?", "", text[docs[k][0] + 3 : docs[k][1] - 2]).strip() if k >= 0 and doc_starts[k] >= begin else None
        head, sites = bare[begin:brace], [m for m in re.finditer(r"(\.\s*)?\b(\w+)\s*\(", body) if m[2] not in _NO_METHOD] if kind in ("method", "function") else []
        inside = [f for f in _FIELD.finditer(bare, brace, b) if max((x[1] for x in found if x[1] < f.start() < end.get(x[1], len(bare))), default=-1) == brace] if kind not in ("method", "function") else []
        for f in inside:
            out.append({"name": f[2], "type": "field", "line_number": line(f.start(2)), "end_line_number": line(f.end()), "complexity": 1, "visibility": next((v for v in ("private", "protected") if v in f[0]), "public"), "is_static": "static" in f[0], "parent": name, "return_type": (f[1] or f[3] or "").strip() or None} | {c: [] for c in _LISTS})
        vis = next((v for v in ("private", "protected", "public") if v in mods), "private" if name.startswith("_") else "public")
        out.append({"name": name, "type": kind, "line_number": line(a), "end_line_number": line(b), "complexity": 1 + len(_BRANCH_WORD.findall(body)), "visibility": vis, "is_static": "static" in mods, "parameters": params, "return_type": (ret or "").strip() or None, "docstring": doc, "parent": inner[2] if inner else None, "bases": bases, "calls": [m[2] for m in sites], "imports": [], "call_kinds": ["method_call" if m[1] else "function_call" for m in sites], "import_kinds": [], "items": [], "is_abstract": bool(re.search(r"\babstract\b", head)) or kind == "interface", "types": _CLASS_NAME.findall(head.replace(name, " ", 1)) if kind in ("method", "function") else [], "field_types": [n for f in inside for n in _CLASS_NAME.findall(f"{f[1] or ''} {f[3] or ''}")]})
    out.append({"name": None, "type": "module", "line_number": 1, "end_line_number": text.count("\n") + 1, "complexity": 1, "visibility": "public", "is_static": False, "parameters": [], "return_type": None, "docstring": None, "parent": None, "bases": [], "calls": [], "imports": (imports := [next(x for x in t if x) for t in _IMPORT.findall(text)]), "import_kinds": ["import"] * len(imports), "items": [n for one, many in _ITEMS.findall(text) for n in [one, *(x.split(" as ")[0].strip() for x in many.split(","))] if n], "call_kinds": [], "is_abstract": False, "types": [], "field_types": [], "tree_size": len(_WORDS.findall(bare))})
    for m in _NAMESPACE.finditer(bare):
        out.append({"name": m[1], "type": "namespace", "line_number": line(m.start()), "end_line_number": line(m.start()), "complexity": 1, "visibility": "public", "is_static": False, "parent": None} | {c: [] for c in _LISTS})
    return out


#: Parsers by language; more can be registered.
PARSERS = {"python": _python, "java": _braced, "javascript": _braced, "csharp": _braced}


def parser_for(language: str):
    """The parser of a language; an unknown language is an error."""
    if language not in PARSERS:
        raise UnsupportedLanguageError(f"no parser for {language!r}; there are {', '.join(sorted(PARSERS))}")
    return PARSERS[language]


def register_parser(language: str, suffixes: list[str], parser) -> None:
    """Add a parser: a function from text to element dictionaries."""
    PARSERS[language] = parser
    SUFFIX.update(dict.fromkeys(suffixes, language))


def parse_texts(files: DataFrame) -> DataFrame:
    """Elements of each file (file_path, content), a row of type ``module`` for the file itself; a file that can't be
    parsed gives one row with its error. Null contents and other suffixes give none. There is no shuffle."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = {"success": pa.bool_(), "is_static": pa.bool_(), "is_abstract": pa.bool_(), "line_number": pa.int32(), "end_line_number": pa.int32(), "complexity": pa.int32(), "tree_size": pa.int32()} | {c: pa.list_(pa.string()) for c in _LISTS}
    suffix = F.lower(F.regexp_extract("file_path", r"\.(\w+)$", 1))

    def run(it):
        for batch in it:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lang = SUFFIX[path.rsplit(".", 1)[-1].lower()]
                try:
                    rows += [{"file_path": path, "success": True, "language": lang} | e for e in parser_for(lang)(text)]
                except (SyntaxError, ValueError, RecursionError, MemoryError) as x:
                    rows.append({"file_path": path, "success": False, "error_message": f"{type(x).__name__}: {x}"[:300], "language": lang})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

    return files.where(suffix.isin(*SUFFIX) & F.col("content").isNotNull()).select("file_path", "content").mapInArrow(run, SCHEMA)


def element_rows(parsed: DataFrame) -> DataFrame:
    """Elements with ids that follow from their content."""
    e = parsed.where("success AND name IS NOT NULL").withColumn("id", F.sha2(F.concat_ws("|", "name", "type", "file_path", F.col("line_number").cast("string")), 256))
    return e.dropDuplicates(["id"])


def first_by_name(elements: DataFrame, *by: str) -> DataFrame:
    """The first element of each name in its file: the join side of name resolution."""
    return elements.groupBy(*by).agg(F.min_by("id", F.struct("line_number", "id")).alias("target_id"))


def inheritance(elements: DataFrame) -> DataFrame:
    """Classes to base classes of the same file, the first of that name."""
    up = first_by_name(elements.where("type IN ('class', 'interface')"), "file_path", "name").withColumnRenamed("name", "base")
    return elements.select("id", "file_path", F.explode("bases").alias("base")).join(up, ["file_path", "base"]).select(F.col("id").alias("source_id"), "target_id", F.lit("inherits").alias("type"))


def call_edges(elements: DataFrame) -> DataFrame:
    """Functions to the functions that they call in the same file, one row per call site."""
    to = first_by_name(elements.where("type IN ('function', 'method')"), "file_path", "name").withColumnRenamed("name", "callee")
    return elements.select("id", "file_path", F.explode("calls").alias("callee")).join(to, ["file_path", "callee"]).select(F.col("id").alias("source_id"), "target_id", F.lit("calls").alias("type"))


def defines(elements: DataFrame) -> DataFrame:
    """Classes to what they define."""
    up = first_by_name(elements.where("type IN ('class', 'interface', 'enum')"), "file_path", "name").withColumnRenamed("name", "parent")
    return elements.where("parent IS NOT NULL").select("file_path", "parent", "id").join(up, ["file_path", "parent"]).select(F.col("target_id").alias("source_id"), F.col("id").alias("target_id"), F.lit("defines").alias("type"))


def cross_file_inheritance(elements: DataFrame) -> DataFrame:
    """By naming: BaseX, XBase, AbstractX, and X for XImpl, in another file."""
    n = F.col("name")
    candidates = F.array_distinct(F.array(F.concat(F.lit("Base"), n), F.concat(n, F.lit("Base")), F.concat(F.lit("Abstract"), n), F.regexp_replace(n, "Impl$", "")))
    c = elements.where("type = 'class'").select("id", "file_path", F.explode(candidates).alias("candidate"))
    p = elements.where("type = 'class'").select(F.col("id").alias("target_id"), F.col("file_path").alias("other"), F.col("name").alias("candidate"))
    return c.join(p, "candidate").where("other <> file_path").select(F.col("id").alias("source_id"), "target_id", F.lit("inherits").alias("type")).distinct()


def import_edges(parsed: DataFrame, itself: bool = False) -> DataFrame:
    """Files to the files that they import: source_file, target_file.

    A module is the file of that path beside the importing one, else the package of that path there, else the first file
    of its repository with the module's last part as stem. Imports of a file by itself come out only if asked for.
    """
    path, repo = F.col("file_path"), F.regexp_extract("file_path", r"^([^/]+)/", 1).alias("repo")
    files = parsed.select(path.alias("target_file"), repo, F.regexp_replace("file_path", r"\.\w+$", "").alias("bare"), F.regexp_extract("file_path", r"([^/]+)\.\w+$", 1).alias("stem")).distinct()
    m = F.regexp_replace("m", r"^\./", "")
    slashed = F.when(F.col("m").contains("/"), m).otherwise(F.regexp_replace(m, r"\.", "/"))
    want = parsed.where("type = 'module'").select(path.alias("source_file"), repo, F.regexp_extract("file_path", r"^(.*/)", 1).alias("dir"), F.explode("imports").alias("m")).distinct()
    want = want.withColumn("base", slashed).withColumn("stem", F.regexp_extract("base", r"([^/]+)$", 1))
    beside = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.concat("dir", "base", F.lit(end)).alias("bare")) for k, end in ((1, ""), (2, "/__init__"))]))
    near = want.select("source_file", "m", beside.alias("x")).select("source_file", "m", "x.k", "x.bare").join(files, "bare").select("source_file", "m", "k", "target_file")
    far = want.join(files.select("repo", "stem", "target_file"), ["repo", "stem"]).select("source_file", "m", F.lit(3).alias("k"), "target_file")
    first = near.unionByName(far).groupBy("source_file", "m").agg(F.min(F.struct("k", "target_file")).alias("b")).select("source_file", F.col("b.target_file").alias("target_file"))
    return (first if itself else first.where("source_file <> target_file")).distinct()


def file_cycles(imports: DataFrame, max_nodes: int = 10) -> DataFrame:
    """Cycles of imports, a file's import of itself included: cycle (first file last again), length (its files)."""
    e = imports.select(F.lit("files").alias("graph_id"), F.col("source_file").alias("source_id"), F.col("target_file").alias("target_id"), F.lit("imports").alias("type"))
    alone = imports.where("source_file = target_file").select(F.array("source_file", "target_file").alias("cycle"), F.lit(1).alias("length"))
    return cycles(scratch_table(e), max_nodes).select("cycle", "length").unionByName(alone)


def typed_edges(elements: DataFrame, column: str, kind: str) -> DataFrame:
    """Elements to the classes of the same file that their types name (the first of a name), once each."""
    to = first_by_name(elements.where("type IN ('class', 'interface', 'enum')"), "file_path", "name").withColumnRenamed("name", "named")
    e = elements.select("id", "file_path", F.explode(column).alias("named")).join(to, ["file_path", "named"]).where("id <> target_id")
    return e.select(F.col("id").alias("source_id"), "target_id", F.lit(kind).alias("type")).distinct()


def dependencies(elements: DataFrame) -> DataFrame:
    """Functions to the classes in their annotations."""
    return typed_edges(elements, "types", "depends")


def compositions(elements: DataFrame) -> DataFrame:
    """Classes to the classes of their fields."""
    return typed_edges(elements, "field_types", "composes")


def call_kinds(elements: DataFrame) -> DataFrame:
    """Call sites per file and kind."""
    return elements.select("file_path", F.explode("call_kinds").alias("kind")).groupBy("file_path", "kind").agg(F.count("*").alias("sites"))


def project_summary(parsed: DataFrame) -> DataFrame:
    """Per file: whether it parsed, its elements by type, imports and the size of its tree."""
    return parsed.groupBy("file_path", "language").agg(
        F.bool_and("success").alias("success"), F.count("name").alias("elements"), *[F.count_if(F.col("type") == t).alias(f"{t}_count") for t in ("class", "interface", "function", "method", "field", "variable")],
        F.sum(F.size(F.coalesce("imports", F.expr("CAST(array() AS array<string>)")))).alias("imports"), F.max("tree_size").alias("tree_size"),
    )


def exports(elements: DataFrame) -> DataFrame:
    """Public classes and functions per file."""
    return elements.where("type IN ('class', 'function') AND (visibility = 'public' OR NOT startswith(name, '_'))").select("file_path", "name").distinct()


def cross_file_usage(elements: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """Elements to the functions and classes of other files that they call by name, all definitions: source_id,
    target_id, calls. With parsed rows also files (source_id is the path) to what they import by name. Names defined in
    very many files join their callers by a hash join on the name."""
    use = elements.select("id", "file_path", F.explode("calls").alias("callee")).groupBy("id", "file_path", "callee").agg(F.count("*").alias("calls"))
    if parsed is not None:
        items = parsed.where("type = 'module'").select(F.col("file_path").alias("id"), "file_path", F.explode("items").alias("callee"))
        use = use.unionByName(items.groupBy("id", "file_path", "callee").agg(F.count("*").alias("calls")))
    to = elements.where("type IN ('function', 'method', 'class')").select(F.col("id").alias("target_id"), F.col("file_path").alias("other"), F.col("name").alias("callee"))
    return use.join(to, "callee").where("other <> file_path").groupBy(F.col("id").alias("source_id"), "target_id").agg(F.sum("calls").alias("calls"))


def class_split(elements: DataFrame) -> DataFrame:
    """Per class its constructors, public and private functions, by number."""
    ctor = F.col("name").isin("__init__", "constructor") | (F.col("name") == F.col("parent"))
    m = elements.where("parent IS NOT NULL AND type IN ('function', 'method')")
    return m.groupBy("file_path", F.col("parent").alias("name")).agg(F.count_if(ctor).alias("constructors"), F.count_if(~ctor & (F.col("visibility") != "private")).alias("public"), F.count_if(~ctor & (F.col("visibility") == "private")).alias("private"))

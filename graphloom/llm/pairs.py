"""Functions paired with their documentation (problem 6).

Signatures are found by regular expressions on the text without comments and literals; bodies are delimited by
indentation (Python) or by a stack of brackets; the comment next to a signature is attached by line distance.
"""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.arrow import map_rows, strings
from graphloom.llm.lex import SPANS, language_of, mask
from graphloom.llm.syntax import syntax_errors

LANGUAGES = ("python", "java", "javascript", "typescript", "go")
#: Words (or CJK letters) that a sentence has at least.
LEAST_WORDS, LEAST_CJK = 4, 6

#: Phrases that say nothing, matched as whole lines without marks.
STOCK = {
    "main logic here", "see above", "see below", "does stuff", "do stuff", "internal use only", "for internal use only", "not documented yet", "no description", "no documentation", "n a",
    "utility method", "utility function", "helper", "helper function", "helper method", "wrapper", "description", "function", "method", "constructor", "default constructor", "getter", "setter",
    "inheritdoc", "this function does what its name says", "self explanatory", "the name says it all", "auto generated method stub", "generated by ide", "non javadoc", "see the base class", "see the parent class",
}
# a note that something is still to be written: the rest of its line goes with it
_TO_WRITE = re.compile(r"(?i)(?:^|(?<=\n))[^\w\n]*(?:todo|fixme|tbd|xxx|hack|placeholder|fill me in|to be (?:written|documented|done)|not (?:yet )?documented(?: yet)?|missing docs?|待补充|待完善|未完成)\b[^\n]*|(?i:generated by \w+[^\n]*)|待补充|待完善")
# tags: markup, @param name, :param name:, and the headings of parameter lists
_MARKUP = re.compile(r"\{@?\w+(?:\s+[^}]*)?\}|</?\w+[^<>\n]*>|```")
_TAG = re.compile(r"(?m)(?:^|(?<=\s))(?:[@\\](?:param|arg|argument|property|prop|typeparam|template|throws|exception|raises)\b[ \t]*(?:\{[^}\n]*\}[ \t]*)?\[?[\w.$]*(?:=[^\]\n]*)?\]?|[@\\]\w+\b(?:[ \t]*\{[^}\n]*\})?|:(?:param|parameter|arg|argument|key|keyword|type|raises|raise|except|exception|var|ivar|cvar)\b[^:\n]*:|:\w+:)[ \t]*-?")
_SECTION = re.compile(r"(?mi)^[ \t]*(?:args|arguments|parameters|params|returns?|raises|yields|examples?|notes?|see also|attributes)[ \t]*:?[ \t]*$|^[ \t]*-{2,}[ \t]*$")
_WORD = re.compile(r"[^\W\d_]+|\d+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_END = re.compile(r"(?<=[.!?。！？])(?:\s+|(?<=[。！？]))|\n\s*\n|\n(?=[ \t]*[-*•])")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+")
_FILLERS = set("a an the this that it its of to for and or in on is are be function functions method methods func def helper utility implementation performs perform does do gets get sets set called name s".split())


def stem(word: str) -> str:
    for end in ("ies", "es", "s", "ing", "ed", "e"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)] + ("y" if end == "ies" else "")
    return word


def says_something(doc: str, name: str, params: list[str]) -> bool:
    """Whether a documentation, without its comment marks, holds a sentence of its own."""
    text = _TO_WRITE.sub("\n", doc)
    text = _SECTION.sub("\n", _TAG.sub("\n", _MARKUP.sub(" ", text)))
    named = {stem(w.lower()) for w in _CAMEL.findall(name)} | {stem(w.lower()) for p in params for w in _CAMEL.findall(p)}
    named |= {name.lower().replace("_", "")} | {p.lower() for p in params}
    for sentence in _END.split(text):
        if len(_CJK.findall(sentence)) >= LEAST_CJK:
            return True
        words = [w.lower() for w in _WORD.findall(sentence)]
        if len(words) < LEAST_WORDS or " ".join(words) in STOCK:
            continue
        own = [w for w in words if w not in _FILLERS and stem(w) not in named and w not in named and not w.isdigit()]
        if len(own) >= 2 or len(own) == 1 and len(words) >= 6:
            return True
    return False


class Pair(NamedTuple):
    name: str
    line: int
    end_line: int
    params: list[str]
    doc: str
    start: int
    end: int


_PY_DEF = re.compile(r"(?m)^([ \t]*)(?:async[ \t]+)?def[ \t]+(\w+)\s*(?:\[[^\]]*\]\s*)?(?=\()")
_PY_QUOTE = re.compile(r"[uUrR]?(\"\"\"|'''|\"|')")
_ID = re.compile(r"[^\W\d][\w$]*")


def _brackets(masked: str) -> dict[int, int]:
    """Opening to closing brackets, and closing to opening ones, by a stack."""
    pairs, stack = {}, []
    for m in _BRACKET.finditer(masked):
        c, at = m.group(), m.start()
        if c in "([{":
            stack.append(at)
        elif stack:
            a = stack.pop()
            pairs[a], pairs[at] = at, a
    return pairs


_BRACKET = re.compile(r"[()\[\]{}]")


def _names(params: str) -> list[str]:
    return [m.group() for part in params.split(",") if (m := _ID.search(part))]


def _python(text: str) -> list[Pair]:
    spans = [m.span() for m in SPANS["python"].finditer(text)]
    comments = [(a, b) for a, b in spans if text[a] == "#"]
    masked = mask(text, spans)
    found = list(_PY_DEF.finditer(masked))
    if not found:
        return []
    bare, pairs, starts = mask(text, comments), _brackets(masked), dict(spans)
    out = []
    for m in found:
        close = pairs.get(m.end())
        if close is None:
            continue
        colon = masked.find(":", close)
        k = colon + 1
        while k < len(bare) and bare[k] in " \t\r\n\f\\":
            k += 1
        doc = ""
        if k in starts and (q := _PY_QUOTE.match(text, k)):
            end, at = starts[k], starts[k]
            while at < len(bare) and bare[at] in " \t":
                at += 1
            if at == len(bare) or bare[at] in "\r\n;":
                doc = text[q.end() : end - len(q[1])]
        # the body goes on while lines are blank or deeper than the signature
        indent, end = len(m[1].expandtabs(8)), len(text)
        for line in _LINE.finditer(masked, colon + 1):
            if line.start() > colon + 1 and (s := bare[line.start() : line.end()].strip()) and len(line[0]) - len(line[0].lstrip(" \t")) <= indent and not s.startswith("#"):
                if masked[line.start() : line.end()].strip():
                    end = line.start()
                    break
        out.append(_pair(text, m[2], m.start(2), m.start(), end, _names(masked[m.end() + 1 : close]), doc))
    return out


_LINE = re.compile(r"[^\n]*\n?")


def _pair(text: str, name: str, at: int, start: int, end: int, params: list[str], doc: str) -> Pair:
    return Pair(name, text.count("\n", 0, at) + 1, text.count("\n", 0, max(end - 1, 0)) + 1, [p for p in params if p not in ("self", "cls")], doc, start, end)


_BODY = {
    "java": re.compile(r"\)\s*(?:throws\s+[\w.,\s<>$]+?)?\{"),
    "javascript": re.compile(r"\)\s*\{"),
    "typescript": re.compile(r"\)\s*(?::\s*(?:[^{}();=]|\{[^{}]*\}|\([^()]*\)\s*=>)+?)?\s*\{"),
}
_ARROW = re.compile(r"\bconst\s+([\w$]+)\s*(?::[^=;]*(?:=>[^=;]*)*)?=\s*(?:async\s*)?(?:<[^<>()]*>\s*)?(?=\(|[\w$]+\s*=>)")
_CONST_FUNCTION = re.compile(r"\bconst\s+([\w$]+)\s*(?::[^=;]+)?=\s*(?:async\s+)?function\s*\*?\s*$")
_FUNCTION = re.compile(r"(?:async\s+)?function\s*\*?\s*([\w$]+)\s*$")
_METHOD = re.compile(r"(?:(?:@[\w.]+(?:\s*\([^()]*\))?|public|private|protected|static|async|get|set|override|abstract|readonly|\*)\s*)*(#?[\w$]+)\s*$")
_NO_NAMES = set("if for while switch catch with function return new synchronized try do else throw super this assert await yield typeof".split())
_GO_DEF = re.compile(r"(?m)^func\s+(?:\([^()]*\)\s*)?(\w+)\s*(?:\[[^\]]*\]\s*)?(?=\()")


def _trimmed(masked: str, at: int) -> int:
    """The end of what stands before ``at`` without blanks."""
    while at and masked[at - 1].isspace():
        at -= 1
    return at


def _name_start(masked: str, at: int) -> int | None:
    """The start of the name that ends before ``at``, however long; None if there is none."""
    end = k = _trimmed(masked, at)
    while k and (masked[k - 1].isalnum() or masked[k - 1] in "_$"):
        k -= 1
    return k if k < end else None


def _boundary(masked: str, at: int, marks: str = ";{}") -> int:
    """The start of the declaration that reaches to ``at``: after the last mark, with blanks skipped."""
    k = max(masked.rfind(c, 0, at) for c in marks) + 1
    if k and masked[k - 1] == "}" and masked[k:at].lstrip()[:1] == ")":  # braces in an annotation
        return _boundary(masked, max(masked.rfind("@", 0, k), 0), marks)
    while k < at and masked[k].isspace():
        k += 1
    return k


def _before(text: str, ends: list[int], spans: list[tuple[int, int]], start: int) -> str:
    """The documentation comment that ends at most one line before ``start``."""
    k = bisect.bisect_right(ends, start) - 1
    if k < 0:
        return ""
    a, b = spans[k]
    gap = text[b:start]
    if gap.strip() or gap.count("\n") > 1 or not text.startswith("/**", a) or b - a < 5:
        return ""
    return "\n".join(re.sub(r"^\s*\*+(?!/)", "", x).strip() for x in text[a + 3 : b - 2].split("\n"))


def _braced(text: str, lang: str) -> list[Pair]:
    spans, comments = [], []
    for m in SPANS[lang].finditer(text):
        spans.append(m.span())
        if m.lastindex == 1:
            comments.append(m.span())
    masked = mask(text, spans)
    pairs, ends = _brackets(masked), [b for _, b in comments]
    out: dict[int, Pair] = {}

    def add(name: str, at: int, start: int, open_: int, params: str) -> None:
        end = pairs.get(open_, len(text) - 1) + 1 if masked[open_ : open_ + 1] == "{" else max(masked.find("\n", open_), open_)
        out.setdefault(at, _pair(text, name, at, start, end, _names(params), _before(text, ends, comments, start)))

    if lang == "java":
        for m in _BODY[lang].finditer(masked):
            open_ = pairs.get(m.start())
            if open_ is None or (at := _name_start(masked, open_)) is None or masked[at : _trimmed(masked, open_)] in _NO_NAMES:
                continue
            name = masked[at : _trimmed(masked, open_)]
            start = _boundary(masked, at)
            head = masked[start:at]
            if not re.search(r"[=.]\s*$|->|=(?!=)|\b(?:new|return|throw|case|record|else|do)\b", re.sub(r"@[\w.]+(?:\s*\([^()]*\))?", "", head)):
                params = masked[open_ + 1 : m.start()]
                add(name, at, start, m.end() - 1, ",".join(p.split()[-1] if p.split() else "" for p in params.split(",")))
        return [*out.values()]
    for m in _BODY[lang].finditer(masked):
        open_ = pairs.get(m.start())
        if open_ is None:
            continue
        at = open_
        if lang == "typescript" and masked[:at].rstrip()[-1:] == ">":
            at = masked.rfind("<", 0, at)
        start = _boundary(masked, at, ";{},")
        head = masked[start:at]
        params = masked[open_ + 1 : m.start()]
        if n := _CONST_FUNCTION.search(head):
            add(n[1], start + n.start(1), start, m.end() - 1, params)
        elif n := _FUNCTION.search(head):
            # a line may start anew without a semicolon before it
            add(n[1], start + n.start(1), start + _last_line(head), m.end() - 1, params)
        elif "=" not in head and (n := _METHOD.match(head.lstrip())) and n[1] not in _NO_NAMES:
            add(n[1], start + len(head) - len(head.lstrip()) + n.start(1), start, m.end() - 1, params)
    for m in _ARROW.finditer(masked):
        k = m.end()
        close = pairs.get(k) if masked[k] == "(" else k
        if close is None or not (arrow := re.compile(r"\)\s*(?::[^=;]*)?=>\s*|[\w$]+\s*=>\s*").match(masked, close)):
            continue
        start = _boundary(masked, m.start(), ";{}")
        add(m[1], m.start(1), start + _last_line(masked[start : m.start(1)]), arrow.end(), masked[k + 1 : close])
    return [*out.values()]


_STARTERS = re.compile(r"(?m)^[ \t]*(?=export\b|async\b|function\b|const\b|@)")


def _last_line(head: str) -> int:
    """The offset of the declaration's first line in what precedes its name, if older text without semicolon is there too."""
    if "\n" not in head.strip():
        return 0
    at = [m.end() for m in _STARTERS.finditer(head)]
    return at[-1] if at and not head[: at[-1]].lstrip().startswith("@") else 0


def _go(text: str) -> list[Pair]:
    spans = [m.span() for m in SPANS["go"].finditer(text)]
    masked = mask(text, spans)
    found = list(_GO_DEF.finditer(masked))
    if not found:
        return []
    pairs, lines = _brackets(masked), text.split("\n")
    out = []
    for m in found:
        close = pairs.get(m.end())
        if close is None:
            continue
        open_ = re.compile(r"\)[^\n{]*\{|\)[^\n]*\{[^\n]*\}\s*\{").match(masked, close)
        if not open_:
            continue
        at = open_.end() - 1
        row = text.count("\n", 0, m.start())
        doc = []
        while row - len(doc) > 0 and (x := lines[row - len(doc) - 1].strip()).startswith("//"):
            doc.append(x)
        doc = [x[2:].strip() for x in reversed(doc) if not re.match(r"//(?:go:|nolint|\s*\+build)", x)]
        out.append(_pair(text, m[1], m.start(1), m.start(), pairs.get(at, len(text) - 1) + 1, _names(masked[m.end() + 1 : close]), "\n".join(doc)))
    return out


def documented_functions(lang: str, text: str) -> list[Pair]:
    """Functions with documentation of their own that says something."""
    found = _python(text) if lang == "python" else _go(text) if lang == "go" else _braced(text, lang)
    return [p for p in found if p.doc and says_something(p.doc, p.name, p.params)]


def function_pairs(files: DataFrame) -> DataFrame:
    """Pairs of function and documentation, once each: file_path, language, name, line_number (of the name),
    end_line_number, parameters, docstring, code.

    Files that don't parse, files of other languages and null or empty contents give none; a null path stays null.
    Texts are read whole; other columns are ignored.
    """
    fields = [("file_path", pa.string()), ("language", pa.string()), ("name", pa.string()), ("line_number", pa.int32()), ("end_line_number", pa.int32()), ("parameters", pa.list_(pa.string())), ("docstring", pa.string()), ("code", pa.string())]

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for path, lang, text in zip(*(strings(batch, c) for c in ("file_path", "language", "content"))):
                lang = language_of(lang, path)
                if text and lang in LANGUAGES and (found := documented_functions(lang, text)) and not syntax_errors(lang, text):
                    rows += [(path, lang, p.name, p.line, p.end_line, p.params, p.doc.strip(), text[p.start : p.end]) for p in found]
            cols = list(zip(*rows)) or [[]] * len(fields)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])

        return run

    schema = "file_path string, language string, name string, line_number int, end_line_number int, parameters array<string>, docstring string, code string"
    return map_rows(files.select("file_path", "language", "content"), make, schema)


def found_pairs(files: DataFrame) -> DataFrame:
    return function_pairs(files).select("file_path", "name", "line_number").distinct()

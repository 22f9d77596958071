"""Tokens of source files, and where comments and string literals lie.

A file becomes a string with one letter for each token: ``a`` identifier, ``0`` number, ``"`` string, ``E`` a token
that the language doesn't have, ``N`` a line end that matters; operators and keywords have letters of their own.
"""

from __future__ import annotations

import re
from pathlib import PurePosixPath

#: Usual spellings and suffixes of the languages.
SPELLINGS = {
    "python": "python", "py": "python", "python3": "python", "py3": "python", "python 3": "python", "cpython": "python",
    "java": "java", "javascript": "javascript", "js": "javascript", "ecmascript": "javascript", "node": "javascript", "nodejs": "javascript", "node.js": "javascript", "mjs": "javascript", "es6": "javascript",
    "typescript": "typescript", "ts": "typescript", "go": "go", "golang": "go", "json": "json",
    "yaml": "yaml", "yml": "yaml", "properties": "properties", "ini": "properties", "shell": "shell", "sh": "shell", "bash": "shell",
}
SUFFIXES = {
    "py": "python", "pyi": "python", "java": "java", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript",
    "go": "go", "json": "json", "yaml": "yaml", "yml": "yaml", "properties": "properties", "ini": "properties", "cfg": "properties", "env": "properties", "sh": "shell", "bash": "shell",
}
PARSED = ("python", "java", "javascript", "typescript", "go", "json")


def language_of(language: str | None, path: str | None) -> str | None:
    """The language in one spelling: by ``language``, or where that is null or blank by the suffix; unknown ones give null."""
    if language and (name := language.strip().lower()):
        return SPELLINGS.get(name)
    return SUFFIXES.get(PurePosixPath(path or "").suffix[1:].lower())


class Letters(dict):
    """Token text to letter; learned ones are kept up to a bound."""

    def __init__(self, fixed: dict[str, str], other):
        super().__init__(fixed)
        self.other, self.least = other, len(fixed)

    def __missing__(self, token: str) -> str:
        letter = self.other(token)
        if len(token) <= 24:
            if len(self) > 200_000:
                for k in list(self)[self.least :]:
                    del self[k]
            self[token] = letter
        return letter


def words(text: str, start: int) -> dict[str, str]:
    return {w: chr(start + i) for i, w in enumerate(text.split())}


#: Keywords and operators of the languages. Those in SOFT may also be identifiers.
KEYWORDS = {
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type _",
    "java": "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null var record sealed permits yield when non-sealed",
    "javascript": "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with yield let static async await of get set from as type interface namespace module declare abstract readonly public private protected implements is keyof infer satisfies asserts override unique accessor",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
}
OPERATORS = {
    "python": "**= //= >>= <<= ... -> := == != <= >= << >> ** // += -= *= /= %= &= |= ^= @=",
    "java": ">>>= <<= >>= ... -> :: ++ -- && || == != <= >= << += -= *= /= %= &= |= ^=",
    "javascript": ">>>= ... === !== **= <<= >>= &&= ||= ??= => ?. ++ -- && || ?? == != <= >= << ** += -= *= /= %= &= |= ^=",
    "go": "<<= >>= &^= ... := <- ++ -- && || == != <= >= << >> &^ += -= *= /= %= &= |= ^=",
}
KEYWORDS["typescript"], OPERATORS["typescript"] = KEYWORDS["javascript"], OPERATORS["javascript"]
LETTER = {lang: words(KEYWORDS[lang], 0x100) | words(OPERATORS[lang], 0x200) for lang in KEYWORDS}
ALL_OPERATORS = {lang: "|".join(map(re.escape, OPERATORS[lang].split())) for lang in OPERATORS}

DQ, SQ = r'"[^"\\\n]*(?:\\(?:\r\n|.)[^"\\\n]*)*"', r"'[^'\\\n]*(?:\\(?:\r\n|.)[^'\\\n]*)*'"
DQ1, SQ1 = DQ.replace(r"(?:\r\n|.)", "[^\\n]"), SQ.replace(r"(?:\r\n|.)", "[^\\n]")
BLOCK, LINE = r"/\*[^*]*\*+(?:[^/*][^*]*\*+)*/", r"//[^\n]*"
_F = lambda q: rf"{q}(?:[^{q}\\\n{{}}]|\\(?:[^{{}}]|(?=[{{}}]))|\{{\{{|\}}\}}|\{{(?:[^{{}}\n]|\{{[^{{}}\n]*\}})*\}})*{q}"
PY_STRING = (
    r"(?:[rRbBuUfF]|[bBfF][rR]|[rR][bBfF])?(?:" + r'"""[^"\\]*(?:(?:\\.|"(?!""))[^"\\]*)*"""' + r"|'''[^'\\]*(?:(?:\\.|'(?!''))[^'\\]*)*''')"
    + rf"|(?:[fF][rR]?|[rR][fF])(?:{_F(chr(34))}|{_F(chr(39))})" + rf"|(?:[rRbBuU]|[bB][rR]|[rR][bB])?(?:(?!\"\"\"){DQ}|(?!''')(?:{SQ}))"
)
TEMPLATE = r"`[^`\\$]*(?:(?:\\.|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*`|\{[^{}]*\})*\})[^`\\$]*)*`"
REGEX = r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-zA-Z]*"
NUMBER, NAME = r"\.?\d(?:[eEpP][+-](?=\d)|[\w.])*", r"[^\W\d]\w*"
# after these, a slash starts a regular expression; one blank may lie between
BEFORE_REGEX = r"(?:(?<=[=(,:;!&|?{}\[\n+*%~^<>-])|(?<=[=(,:;!&|?{}\[+*%~^<>-] )|(?<=return )|(?<=typeof ))"
TOKEN = {
    "python": re.compile(rf"(?:[ \t\f]|\\\r?\n)*((?:\r?\n|\r)[ \t\f]*|#[^\r\n]*|{PY_STRING}|\"\"\"|'''|{NAME}|{NUMBER}|{ALL_OPERATORS['python']}|[^\s])", re.S),
    "java": re.compile(rf"\s*({LINE}|{BLOCK}|\"\"\"[^\"\\]*(?:(?:\\.|\"(?!\"\"))[^\"\\]*)*\"\"\"|{DQ1}|{SQ1}|non-sealed\b|[^\W\d$]?[\w$]*(?<!\d)[\w$]+|{NUMBER}|{ALL_OPERATORS['java']}|[^\s])".replace(r"[^\W\d$]?[\w$]*(?<!\d)[\w$]+", r"(?!\d)[\w$]+")),
    "javascript": re.compile(rf"(?:[ \t\f\v\xa0\ufeff\r])*(\n|\A#![^\n]*|{LINE}|{BLOCK}|{DQ}|{SQ}|{TEMPLATE}|{BEFORE_REGEX}{REGEX}|#?(?!\d)[\w$]+|{NUMBER}|{ALL_OPERATORS['javascript']}|[^\s])", re.S),
    "go": re.compile(rf"[ \t\r\f]*(\n|{LINE}|{BLOCK}|{DQ1}|`[^`]*`|'(?:[^'\\\n]|\\[^\n][^'\n]*)'|{NAME}|{NUMBER}|{ALL_OPERATORS['go']}|[^\s])"),
    "json": re.compile(r'[ \t\r\n]*("[^"\\]*(?:\\.[^"\\]*)*"|-?[0-9][\w.+-]*|\w+|[^ \t\r\n])'),
}
TOKEN["typescript"] = TOKEN["javascript"]

_PY_NUMBER = re.compile(r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:0(?:_?0)*|[1-9](?:_?\d)*)|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)")
_PY_ZEROS = re.compile(r"0[\d_]*[1-9][\d_]*")
_NUMBER = {
    "java": re.compile(r"(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)[lLfFdD]?"),
    "javascript": re.compile(r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:0|[1-9](?:_?\d)*))n?|(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?(?:[eE][+-]?\d+)?|\.\d(?:_?\d)*(?:[eE][+-]?\d+)?"),
    "go": re.compile(r"(?:0[xX](?:_?[0-9a-fA-F])*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB](?:_?[01])+|0[oO]?(?:_?[0-7])+|\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?(?:[eE][+-]?\d+)?|\.\d(?:_?\d)*(?:[eE][+-]?\d+)?)i?"),
}
# strings whose escapes are all known, and character literals
_ESCAPES = {
    "java": re.compile(r"(?:[^\\]|\\(?:[btnfrs\"'\\\n]|[0-7]|u+[0-9a-fA-F]{4}))*", re.S),
    "javascript": re.compile(r"(?:[^\\]|\\(?:[^xu]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u\{[0-9a-fA-F]+\}))*", re.S),
    "go": re.compile(r"(?:[^\\]|\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"),
}
_CHAR = {"java": re.compile(r"'(?:[^'\\]|\\[^']'?|\\[0-7]{1,3}|\\u+[0-9a-fA-F]{4}|\\')'|'\\''"), "go": re.compile(r"'(?:[^'\\]|\\(?:.|[0-7]{3}|x..|u.{4}|U.{8}))'")}
_PY_ESCAPES = re.compile(r"(?:[^\\]|\\(?:[^xuUN]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|N\{[^}]+\}))*", re.S)
_JSON_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")
_JSON_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')


def _python_letter(t: str) -> str:
    c = t[0]
    if c == "#":
        return ""
    if c in "\r\n":
        return "N"
    if t[-1] in "\"'":
        if len(t) < 2 or t in ('"""', "'''"):
            return "E"
        prefix = t[: min(t.find(q) for q in "\"'" if q in t)].lower()
        if "\\" in t and "r" not in prefix and "b" not in prefix and not _PY_ESCAPES.fullmatch(t):
            return "E"
        return ("b" if t.isascii() else "E") if "b" in prefix else '"'
    if c.isdigit() or c == "." and len(t) > 1:
        return "0" if t.isascii() and _PY_NUMBER.fullmatch(t) and not _PY_ZEROS.fullmatch(t) else "E"
    return "a" if t.isidentifier() else c if c in "()[]{},:.;@=<>+-*/%&|^~" and len(t) == 1 else "E"


def _brace_letter(lang: str):
    number = _NUMBER[lang]
    escapes, char = _ESCAPES[lang], _CHAR.get(lang)
    signs = {"java": "()[]{},;:.?@=<>+-*/%&|^~!", "javascript": "()[]{},;:.?@=<>+-*/%&|^~!", "go": "()[]{},;:.=<>+-*/%&|^!~"}[lang]

    def letter(t: str) -> str:
        c = t[0]
        if c == "\n":
            return "N"
        if c == "/" and len(t) > 1:
            if t[1] in "/*":
                return "N" if lang != "java" and t[1] == "*" and "\n" in t else ""
            return "r"
        if c in "\"'`" and len(t) > 1:
            if "\\" in t and c != "`" and not escapes.fullmatch(t) or c == "'" and char and not char.fullmatch(t):
                return "E"
            return "`" if c == "`" and lang == "javascript" else '"' if lang != "java" or c == '"' or len(t) > 2 else "E"
        if c.isdigit() or c == "." and len(t) > 1:
            return "0" if number.fullmatch(t) else "E"
        if lang == "javascript" and c == "#":
            return "" if t[:2] == "#!" else "#" if len(t) > 1 else "E"
        if c in "$_" or c.isidentifier():
            return "a" if all(x == "$" or x == "_" or x.isalnum() or x.isidentifier() for x in t) else "E"
        return c if c in signs else "E"

    return letter


def _json_letter(t: str) -> str:
    if t[0] == '"':
        return '"' if _JSON_STRING.fullmatch(t) else "E"
    return t if t in "{}[],:" else "0" if t in ("true", "false", "null") or _JSON_NUMBER.fullmatch(t) else "E"


LETTERS = {lang: Letters(LETTER[lang], _brace_letter(lang)) for lang in ("java", "javascript", "go")}
LETTERS["python"], LETTERS["json"], LETTERS["typescript"] = Letters(LETTER["python"], _python_letter), Letters({}, _json_letter), LETTERS["javascript"]

# Comments and strings by language, for spans; group 1 is a comment, group 2 a string.
SPANS = {
    "python": re.compile(rf"(#[^\r\n]*)|({PY_STRING})", re.S),
    "java": re.compile(rf"({LINE}|{BLOCK})|(\"\"\"[^\"\\]*(?:(?:\\.|\"(?!\"\"))[^\"\\]*)*\"\"\"|{DQ1}|{SQ1})", re.S),
    "javascript": re.compile(rf"({LINE}|{BLOCK})|({DQ}|{SQ}|{TEMPLATE})|{BEFORE_REGEX}{REGEX}", re.S),
    "go": re.compile(rf"({LINE}|{BLOCK})|({DQ1}|`[^`]*`|'(?:[^'\\\n]|\\[^\n][^'\n]*)')", re.S),
    "json": re.compile(rf"(?!)()|({DQ1})", re.S),
    "yaml": re.compile(rf"((?:(?<=\s)|(?<![^\n]))\#[^\n]*)|({DQ}|{SQ})", re.S),
    "properties": re.compile(r"((?<![^\n])[ \t]*[#!][^\n]*)|(?!)()", re.S),
    "shell": re.compile(rf"((?:(?<=[\s;])|(?<![^\n]))\#[^\n]*)|(\"[^\"\\]*(?:\\.[^\"\\]*)*\"|'[^']*')", re.S),
}


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with the spans blanked; line ends stay, so places and lines are the same."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        part = text[a:b]
        out.append(" " * (b - a) if "\n" not in part else _NOT_LINE_END.sub(" ", part))
        at = b
    out.append(text[at:])
    return "".join(out)


_NOT_LINE_END = re.compile(r"[^\n]")
SPANS["typescript"] = SPANS["javascript"]

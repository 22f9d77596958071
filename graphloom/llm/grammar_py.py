"""Recursive descent over Python's logical lines, with precedence climbing for expressions.

The outcome of a logical line depends on its letters alone, so lines of one shape are parsed once and remembered.
"""

from __future__ import annotations

from graphloom.llm.lex import LETTER, LETTERS, TOKEN


class Bad(Exception):
    """A syntax error at a token of the line."""

    def __init__(self, at: int, what: str):
        self.at, self.what = at, what


K = LETTER["python"]
END = "\0"
NAMES = "a" + K["match"] + K["case"] + K["type"] + K["_"]
CONSTANTS = K["None"] + K["True"] + K["False"] + K["..."]
STRINGS = '"b'
AUGMENTED = "".join(K[x] for x in "**= //= >>= <<= += -= *= /= %= &= |= ^= @=".split())
#: Binding power of binary operators.
POWER = {K["or"]: 1, K["and"]: 2, "<": 4, ">": 4, K["=="]: 4, K[">="]: 4, K["<="]: 4, K["!="]: 4, K["in"]: 4, K["is"]: 4, K["not"]: 4, "|": 5, "^": 6, "&": 7, K["<<"]: 8, K[">>"]: 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10, "@": 10, K["//"]: 10, K["**"]: 12}
BLOCKS = {K[x]: x for x in "class def if elif else for while try except finally with async".split()}


class Line:
    """Parses the letters of one logical line. Methods take and return positions; ``kind`` tells what the last expression was:
    t a name, attribute or item; T several such; * a starred one; x anything else."""

    def __init__(self, s: str):
        self.s, self.kind = s + END * 2, "x"

    def need(self, i: int, c: str, what: str) -> int:
        if self.s[i] != c:
            raise Bad(i, f"expected {what}")
        return i + 1

    def name(self, i: int) -> int:
        if self.s[i] not in NAMES:
            raise Bad(i, "expected a name")
        return i + 1

    # expressions
    def test(self, i: int) -> int:
        s = self.s
        if s[i] == K["lambda"]:
            i = self.need(self.params(i + 1, ":", False), ":", "':'")
            i = self.test(i)
            self.kind = "x"
            return i
        i = self.binary(i, 0)
        if s[i] == K["if"]:
            i = self.need(self.binary(i + 1, 0), K["else"], "'else'")
            i = self.test(i)
            self.kind = "x"
        return i

    def named(self, i: int) -> int:
        if self.s[i] in NAMES and self.s[i + 1] == K[":="]:
            i = self.test(i + 2)
            self.kind = "x"
            return i
        return self.test(i)

    def binary(self, i: int, least: int) -> int:
        s = self.s
        c = s[i]
        if c == K["not"]:
            if least > 3:
                raise Bad(i, "'not' after an operator")
            i = self.binary(i + 1, 3)
            self.kind = "x"
        elif c in "+-~":
            i = self.binary(i + 1, 11)
            self.kind = "x"
        else:
            i = self.primary(i)
        while (power := POWER.get(s[i], -1)) >= least and power > 0:
            c = s[i]
            if c == K["not"]:
                i = self.need(i + 1, K["in"], "'in'") - 1
            elif c == K["is"] and s[i + 1] == K["not"]:
                i += 1
            i = self.binary(i + 1, 11 if power == 12 else power + 1)
            self.kind = "x"
        return i

    def primary(self, i: int) -> int:
        s = self.s
        if s[i] == K["await"]:
            i = self.primary(i + 1)
            self.kind = "x"
            return i
        c = s[i]
        if c in NAMES:
            i, self.kind = i + 1, "t"
        elif c in STRINGS:
            while s[i] == c:
                i += 1
            if s[i] in STRINGS:
                raise Bad(i, "bytes and text side by side")
            self.kind = "x"
        elif c == "0" or c in CONSTANTS:
            i, self.kind = i + 1, "x"
        elif c == "(":
            i = self.round(i)
        elif c == "[":
            i = self.square(i)
        elif c == "{":
            i = self.curly(i)
        else:
            raise Bad(i, "expected an expression")
        while (c := s[i]) in "(.[":
            if c == ".":
                i, self.kind = self.name(i + 1), "t"
            elif c == "(":
                i = self.args(i + 1)
                self.kind = "x"
            else:
                i = self.slices(i + 1)
                self.kind = "t"
        return i

    def element(self, i: int) -> int:
        """An expression, maybe starred."""
        if self.s[i] == "*":
            i = self.binary(i + 1, 5)
            self.kind = "*" if self.kind in "tT" else "x"
            return i
        return self.named(i)

    def elements(self, i: int, close: str) -> int:
        """Elements with commas up to ``close``; kind T if all are targets."""
        ok = True
        while self.s[i] != close:
            i = self.element(i)
            ok &= self.kind in "tT*"
            if self.s[i] != ",":
                break
            i += 1
        self.kind = "T" if ok else "x"
        return i

    def round(self, i: int) -> int:
        s = self.s
        i += 1
        if s[i] == ")":
            self.kind = "T"
            return i + 1
        if s[i] == K["yield"]:
            i = self.yields(i)
        else:
            i = self.element(i)
            one = self.kind
            if s[i] in (K["for"], K["async"]):
                i = self.comprehension(i)
                self.kind = "x"
            elif s[i] == ",":
                i = self.elements(i + 1, ")")
                self.kind = "T" if self.kind == "T" and one in "tT*" else "x"
            elif one == "*":
                raise Bad(i, "a starred expression on its own")
        kind = self.kind
        i = self.need(i, ")", "')'")
        self.kind = kind
        return i

    def square(self, i: int) -> int:
        s = self.s
        i += 1
        if s[i] == "]":
            self.kind = "T"
            return i + 1
        j = self.element(i)
        if s[j] in (K["for"], K["async"]):
            i = self.comprehension(j)
            kind = "x"
        else:
            i, kind = self.elements(i, "]"), self.kind
        i = self.need(i, "]", "']'")
        self.kind = kind
        return i

    def curly(self, i: int) -> int:
        s = self.s
        i += 1
        pairs = None
        while s[i] != "}":
            if s[i] == K["**"]:
                i, pair = self.binary(i + 1, 5), True
            elif s[i] == "*":
                i, pair = self.binary(i + 1, 5), False
            else:
                i = self.named(i)
                pair = s[i] == ":"
                if pair:
                    i = self.test(i + 1)
                if s[i] in (K["for"], K["async"]) and pairs is None:
                    i = self.comprehension(i)
                    break
            if pairs is not None and pair != pairs:
                raise Bad(i, "pairs and elements in one display")
            pairs = pair
            if s[i] != ",":
                break
            i += 1
        i = self.need(i, "}", "'}'")
        self.kind = "x"
        return i

    def comprehension(self, i: int) -> int:
        s = self.s
        while s[i] in (K["for"], K["async"]):
            i = self.need(i + (s[i] == K["async"]), K["for"], "'for'")
            i = self.need(self.targets(i, K["in"]), K["in"], "'in'")
            i = self.binary(i, 0)
            if s[i] == K["if"]:  # a condition belongs to the source only with else
                pass
            while s[i] == K["if"]:
                i = self.named_condition(i + 1)
        return i

    def named_condition(self, i: int) -> int:
        if self.s[i] in NAMES and self.s[i + 1] == K[":="]:
            i += 2
        return self.binary(i, 0)

    def targets(self, i: int, stop: str) -> int:
        """Targets of a loop: expressions without comparisons."""
        count = 0
        while self.s[i] != stop:
            i = self.binary(i + (self.s[i] == "*"), 5)
            if self.kind not in "tT":
                raise Bad(i, "no target")
            count += 1
            if self.s[i] != ",":
                break
            i += 1
        if not count:
            raise Bad(i, "expected a target")
        return i

    def args(self, i: int) -> int:
        s = self.s
        keyword, first = False, i
        while s[i] != ")":
            if s[i] == "*":
                i = self.test(i + 1)
            elif s[i] == K["**"]:
                i, keyword = self.test(i + 1), True
            elif s[i] in NAMES and s[i + 1] == "=":
                i, keyword = self.test(i + 2), True
            else:
                at = i
                i = self.named(i)
                if s[i] in (K["for"], K["async"]):
                    i = self.comprehension(i)
                    if at != first or s[i] != ")":
                        raise Bad(i, "a generator needs parentheses here")
                elif keyword:
                    raise Bad(at, "a positional argument after a keyword one")
            if s[i] != ",":
                break
            i += 1
        return self.need(i, ")", "')'")

    def slices(self, i: int) -> int:
        s = self.s
        if s[i] == "]":
            raise Bad(i, "empty index")
        while s[i] != "]":
            if s[i] == "*":
                i = self.binary(i + 1, 5)
            elif s[i] != ":":
                i = self.named(i)
            for _ in range(2):
                if s[i] == ":":
                    i += 1
                    if s[i] not in ":,]":
                        i = self.test(i)
            if s[i] != ",":
                break
            i += 1
        return self.need(i, "]", "']'")

    def yields(self, i: int) -> int:
        i += 1
        if self.s[i] == K["from"]:
            i = self.test(i + 1)
        elif self.s[i] not in ")=;}]" + END:
            i = self.expressions(i)
        self.kind = "x"
        return i

    def expressions(self, i: int) -> int:
        """Elements with commas, as in a statement."""
        s = self.s
        if s[i] == K["yield"]:
            return self.yields(i)
        i = self.star(i)
        kind = self.kind
        if s[i] != ",":
            if kind == "*":
                raise Bad(i, "a starred expression on its own")
            return i
        ok = kind in "tT*"
        while s[i] == ",":
            i += 1
            if s[i] in ("=", ";", ":", ")", END) or s[i] in AUGMENTED:
                break
            i = self.star(i)
            ok &= self.kind in "tT*"
        self.kind = "T" if ok else "x"
        return i

    def star(self, i: int) -> int:
        if self.s[i] == "*":
            return self.element(i)
        return self.test(i)

    def params(self, i: int, close: str, typed: bool = True) -> int:
        s = self.s
        default = star = rest = slash = False
        count = 0
        while s[i] != close:
            if rest:
                raise Bad(i, "a parameter after '**'")
            if s[i] == "/":
                if star or slash or not count:
                    raise Bad(i, "misplaced '/'")
                i, slash = i + 1, True
            elif s[i] == "*":
                if star:
                    raise Bad(i, "two '*'")
                i, star = i + 1, True
                if s[i] == ",":
                    if s[i + 1] == close or s[i + 1] == K["**"]:
                        raise Bad(i, "nothing after '*'")
                else:
                    i = self.name(i)
                    if typed and s[i] == ":":
                        i = self.element(i + 1)
            elif s[i] == K["**"]:
                i, rest = self.name(i + 1), True
                if typed and s[i] == ":":
                    i = self.test(i + 1)
            else:
                at = i
                i = self.name(i)
                if typed and s[i] == ":":
                    i = self.test(i + 1)
                if s[i] == "=":
                    i = self.test(i + 1)
                    default = True
                elif default and not star:
                    raise Bad(at, "a parameter without default after one with")
            count += 1
            if s[i] != ",":
                break
            i += 1
        return i

    # statements
    def simple(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in (K["pass"], K["break"], K["continue"]):
            return i + 1
        if c == K["return"]:
            return i + 1 if s[i + 1] in ";" + END else self.expressions(i + 1)
        if c == K["raise"]:
            if s[i + 1] in ";" + END:
                return i + 1
            i = self.test(i + 1)
            return self.test(i + 1) if s[i] == K["from"] else i
        if c in (K["global"], K["nonlocal"]):
            i = self.name(i + 1)
            while s[i] == ",":
                i = self.name(i + 1)
            return i
        if c == K["del"]:
            i = self.expressions(i + 1)
            if self.kind not in "tT":
                raise Bad(i, "can't be deleted")
            return i
        if c == K["assert"]:
            i = self.test(i + 1)
            return self.test(i + 1) if s[i] == "," else i
        if c == K["import"]:
            while True:
                i = self.name(i + 1)
                while s[i] == ".":
                    i = self.name(i + 1)
                if s[i] == K["as"]:
                    i = self.name(i + 1)
                if s[i] != ",":
                    return i
        if c == K["from"]:
            i += 1
            dots = i
            while s[i] == "." or s[i] == K["..."]:
                i += 1
            if s[i] != K["import"] or i == dots:
                i = self.name(i)
                while s[i] == ".":
                    i = self.name(i + 1)
            i = self.need(i, K["import"], "'import'")
            if s[i] == "*":
                return i + 1
            bracket = s[i] == "("
            i += bracket
            while True:
                i = self.name(i)
                if s[i] == K["as"]:
                    i = self.name(i + 1)
                if s[i] != ",":
                    break
                i += 1
                if bracket and s[i] == ")":
                    break
            return self.need(i, ")", "')'") if bracket else i
        if c == K["type"] and s[i + 1] in NAMES:
            i = self.name(i + 1)
            if s[i] == "[":
                i = self.type_params(i + 1)
            return self.test(self.need(i, "=", "'='"))
        i = self.expressions(i)
        kind = self.kind
        if s[i] in AUGMENTED:
            if kind != "t":
                raise Bad(i, "no target of an assignment")
            return self.expressions(i + 1)
        if s[i] == ":":
            if kind != "t":
                raise Bad(i, "no target of an annotation")
            i = self.test(i + 1)
            return self.expressions(i + 1) if s[i] == "=" else i
        while s[i] == "=":
            if kind not in "tT":
                raise Bad(i, "no target of an assignment")
            i = self.expressions(i + 1)
            kind = self.kind
        return i

    def simples(self, i: int) -> None:
        s = self.s
        while True:
            i = self.simple(i)
            if s[i] == END:
                return
            i = self.need(i, ";", "the end of the statement")
            if s[i] == END:
                return

    def type_params(self, i: int) -> int:
        s = self.s
        while s[i] != "]":
            i = self.name(i + (s[i] == "*" or s[i] == K["**"]))
            if s[i] == ":":
                i = self.test(i + 1)
            if s[i] == "=":
                i = self.test(i + 1)
            if s[i] != ",":
                break
            i += 1
        return self.need(i, "]", "']'")

    def header(self, i: int) -> tuple[str, int]:
        """The kind of a compound statement's line, and the position after its colon."""
        s = self.s
        c = s[i]
        what = BLOCKS[c]
        if c == K["async"]:
            i += 1
            if s[i] not in (K["def"], K["for"], K["with"]):
                raise Bad(i, "nothing for 'async'")
            what = BLOCKS[s[i]]
        i += 1
        if what in ("if", "elif", "while"):
            i = self.named(i)
        elif what == "for":
            i = self.need(self.targets(i, K["in"]), K["in"], "'in'")
            i = self.expressions(i)
        elif what == "except":
            i += s[i] == "*"
            if s[i] != ":":
                i = self.test(i)
                if s[i] == K["as"]:
                    i = self.name(i + 1)
        elif what == "with":
            i = self.with_items(i)
        elif what == "class":
            i = self.name(i)
            if s[i] == "[":
                i = self.type_params(i + 1)
            if s[i] == "(":
                i = self.args(i + 1)
        elif what == "def":
            i = self.name(i)
            if s[i] == "[":
                i = self.type_params(i + 1)
            i = self.need(i, "(", "'('")
            i = self.need(self.params(i, ")"), ")", "')'")
            if s[i] == K["->"]:
                i = self.test(i + 1)
        return what, self.need(i, ":", "':'")

    def with_items(self, i: int) -> int:
        s = self.s

        def items(i: int, close: str) -> int:
            while True:
                i = self.test(i)
                if s[i] == K["as"]:
                    i = self.binary(i + 1, 5)
                    if self.kind not in "tT":
                        raise Bad(i, "no target")
                if s[i] != ",":
                    return i
                i += 1
                if s[i] == close:
                    return i

        if s[i] == "(":
            try:
                j = self.need(items(i + 1, ")"), ")", "')'")
                if s[j] == ":":
                    return j
            except Bad:
                pass
        return items(i, "")

    def pattern(self, i: int) -> int:
        s = self.s
        while True:
            i = self.closed(i)
            if s[i] != "|":
                break
            i += 1
        return self.name(i + 1) if s[i] == K["as"] else i

    def patterns(self, i: int, close: str) -> int:
        s = self.s
        while s[i] not in close:
            if s[i] == "*":
                i = self.name(i + 1)
            elif s[i] == K["**"]:
                i = self.name(i + 1)
            elif s[i] in NAMES and s[i + 1] == "=":
                i = self.pattern(i + 2)
            else:
                i = self.pattern(i)
                if s[i] == ":" and close == "}":
                    i = self.pattern(i + 1)
            if s[i] != ",":
                break
            i += 1
        return i

    def closed(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in "([{":
            close = {"(": ")", "[": "]", "{": "}"}[c]
            return self.need(self.patterns(i + 1, close), close, close)
        if c in NAMES:
            i += 1
            while s[i] == ".":
                i = self.name(i + 1)
            return self.need(self.patterns(i + 1, ")"), ")", "')'") if s[i] == "(" else i
        i += c == "-"
        if s[i] in STRINGS or s[i] in CONSTANTS:
            return self.primary(i)
        i = self.need(i, "0", "a pattern")
        return self.need(i + 1, "0", "a number") if s[i] in "+-" else i

    def classify(self) -> str:
        """What the line is: a word for its kind, with ``:`` if a block must follow; ``open`` if a bracket is open."""
        s = self.s
        c = s[0]
        if c == "@":
            if s[self.named(1)] != END:
                raise Bad(1, "decorator")
            return "decorator"
        if c in BLOCKS:
            what, i = self.header(0)
            if s[i] == END:
                return what + ":"
            self.simples(i)
            return what
        try:
            self.simples(0)
            return "simple"
        except Bad as bad:
            if c not in (K["match"], K["case"]):
                raise
            try:
                if c == K["match"]:
                    i = self.need(self.expressions(1), ":", "':'")
                    what = "match:"
                else:
                    i = self.patterns(1, ":" + K["if"])
                    if i == 1:
                        raise Bad(1, "expected a pattern")
                    if s[i] == K["if"]:
                        i = self.named(i + 1)
                    i = self.need(i, ":", "':'")
                    what = "case:"
            except Bad as other:
                raise (other if other.at >= bad.at else bad) from None
            if s[i] == END:
                return what
            if what == "match:":
                raise Bad(i, "expected a block") from None
            self.simples(i)
            return "case"


SHAPES: dict[str, str | tuple[int, str]] = {}


def shape(line: str) -> str | tuple[int, str]:
    """The kind of a line, or where and why it is wrong; remembered by its letters."""
    r = SHAPES.get(line)
    if r is None:
        if line.count("(") + line.count("[") + line.count("{") > line.count(")") + line.count("]") + line.count("}"):
            r = "open"
        else:
            try:
                r = Line(line).classify()
            except Bad as bad:
                r = (bad.at, bad.what)
        if len(line) <= 300:
            if len(SHAPES) > 200_000:
                SHAPES.clear()
            SHAPES[line] = r
    return r


def column(newline: str) -> int:
    indent = newline.lstrip("\r\n").rpartition("\f")[2]
    return len(indent) if "\t" not in indent else len(indent.expandtabs(8))


class File:
    """Statements by recursive descent over logical lines; wrong lines are stored and skipped."""

    FOLLOW = {"if": {"elif", "else"}, "elif": {"elif", "else"}, "for": {"else"}, "while": {"else"}, "try": {"except", "finally"}, "except": {"except", "else", "finally"}, "else": {"finally"}}

    def __init__(self, text: str):
        self.tokens = TOKEN["python"].findall("\n" + text.removeprefix("\ufeff"))
        letters = [*map(LETTERS["python"].__getitem__, self.tokens), "N"]
        ends = [k for k, c in enumerate(letters) if c == "N"]
        self.errors: list[tuple[int, str]] = []  # token, cause
        self.lines: list[tuple[int, str, int]] = []  # column, kind, first token
        n = 0
        while n < len(ends) - 1:
            a, m = ends[n] + 1, n + 1
            line = "".join(letters[a : ends[m]])
            if line:
                kind = shape(line)
                while kind == "open" and m < len(ends) - 1:  # a bracket is open: the line goes on
                    m += 1
                    if more := "".join(letters[ends[m - 1] + 1 : ends[m]]):
                        line += more
                        kind = shape(line)
                if kind == "open":
                    self.errors.append((a, "a bracket that is never closed"))
                    kind = "simple"
                elif kind.__class__ is tuple:
                    self.errors.append((self.token(a, kind[0], letters), kind[1]))
                    kind = "wrong"
                self.lines.append((column(self.tokens[ends[n]]), kind, a))
            n = m
        self.at = 0
        while self.at < len(self.lines):
            col, _, a = self.lines[self.at]
            if col:
                self.errors.append((a, "unexpected indent"))
            self.block(col)

    @staticmethod
    def token(a: int, k: int, letters: list[str]) -> int:
        """The k-th token from a that counts."""
        while k >= 0 and a < len(letters) - 1:
            k -= letters[a] not in ("", "N")
            a += 1
        return max(a - 1, 0)

    def block(self, col: int, only: str = "") -> None:
        lines, before = self.lines, ""
        while self.at < len(lines) and lines[self.at][0] >= col:
            c, kind, a = lines[self.at]
            if c > col:
                self.errors.append((a, "unexpected indent"))
                self.block(c)
                before = ""
                continue
            self.at += 1
            word = kind.rstrip(":")
            if word in ("elif", "else", "except", "finally") and word not in self.FOLLOW.get(before, ()):
                self.errors.append((a, f"'{word}' without its statement"))
            elif before == "decorator" and word not in ("def", "class", "decorator", "wrong"):
                self.errors.append((a, "a decorator of nothing"))
            elif before == "try" and word not in ("except", "finally"):
                self.errors.append((a, "'try' without 'except'"))
            if (word == "case") != (only == "case") and word != "wrong":
                self.errors.append((a, "misplaced 'case'"))
            deeper = self.at < len(lines) and lines[self.at][0] > col
            if kind[-1] == ":":
                if deeper:
                    self.block(lines[self.at][0], "case" if word == "match" else "")
                    if self.at < len(lines) and lines[self.at][0] > col:
                        self.errors.append((lines[self.at][2], "unindent to no outer level"))
                else:
                    self.errors.append((a, "expected an indented block"))
            elif kind == "wrong" and deeper:  # its block is still read
                self.block(lines[self.at][0])
            # an else of a loop or condition takes no finally
            before = word if word != "else" or before in ("except", "try") else ""
        if before in ("decorator", "try"):
            self.errors.append((lines[self.at - 1][2], f"the file or block ends after '{before}'"))

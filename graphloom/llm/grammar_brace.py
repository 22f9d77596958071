"""Recursive-descent statements and precedence-climbing expressions for Java, JavaScript, TypeScript, Go and JSON.

Methods take and return positions in the string of token letters. Headers, types and statements without braces depend
on few letters only; their outcome is remembered by those letters. A wrong statement is stored and skipped.
"""

from __future__ import annotations

import re

from graphloom.llm.grammar_py import Bad
from graphloom.llm.lex import LETTER, LETTERS, TOKEN

END = "\0"
#: Deeper nesting counts as an error.
MAX_DEPTH = 5000
STOP = re.compile(r"[{};N\0]")


def remember(f):
    """Keep the outcome by the letters up to the next brace, line end or semicolon, if nothing beyond was looked at."""
    table: dict = {}

    def g(p, i: int) -> int:
        s = p.s
        j = STOP.search(s, i).end()
        key = (s[i:j], p.mode) if j - i < 200 else None
        r = table.get(key)
        if r is not None:
            p.kind = r[1]
            return i + r[0]
        seen, p.seen = p.seen, i
        e = f(p, i)
        if e < j and p.seen < j and key:
            if len(table) > 100_000:
                table.clear()
            table[key] = (e - i, p.kind)
        p.seen = max(seen, p.seen)
        return e

    return g


class Brace:
    """What the languages share. ``mode`` holds flags that change the grammar; ``kind`` tells what the last expression
    was: ``call``, ``set`` (assignment, increment), ``name`` or ``x``."""

    lang = ""
    NAMES = "a"
    LITERALS = '0"'

    def __init__(self, text: str):
        self.tokens = TOKEN[self.lang].findall(text)
        letters = list(map(LETTERS[self.lang].__getitem__, self.tokens))
        self.s = self.clean("".join(letters)) + END * 4
        self.letters = letters
        self.errors: list[tuple[int, str]] = []
        self.mode, self.kind, self.seen, self.depth = 0, "x", 0, 0
        try:
            self.file(0)
        except Bad as bad:  # nothing to go on with
            self.errors.append((bad.at, bad.what))
        if self.errors:
            # positions in the cleaned letters to tokens that count: those that are neither comments nor line ends
            places = [k for k, c in enumerate(letters) if c and c != "N"]
            solid = [0]
            for c in self.s:
                solid.append(solid[-1] + (c not in "N" and not (c == ";" and self.lang == "go")))
            self.errors = [(places[min(solid[min(i, len(solid) - 1)], len(places) - 1)] if places else 0, why) for i, why in self.errors]

    def clean(self, s: str) -> str:
        return s

    def need(self, i: int, c: str, what: str = "") -> int:
        if self.s[i] != c:
            raise Bad(i, f"expected {what or repr(c)}")
        return i + 1

    def name(self, i: int) -> int:
        if self.s[i] not in self.NAMES:
            raise Bad(i, "expected a name")
        return i + 1

    def closing(self, i: int) -> int:
        """The position after the bracket that closes the one at i; -1 if none does."""
        s, depth = self.s, 0
        while (c := s[i]) != END:
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
                if not depth:
                    self.seen = max(self.seen, i + 1)
                    return i + 1
            i += 1
        self.seen = max(self.seen, i)
        return -1

    def recover(self, i: int, bad: Bad) -> int:
        """Panic mode: store the error and go on after the end of the statement, or before the brace that ends the block."""
        self.errors.append((bad.at, bad.what))
        s, i, depth = self.s, max(i, bad.at), 0
        while (c := s[i]) != END:
            if c == "{":
                depth += 1
            elif c == "}":
                if not depth:
                    return i
                depth -= 1
                if not depth:
                    return i + 1
            elif c in ";N" and not depth:
                return i + 1
            i += 1
        return i

    def body(self, i: int, one) -> int:
        """``{`` then ``one`` again and again, then ``}``."""
        s = self.s
        i = self.need(i, "{")
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise Bad(i, "nested too deeply")
        while (c := s[i]) != "}":
            if c == END:
                self.depth -= 1
                raise Bad(i, "a brace that is never closed")
            if c == "N":
                i += 1
                continue
            mode = self.mode
            try:
                j = one(i)
                if j == i:
                    raise Bad(i, "unexpected token")
                i = j
            except Bad as bad:
                self.mode = mode
                if s[bad.at] == END:
                    self.depth -= 1
                    raise
                i = self.recover(i, bad)
        self.depth -= 1
        return i + 1

    def top(self, i: int, one) -> int:
        s, depth = self.s, self.depth
        while s[i] != END:
            self.mode, self.depth = 0, depth
            if s[i] == "N":
                i += 1
                continue
            try:
                j = one(i)
                if j == i:
                    raise Bad(i, "unexpected token")
                i = j
            except Bad as bad:
                i = self.recover(i, bad)
                i += s[i] == "}"
        return i

    def listed(self, i: int, close: str, one, trailing: bool = True) -> int:
        """Items with commas, then ``close``."""
        s = self.s
        while s[i] != close:
            i = one(i)
            if s[i] != ",":
                break
            i += 1
            if s[i] == close and not trailing:
                raise Bad(i, "nothing after ','")
        return self.need(i, close)


class Json(Brace):
    lang = "json"

    def file(self, i: int) -> None:
        i = self.value(0)
        if self.s[i] != END:
            raise Bad(i, "text after the value")

    def value(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in '"0':
            return i + 1
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise Bad(i, "nested too deeply")
        if c == "[":
            i = self.listed(i + 1, "]", self.value, False)
        elif c == "{":
            i = self.listed(i + 1, "}", self.pair, False)
        else:
            raise Bad(i, "expected a value")
        self.depth -= 1
        return i

    def pair(self, i: int) -> int:
        i = self.need(i, '"', "a name")
        return self.value(self.need(i, ":"))


J = LETTER["java"]
J_POWER = {J["||"]: 1, J["&&"]: 2, "|": 3, "^": 4, "&": 5, J["=="]: 6, J["!="]: 6, "<": 7, ">": 7, J["<="]: 7, J["instanceof"]: 7, J["<<"]: 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}


class Java(Brace):
    lang = "java"
    NAMES = "a" + "".join(J[w] for w in "var record sealed permits yield when".split())
    PRIMITIVES = "".join(J[w] for w in "boolean byte char short int long float double".split())
    MODIFIERS = "".join(J[w] for w in "public private protected static final abstract native synchronized transient volatile strictfp default sealed non-sealed".split())
    ASSIGN = "=" + "".join(J[w] for w in "<<= >>= >>>= += -= *= /= %= &= |= ^=".split() if w in J)
    CONST = '0"' + J["true"] + J["false"] + J["null"]

    def file(self, i: int) -> None:
        s = self.s
        j = self.modifiers(i)
        if s[j] == J["package"]:
            i = self.need(self.qualified(j + 1), ";")
        while s[i] in (J["import"], ";"):
            try:
                i = self.imports(i)
            except Bad as bad:
                i = self.recover(i, bad)
        self.top(i, self.type_decl)

    def imports(self, i: int) -> int:
        s = self.s
        if s[i] == ";":
            return i + 1
        i += 1 + (s[i + 1] == J["static"])
        i = self.name(i)
        while s[i] == ".":
            if s[i + 1] == "*":
                return self.need(i + 2, ";")
            i = self.name(i + 1)
        return self.need(i, ";")

    def qualified(self, i: int) -> int:
        i = self.name(i)
        while self.s[i] == ".":
            i = self.name(i + 1)
        return i

    def modifiers(self, i: int) -> int:
        s = self.s
        while True:
            if s[i] == "@" and s[i + 1] != J["interface"]:
                i = self.qualified(i + 1)
                if s[i] == "(":
                    i = self.listed(i + 1, ")", self.annotation_value)
            elif s[i] in self.MODIFIERS and not (s[i] == J["default"] and s[i + 1] in (":", J["->"])) and not (s[i] == J["sealed"] and s[i + 1] in "=.;,()"):
                i += 1
            else:
                return i

    def annotation_value(self, i: int) -> int:
        s = self.s
        if s[i] in self.NAMES and s[i + 1] == "=":
            i += 2
        if s[i] == "{":
            return self.listed(i + 1, "}", self.annotation_value)
        if s[i] == "@":
            return self.modifiers(i)
        return self.ternary(i)

    def type_decl(self, i: int) -> int:
        s = self.s
        if s[i] == ";":
            return i + 1
        return self.typed(self.modifiers(i))

    def typed(self, i: int) -> int:
        """A class, interface, enum, record or annotation type after its modifiers."""
        s = self.s
        if s[i] == "@":
            return self.body(self.name(self.need(i + 1, J["interface"])), self.member)
        c = s[i]
        if c not in (J["class"], J["interface"], J["enum"], J["record"]):
            raise Bad(i, "expected a type declaration")
        i = self.head(i)
        return self.enum_body(i) if c == J["enum"] else self.body(i, self.member)

    @remember
    def head(self, i: int) -> int:
        s = self.s
        record = s[i] == J["record"]
        i = self.name(i + 1)
        if s[i] == "<":
            i = self.type_params(i)
        if record:
            i = self.params(i)
        while s[i] in (J["extends"], J["implements"], J["permits"]):
            i = self.type(i + 1)
            while s[i] == ",":
                i = self.type(i + 1)
        return i

    def enum_body(self, i: int) -> int:
        s = self.s
        i = self.need(i, "{")
        while s[i] not in ";}":
            i = self.name(self.modifiers(i))
            if s[i] == "(":
                i = self.listed(i + 1, ")", self.expr, False)
            if s[i] == "{":
                i = self.body(i, self.member)
            if s[i] != ",":
                break
            i += 1
        if s[i] == ";":
            return self.body_rest(i + 1, self.member)
        return self.need(i, "}")

    def body_rest(self, i: int, one) -> int:
        s = self.s
        while s[i] != "}":
            if s[i] == END:
                raise Bad(i, "a brace that is never closed")
            i = one(i)
        return i + 1

    def type_params(self, i: int) -> int:
        def one(i: int) -> int:
            i = self.name(self.modifiers(i))
            if self.s[i] == J["extends"]:
                i = self.type(i + 1)
                while self.s[i] == "&":
                    i = self.type(i + 1)
            return i

        return self.listed(i + 1, ">", one, False)

    def type(self, i: int) -> int:
        s = self.s
        if s[i] == "@":
            i = self.modifiers(i)
        if s[i] in self.PRIMITIVES:
            i += 1
        else:
            while True:
                i = self.name(i)
                if s[i] == "<":
                    i = i + 2 if s[i + 1] == ">" else self.listed(i + 1, ">", self.type_arg, False)
                if s[i] != "." or s[i + 1] not in self.NAMES:
                    break
                i += 1
        while s[i] == "[" and s[i + 1] == "]":
            i += 2
        return i

    def type_arg(self, i: int) -> int:
        s = self.s
        i = self.modifiers(i) if s[i] == "@" else i
        if s[i] == "?":
            return self.type(i + 2) if s[i + 1] in (J["extends"], J["super"]) else i + 1
        return self.type(i)

    def params(self, i: int) -> int:
        def one(i: int) -> int:
            i = self.type(self.modifiers(i))
            i += self.s[i] == J["..."]
            if self.s[i] == J["this"]:
                return i + 1
            return self.dims(self.name(i))

        return self.listed(self.need(i, "("), ")", one, False)

    def dims(self, i: int) -> int:
        while self.s[i] == "[" and self.s[i + 1] == "]":
            i += 2
        return i

    def member(self, i: int) -> int:
        s = self.s
        if s[i] == ";":
            return i + 1
        if s[i] == "{":
            return self.body(i, self.statement)
        j = self.modifiers(i)
        if s[j] == "{" and j == i + 1 and s[i] == J["static"]:
            return self.body(j, self.statement)
        if s[j] in (J["class"], J["interface"], J["enum"], "@") or s[j] == J["record"] and s[j + 1] in self.NAMES and s[j + 2] in "(<":
            return self.typed(j)
        i = self.member_head(i)
        if self.kind == "method":
            return i + 1 if s[i] == ";" else self.body(i, self.statement)
        if self.kind == "compact":
            return self.body(i, self.statement)
        return self.declarators(i)

    @remember
    def member_head(self, i: int) -> int:
        """Modifiers, type, name, parameters; kind is method, compact (of a record) or field."""
        s = self.s
        i = self.modifiers(i)
        if s[i] == "<":
            i = self.type_params(i)
        if s[i] in self.NAMES and s[i + 1] in "({":
            self.kind = "method"
            if s[i + 1] == "{":
                self.kind = "compact"
                return i + 1
            i = self.params(i + 1)
        else:
            i = i + 1 if s[i] == J["void"] else self.type(i)
            if s[i] in self.NAMES and s[i + 1] == "(":
                i = self.dims(self.params(i + 1))
                if s[i] == J["default"]:
                    i = self.annotation_value(i + 1)
                self.kind = "method"
            else:
                self.name(i)
                self.kind = "field"
                return i
        if s[i] == J["throws"]:
            i = self.type(i + 1)
            while s[i] == ",":
                i = self.type(i + 1)
        if s[i] not in ";{":
            raise Bad(i, "expected a body")
        self.kind = "method"
        return i

    def declarators(self, i: int) -> int:
        s = self.s
        while True:
            i = self.dims(self.name(i))
            if s[i] == "=":
                i = self.initial(i + 1)
            if s[i] != ",":
                return self.need(i, ";")
            i += 1

    def initial(self, i: int) -> int:
        return self.listed(i + 1, "}", self.initial) if self.s[i] == "{" else self.expr(i)

    # statements
    def block(self, i: int) -> int:
        return self.body(i, self.statement)

    def statement(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == "{":
            return self.block(i)
        if c == J["if"]:
            i = self.statement(self.condition(i + 1))
            return self.statement(i + 1) if s[i] == J["else"] else i
        if c == J["while"]:
            return self.statement(self.condition(i + 1))
        if c == J["for"]:
            return self.statement(self.loop(i + 1))
        if c == J["do"]:
            i = self.need(self.statement(i + 1), J["while"], "'while'")
            return self.need(self.condition(i), ";")
        if c == J["try"]:
            i += 1
            ok = False
            if s[i] == "(":
                ok = True
                i = self.resources(i + 1)
            i = self.block(i)
            while s[i] == J["catch"]:
                ok = True
                i = self.modifiers(self.need(i + 1, "("))
                i = self.type(i)
                while s[i] == "|":
                    i = self.type(i + 1)
                i = self.block(self.need(self.name(i), ")"))
            if s[i] == J["finally"]:
                return self.block(i + 1)
            if not ok:
                raise Bad(i, "'try' without 'catch'")
            return i
        if c == J["switch"]:
            j = self.switch(i)
            return j + 1 if s[j] == ";" else j
        if c == J["synchronized"] and s[i + 1] == "(":
            return self.block(self.condition(i + 1))
        if c in self.NAMES and s[i + 1] == ":":
            return self.statement(i + 2)
        if c in (J["class"], J["interface"], J["enum"], J["abstract"], J["static"]) or c == J["record"] and s[i + 1] in self.NAMES and s[i + 2] in "(<":
            return self.typed(self.modifiers(i))
        if c in (J["final"], "@"):
            j = self.modifiers(i)
            if s[j] in (J["class"], J["interface"], J["enum"], J["abstract"]):
                return self.typed(self.modifiers(j))
        return self.plain(i)

    @remember
    def plain(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == ";":
            return i + 1
        if c == J["return"]:
            return i + 2 if s[i + 1] == ";" else self.need(self.expr(i + 1), ";")
        if c == J["throw"] or c == J["yield"] and s[i + 1] not in "=.([" and s[i + 1] not in (J["++"], J["--"]):
            return self.need(self.expr(i + 1), ";")
        if c in (J["break"], J["continue"]):
            return self.need(i + 1 if s[i + 1] == ";" else self.name(i + 1), ";")
        if c == J["assert"]:
            i = self.expr(i + 1)
            return self.need(self.expr(i + 1) if s[i] == ":" else i, ";")
        if (j := self.local(i)) >= 0:
            return self.declarators(j)
        i = self.expr(i)
        if self.kind not in ("call", "set", "new"):
            raise Bad(i, "not a statement")
        return self.need(i, ";")

    def local(self, i: int) -> int:
        """The position of the name, if a declaration of a variable starts at i, else -1."""
        s = self.s
        j = self.modifiers(i)
        if s[j] not in self.NAMES and s[j] not in self.PRIMITIVES:
            return -1
        try:
            k = self.type(j)
        except Bad:
            return -1
        return k if s[k] in self.NAMES and (s[k + 1] in "=;,:[)" or j > i) else -1

    @remember
    def condition(self, i: int) -> int:
        return self.need(self.expr(self.need(i, "(")), ")")

    def loop(self, i: int) -> int:
        s = self.s
        i = self.need(i, "(")
        if (j := self.local(i)) >= 0:
            if s[j + 1] == ":":
                return self.need(self.expr(j + 2), ")")
            i = self.declarators(j)
        else:
            i = self.expressions(i, ";")
        i = self.need(i if s[i] == ";" else self.expr(i), ";")
        return self.expressions(i, ")")

    def expressions(self, i: int, close: str) -> int:
        return self.listed(i, close, self.expr, False)

    def resources(self, i: int) -> int:
        s = self.s
        while True:
            i = self.need(j + 1, "=") and self.expr(j + 2) if (j := self.local(i)) >= 0 else self.expr(i)
            if s[i] == ";":
                i += 1
                if s[i] != ")":
                    continue
            return self.need(i, ")")

    def switch(self, i: int) -> int:
        return self.body(self.condition(i + 1), self.case)

    def case(self, i: int) -> int:
        s = self.s
        if s[i] == J["case"]:
            i += 1
            while True:
                i = self.case_label(i)
                if s[i] != ",":
                    break
                i += 1
            if s[i] == J["when"]:
                i = self.expr(i + 1)
        elif s[i] == J["default"]:
            i += 1
        else:
            return self.statement(i)
        if s[i] == J["->"]:
            i += 1
            return self.statement(i) if s[i] in ("{", J["throw"]) else self.need(self.expr(i), ";")
        return self.need(i, ":")

    def case_label(self, i: int) -> int:
        s = self.s
        if s[i] == J["default"]:
            return i + 1
        if (j := self.pattern(i)) >= 0:
            return j
        return self.ternary(i)

    def pattern(self, i: int) -> int:
        """The end of a type pattern or record pattern, else -1."""
        s = self.s
        try:
            j = self.type(self.modifiers(i))
            if s[j] == "(" and s[j - 1] in self.NAMES + ">":

                def one(i: int) -> int:
                    if (k := self.pattern(i)) < 0:
                        raise Bad(i, "expected a pattern")
                    return k

                return self.listed(j + 1, ")", one, False)
            return j + 1 if s[j] in self.NAMES and s[j] != J["when"] else -1
        except Bad:
            return -1

    # expressions
    def expr(self, i: int) -> int:
        s = self.s
        if s[i] in self.NAMES and s[i + 1] == J["->"]:
            return self.arrow(i + 2)
        if s[i] == "(":
            j = self.closing(i)
            if j > 0 and s[j] == J["->"]:
                try:
                    k = self.params(i)
                except Bad:
                    k = self.listed(i + 1, ")", self.name, False)
                return self.arrow(self.need(k, J["->"]))
        i = self.ternary(i)
        if s[i] in self.ASSIGN:
            if self.kind not in ("name", "item"):
                raise Bad(i, "no target of an assignment")
            i = self.expr(i + 1)
            self.kind = "set"
        elif s[i] == ">" and s[i + 1] == ">" and s[i + 2] in ("=", J["=="]):
            i = self.expr(i + 3)
            self.kind = "set"
        return i

    def arrow(self, i: int) -> int:
        mode, self.mode = self.mode, 0
        i = self.block(i) if self.s[i] == "{" else self.expr(i)
        self.mode, self.kind = mode, "x"
        return i

    def ternary(self, i: int) -> int:
        s = self.s
        i = self.binary(i, 1)
        if s[i] == "?":
            i = self.need(self.expr(i + 1), ":")
            i = self.expr(i) if s[i] == "(" or s[i + 1] == J["->"] else self.ternary(i)
            self.kind = "x"
        return i

    def binary(self, i: int, least: int) -> int:
        s = self.s
        i = self.unary(i)
        while (power := J_POWER.get(s[i], 0)) >= least:
            c = s[i]
            i += 1
            if c == J["instanceof"]:
                i += s[i] == J["final"]
                i = j if (j := self.pattern(i)) >= 0 else self.type(i)
            else:
                if c == ">":  # shifts and >= come as single signs
                    if s[i] == "=" or s[i] == ">" and s[i + 1] in ("=", J["=="]):
                        if s[i] == ">":
                            return i - 1
                        i += 1
                    elif s[i] == ">":
                        power = 8
                        i += 1 + (s[i + 1] == ">")
                i = self.binary(i, power + 1)
            self.kind = "x"
        return i

    def unary(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in "+-!~":
            i = self.unary(i + 1)
            self.kind = "x"
            return i
        if c == J["++"] or c == J["--"]:
            i = self.unary(i + 1)
            self.kind = "set"
            return i
        if c == "(":
            if s[i + 1] in self.PRIMITIVES:
                j = self.type(i + 1)
                if s[j] == ")":
                    i = self.unary(j + 1)
                    self.kind = "x"
                    return i
            elif s[i + 1] in self.NAMES:
                try:
                    j = self.type(i + 1)
                    while s[j] == "&":
                        j = self.type(j + 1)
                except Bad:
                    j = 0
                if j and s[j] == ")" and (s[j + 1] in self.NAMES + self.CONST + "(!~" or s[j + 1] in (J["this"], J["new"], J["super"], J["switch"])):
                    i = self.expr(j + 1) if s[j + 1] == "(" and s[max(self.closing(j + 1), 0)] == J["->"] or s[j + 2] == J["->"] else self.unary(j + 1)
                    self.kind = "x"
                    return i
        return self.postfix(self.primary(i))

    def primary(self, i: int) -> int:
        s = self.s
        c = s[i]
        self.kind = "x"
        if c in self.NAMES:
            self.kind = "name"
            if s[i + 1] in "<[":  # a type before :: or .class
                try:
                    j = self.type(i)
                    if s[j] == J["::"] or s[j] == "." and s[j + 1] == J["class"]:
                        return j
                except Bad:
                    pass
            return i + 1
        if c in self.CONST or c == J["this"]:
            return i + 1
        if c == "(":
            i = self.need(self.expr(i + 1), ")")
            self.kind = "x"
            return i
        if c == J["new"]:
            return self.new(i + 1)
        if c == J["super"]:
            if s[i + 1] not in (".", "(", J["::"]):
                raise Bad(i + 1, "nothing after 'super'")
            return i + 1
        if c in self.PRIMITIVES or c == J["void"]:
            j = self.dims(i + 1)
            if s[j] == "." and s[j + 1] == J["class"] or s[j] == J["::"]:
                return j
        if c == J["switch"]:
            return self.switch(i)
        raise Bad(i, "expected an expression")

    def new(self, i: int) -> int:
        s = self.s
        i = self.modifiers(i) if s[i] == "@" else i
        if s[i] in self.PRIMITIVES:
            i += 1
        else:
            while True:
                i = self.name(i)
                if s[i] == "<":
                    i = i + 2 if s[i + 1] == ">" else self.listed(i + 1, ">", self.type_arg, False)
                if s[i] != ".":
                    break
                i += 1
        if s[i] == "[":
            sized = False
            while s[i] == "[":
                if s[i + 1] == "]":
                    i += 2
                else:
                    i, sized = self.need(self.expr(i + 1), "]"), True
            if s[i] == "{" and not sized:
                i = self.initial(i)
            elif not sized:
                raise Bad(i, "an array without size")
            self.kind = "x"
            return i
        i = self.expressions(self.need(i, "("), ")")
        if s[i] == "{":
            i = self.body(i, self.member)
        self.kind = "new"
        return i

    def postfix(self, i: int) -> int:
        s = self.s
        while True:
            c = s[i]
            if c == ".":
                i += 1
                if s[i] == "<":
                    i = self.listed(i + 1, ">", self.type_arg, False)
                if s[i] == J["new"]:
                    i = self.new(i + 1)
                    continue
                if s[i] in (J["class"], J["this"], J["super"]):
                    i, self.kind = i + 1, "x"
                else:
                    i, self.kind = self.name(i), "name"
            elif c == "(" and (self.kind == "name" or s[i - 1] in (J["this"], J["super"])):
                i = self.expressions(i + 1, ")")
                self.kind = "call"
            elif c == "[":
                i = self.need(self.expr(i + 1), "]")
                self.kind = "item"
            elif c == J["++"] or c == J["--"]:
                i, self.kind = i + 1, "set"
            elif c == J["::"]:
                i += 1
                i = i + 1 if s[i] == J["new"] else self.name(i)
                self.kind = "x"
            else:
                return i


G = LETTER["go"]
G_POWER = {G["||"]: 1, G["&&"]: 2, G["=="]: 3, G["!="]: 3, "<": 3, ">": 3, G["<="]: 3, G[">="]: 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "&": 5, G["<<"]: 5, G[">>"]: 5, G["&^"]: 5}
G_ENDS = 'a0")]}' + "".join(re.escape(G[x]) for x in "break continue fallthrough return ++ --".split())
G_LINE_END = re.compile(rf"(?<=[{G_ENDS.replace(')]', chr(92) + ')' + chr(92) + ']')}])(?:N|$)")


class Go(Brace):
    """mode 1: in the header of a control statement, where a brace opens the block and no composite literal."""

    lang = "go"
    ASSIGN = "=" + "".join(G[x] for x in ":= <<= >>= &^= += -= *= /= %= &= |= ^=".split())

    def clean(self, s: str) -> str:
        return G_LINE_END.sub(";", s).replace("N", "")

    def semi(self, i: int) -> int:
        s = self.s
        if s[i] == ";":
            return i + 1
        if s[i] in ")}" or s[i] == END:
            return i
        raise Bad(i, "expected the end of the statement")

    def file(self, i: int) -> None:
        s = self.s
        if s[0] == END:
            return
        i = self.semi(self.name(self.need(i, G["package"], "'package'")))
        while s[i] == G["import"]:
            try:
                i = self.semi(self.grouped(i + 1, self.import_spec))
            except Bad as bad:
                i = self.recover(i, bad)
        self.top(i, self.declaration)

    def grouped(self, i: int, one) -> int:
        s = self.s
        if s[i] != "(":
            return one(i)
        i += 1
        while s[i] != ")":
            i = one(i)
            if s[i] != ")":
                i = self.need(i, ";")
        return i + 1

    def import_spec(self, i: int) -> int:
        return self.need(i + (self.s[i] in "a."), '"', "a path")

    def declaration(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == ";":
            return i + 1
        if c == G["func"]:
            i = self.func_head(i + 1)
            if s[i] == "{":
                i = self.block(i)
            return self.semi(i)
        if c in (G["var"], G["const"], G["type"]):
            return self.semi(self.decl(i))
        raise Bad(i, "a statement outside of functions")

    def decl(self, i: int) -> int:
        c = self.s[i]
        return self.grouped(i + 1, self.type_spec if c == G["type"] else self.var_spec if c == G["var"] else self.const_spec)

    @remember
    def func_head(self, i: int) -> int:
        s = self.s
        if s[i] == "(":
            i = self.params(i)
        i = self.name(i)
        if s[i] == "[":
            i = self.type_params(i)
        return self.signature(i)

    def signature(self, i: int) -> int:
        s = self.s
        i = self.params(i)
        if s[i] == "(":
            return self.params(i)
        return self.type(i) if s[i] in "a*[" or s[i] in (G["map"], G["chan"], G["func"], G["struct"], G["interface"], G["<-"]) else i

    def type_params(self, i: int) -> int:
        def one(i: int) -> int:
            i = self.name(i)
            return self.constraint(i) if self.s[i] not in ",]" else i

        return self.listed(i + 1, "]", one)

    def constraint(self, i: int) -> int:
        while True:
            i = self.type(i + (self.s[i] == "~"))
            if self.s[i] != "|":
                return i
            i += 1

    def params(self, i: int) -> int:
        return self.listed(self.need(i, "("), ")", self.param)

    def param(self, i: int) -> int:
        s = self.s
        if s[i] == "a" and s[i + 1] not in ".,)":
            try:
                return self.type(i + 1 + (s[i + 1] == G["..."]))
            except Bad:
                if s[i + 1] != "[":
                    raise
        return self.type(i + (s[i] == G["..."]))

    def type(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == "a":
            i += 1
            if s[i] == ".":
                i = self.name(i + 1)
            if s[i] == "[" and s[i + 1] != "]":
                try:
                    return self.listed(i + 1, "]", self.type)
                except Bad:
                    pass
            return i
        if c == "*":
            return self.type(i + 1)
        if c == "(":
            return self.need(self.type(i + 1), ")")
        if c == "[":
            if s[i + 1] == "]":
                return self.type(i + 2)
            return self.type(self.need(i + 2 if s[i + 1] == G["..."] else self.expr(i + 1), "]"))
        if c == G["map"]:
            i = self.need(self.type(self.need(i + 1, "[")), "]")
            return self.type(i)
        if c == G["chan"]:
            return self.type(i + 1 + (s[i + 1] == G["<-"]))
        if c == G["<-"]:
            return self.type(self.need(i + 1, G["chan"]))
        if c == G["func"]:
            return self.signature(i + 1)
        if c == G["struct"]:
            return self.body(i + 1, self.field)
        if c == G["interface"]:
            return self.body(i + 1, self.element)
        raise Bad(i, "expected a type")

    def field(self, i: int) -> int:
        s = self.s
        if s[i] == "*" or s[i] == "a" and s[i + 1] in ';."}':
            i = self.type(i)
        else:
            i = self.name(i)
            while s[i] == ",":
                i = self.name(i + 1)
            i = self.type(i)
        return self.semi(i + (s[i] == '"'))

    def element(self, i: int) -> int:
        if self.s[i] == "a" and self.s[i + 1] == "(":
            return self.semi(self.signature(i + 1))
        return self.semi(self.constraint(i))

    def type_spec(self, i: int) -> int:
        s = self.s
        i = self.name(i)
        if s[i] == "[" and s[i + 1] == "a" and s[i + 2] not in "]":
            i = self.type_params(i)
        return self.type(i + (s[i] == "="))

    def names(self, i: int) -> int:
        i = self.name(i)
        while self.s[i] == ",":
            i = self.name(i + 1)
        return i

    def var_spec(self, i: int) -> int:
        s = self.s
        i = self.names(i)
        if s[i] != "=":
            i = self.type(i)
        return self.exprs(i + 1) if s[i] == "=" else i

    def const_spec(self, i: int) -> int:
        s = self.s
        i = self.names(i)
        if s[i] not in "=;)":
            i = self.type(i)
        return self.exprs(i + 1) if s[i] == "=" else i

    def exprs(self, i: int) -> int:
        i = self.expr(i)
        while self.s[i] == ",":
            i = self.expr(i + 1)
            self.kind = "x"
        return i

    def block(self, i: int) -> int:
        mode, self.mode = self.mode, 0
        i = self.body(i, self.statement)
        self.mode = mode
        return i

    def statement(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == ";":
            return i + 1
        if c == "{":
            return self.semi(self.block(i))
        if c == G["if"]:
            return self.semi(self.conditional(i))
        if c == G["for"]:
            return self.semi(self.block(self.loop(i + 1)))
        if c == G["switch"]:
            return self.semi(self.body(self.switch(i + 1), self.case))
        if c == G["select"]:
            return self.semi(self.body(i + 1, self.case))
        if c in (G["var"], G["const"], G["type"]):
            return self.semi(self.decl(i))
        if c == "a" and s[i + 1] == ":":
            return self.statement(i + 2) if s[i + 2] != "}" else i + 2
        return self.plain(i)

    @remember
    def plain(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in (G["return"],):
            return self.semi(i + 1 if s[i + 1] in ";}" else self.exprs(i + 1))
        if c in (G["break"], G["continue"], G["goto"]):
            return self.semi(i + 1 + (s[i + 1] == "a"))
        if c == G["fallthrough"]:
            return self.semi(i + 1)
        if c in (G["go"], G["defer"]):
            i = self.expr(i + 1)
            if self.kind != "call":
                raise Bad(i, "no call")
            return self.semi(i)
        i = self.simple(i)
        if self.kind not in ("call", "set"):
            raise Bad(i, "not a statement")
        return self.semi(i)

    def simple(self, i: int) -> int:
        """A simple statement without its end; ``range`` is allowed where mode says header."""
        s = self.s
        i = self.exprs(i)
        if s[i] in self.ASSIGN:
            i += 1
            if s[i] == G["range"]:
                i += 1
            i = self.exprs(i)
            self.kind = "set"
        elif s[i] in (G["++"], G["--"]):
            i, self.kind = i + 1, "set"
        elif s[i] == G["<-"]:
            i = self.expr(i + 1)
            self.kind = "set"
        return i

    def header(self, i: int, f):
        mode, self.mode = self.mode, 1
        i = f(i)
        self.mode = mode
        return i

    def conditional(self, i: int) -> int:
        s = self.s
        i = self.block(self.if_head(i + 1))
        if s[i] == G["else"]:
            i += 1
            return self.conditional(i) if s[i] == G["if"] else self.block(i)
        return i

    @remember
    def if_head(self, i: int) -> int:
        def f(i: int) -> int:
            if self.s[i] != ";":
                i = self.simple(i)
            return self.expr(i + 1) if self.s[i] == ";" else i

        i = self.header(i, f)
        if self.kind == "set":
            raise Bad(i, "no condition")
        return i

    def loop(self, i: int) -> int:
        def f(i: int) -> int:
            s = self.s
            if s[i] == "{":
                return i
            if s[i] == G["range"]:
                return self.expr(i + 1)
            if s[i] != ";":
                i = self.simple(i)
                if s[i] == "{":
                    return i
            i = self.need(i, ";")
            if s[i] not in ";":
                i = self.expr(i)
            i = self.need(i, ";")
            return i if s[i] == "{" else self.simple(i)

        return self.header(i, f)

    def switch(self, i: int) -> int:
        def f(i: int) -> int:
            s = self.s
            if s[i] == "{":
                return i
            if s[i] != ";":
                i = self.simple(i)
            if s[i] == ";":
                i += 1
                if s[i] != "{":
                    i = self.simple(i)
            return i

        return self.header(i, f)

    def case(self, i: int) -> int:
        s = self.s
        if s[i] == G["default"]:
            return self.need(i + 1, ":")
        if s[i] == G["case"]:
            i += 1
            while True:
                try:
                    j = self.simple(i)
                except Bad:
                    j = self.type(i)
                i = j
                if s[i] != ",":
                    return self.need(i, ":")
                i += 1
        return self.statement(i)

    def expr(self, i: int) -> int:
        return self.binary(i, 1)

    def binary(self, i: int, least: int) -> int:
        s = self.s
        i = self.unary(i)
        while (power := G_POWER.get(s[i], 0)) >= least:
            i = self.binary(i + 1, power + 1)
            self.kind = "x"
        return i

    def unary(self, i: int) -> int:
        s = self.s
        if s[i] in "+-!^*&" or s[i] == G["<-"]:
            c = s[i]
            i = self.unary(i + 1)
            self.kind = "call" if c == G["<-"] else "x"
            return i
        return self.primary(i)

    def primary(self, i: int) -> int:
        s = self.s
        c = s[i]
        literal = False
        self.kind = "x"
        if c == "a":
            i, literal = i + 1, True
        elif c in '0"':
            i += 1
        elif c == "(":
            mode, self.mode = self.mode, 0
            try:
                j = self.need(self.expr(i + 1), ")")
            except Bad:
                j = self.need(self.type(i + 1), ")")
            i, self.mode = j, mode
        elif c == G["func"]:
            i = self.signature(i + 1)
            if s[i] == "{":
                i = self.block(i)
        elif c in "[" or c in (G["map"], G["struct"], G["chan"], G["interface"]):
            i = self.type(i)
            if s[i] not in "{(":
                raise Bad(i, "a type where a value is expected")
            if s[i] == "{":
                i = self.composite(i)
        else:
            raise Bad(i, "expected an expression")
        while True:
            c = s[i]
            if c == ".":
                if s[i + 1] == "(":
                    i, literal = self.need(i + 3 if s[i + 2] == G["type"] else self.type(i + 2), ")"), False
                else:
                    i = self.name(i + 1)
                self.kind = "x"
            elif c == "(":
                mode, self.mode = self.mode, 0
                i = self.listed(i + 1, ")", self.arg)
                self.mode, self.kind, literal = mode, "call", False
            elif c == "[":
                mode, self.mode = self.mode, 0
                i = self.index(i + 1)
                self.mode, self.kind = mode, "x"
            elif c == "{" and literal and not self.mode:
                i = self.composite(i)
                literal = False
                self.kind = "x"
            else:
                return i

    def arg(self, i: int) -> int:
        try:
            i = self.expr(i)
        except Bad as bad:
            try:
                i = self.type(i)
            except Bad:
                raise bad from None
        return i + (self.s[i] == G["..."])

    def index(self, i: int) -> int:
        s = self.s
        if s[i] == "]":
            raise Bad(i, "empty index")
        if s[i] != ":":
            i = self.arg(i)
        while s[i] in ",":
            i = self.arg(i + 1)
        for _ in range(2):
            if s[i] == ":":
                i += 1
                if s[i] not in ":]":
                    i = self.expr(i)
        return self.need(i, "]")

    def composite(self, i: int) -> int:
        def value(i: int) -> int:
            return self.composite(i) if self.s[i] == "{" else self.expr(i)

        def pair(i: int) -> int:
            i = value(i)
            return value(i + 1) if self.s[i] == ":" else i

        mode, self.mode = self.mode, 0
        i = self.listed(i + 1, "}", pair)
        self.mode = mode
        return i

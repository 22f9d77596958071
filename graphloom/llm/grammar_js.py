"""The grammars of JavaScript (ES modules) and TypeScript."""

from __future__ import annotations

import re

from graphloom.llm.grammar_brace import END, Brace, remember
from graphloom.llm.grammar_py import Bad
from graphloom.llm.lex import LETTER

K = LETTER["javascript"]
POWER = {K["??"]: 1, K["||"]: 2, K["&&"]: 3, "|": 4, "^": 5, "&": 6, K["=="]: 7, K["!="]: 7, K["==="]: 7, K["!=="]: 7, "<": 8, ">": 8, K["<="]: 8, K["in"]: 8, K["instanceof"]: 8, K["<<"]: 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, K["**"]: 13}
SOFT = "let static async await of get set from as type interface namespace module declare abstract readonly public private protected implements is keyof infer satisfies asserts override unique accessor yield".split()
NAMES = "a" + "".join(K[w] for w in SOFT)
WORDS = NAMES + "".join(K[w] for w in "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
CONST = '0"r`' + "".join(K[w] for w in ("true", "false", "null", "this"))
ASSIGN = "=" + "".join(K[x] for x in "**= <<= >>= >>>= &&= ||= ??= += -= *= /= %= &= |= ^=".split() if x in K)
# a line end matters between what may end a statement and what can't go on with one
_ENDS = "[" + re.escape(NAMES + CONST + ")]}" + "".join(K[w] for w in ("super", "return", "break", "continue", "debugger", "++", "--"))) + "]"
_GOES_ON = {K[w] for w in ("of", "from", "as", "in", "instanceof", "else", "catch", "finally", "extends", "implements", "satisfies", "is")}
_STARTS = "[" + re.escape("".join(c for c in WORDS + '0"r@#!~{*[' + K["++"] + K["--"] + K["..."] if c not in _GOES_ON) + K["while"]) + "]"
_PLACES = re.compile(rf"(?<={_ENDS})N+(?={_STARTS})")
MODIFIERS = "".join(K[w] for w in "static async get set readonly public private protected abstract declare override accessor".split())
DECLARES = (K["var"], K["let"], K["const"])


class JavaScript(Brace):
    """mode 1: no ``in`` operator (head of a for); mode 2: an await or yield may stand (not used). ``inside`` counts functions."""

    lang = "javascript"
    NAMES = NAMES
    ts = False

    def clean(self, s: str) -> str:
        # [ at a line's start goes on in an expression, but not in a list of members; it is kept there only after }
        s = re.sub(rf"(?<=[^}}])N+(?=[\[*])|N+(?={{)", "", s)
        return re.sub(r"N", "", _PLACES.sub("\1", s)).replace("\1", "N")

    def file(self, i: int) -> None:
        self.inside = 0
        self.top(i, self.statement)

    def semi(self, i: int) -> int:
        c = self.s[i]
        if c in ";N":
            return i + 1
        if c == "}" or c == END:
            return i
        raise Bad(i, "expected the end of the statement")

    def skip(self, i: int) -> int:
        return i + (self.s[i] == "N")

    def block(self, i: int) -> int:
        return self.body(i, self.statement)

    def function_body(self, i: int) -> int:
        self.inside += 1
        mode, self.mode = self.mode, 0
        try:
            return self.body(i, self.statement)
        finally:
            self.inside -= 1
            self.mode = mode

    # statements
    def statement(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == "{":
            return self.block(i)
        if c == K["if"]:
            i = self.statement(self.skip(self.condition(i + 1)))
            j = i + (s[i] == "N")
            return self.statement(self.skip(j + 1)) if s[j] == K["else"] else i
        if c == K["for"]:
            return self.statement(self.skip(self.loop(i + 1)))
        if c == K["while"]:
            return self.statement(self.skip(self.condition(i + 1)))
        if c == K["do"]:
            i = self.skip(self.statement(self.skip(i + 1)))
            i = self.condition(self.need(i, K["while"], "'while'"))
            return i + (s[i] in ";N")
        if c == K["try"]:
            i = self.block(i + 1)
            if s[i] == K["catch"]:
                i += 1
                if s[i] == "(":
                    i = self.need(self.binding(i + 1), ")")
                i = self.block(i)
            elif s[i] != K["finally"]:
                raise Bad(i, "'try' without 'catch'")
            return self.block(i + 1) if s[i] == K["finally"] else i
        if c == K["switch"]:
            return self.body(self.condition(i + 1), self.case)
        if c == K["function"] or c == K["async"] and s[i + 1] == K["function"]:
            return self.function(i, True)
        if c == K["class"] or c == "@":
            return self.class_(i, True)
        if c == K["return"]:
            if not self.inside:
                raise Bad(i, "'return' outside of a function")
        elif c == K["import"] and s[i + 1] not in "(.":
            if self.depth:
                raise Bad(i, "'import' inside a block")
            return self.import_(i + 1)
        elif c == K["export"]:
            if self.depth and not self.ts:
                raise Bad(i, "'export' inside a block")
            return self.export(i + 1)
        elif c in DECLARES and (c != K["let"] or s[i + 1] in NAMES + "[{"):
            if self.ts and c == K["const"] and s[i + 1] == K["enum"]:
                return self.enum(i + 1)
            return self.declaration(i)
        elif c in NAMES and s[i + 1] == ":":
            return self.statement(self.skip(i + 2))
        elif self.ts and (j := self.ts_statement(i)) > 0:
            return j
        return self.plain(i)

    @remember
    def declaration(self, i: int) -> int:
        return self.semi(self.declarators(i, self.s[i] == K["const"] and not self.ts))

    @remember
    def plain(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == ";":
            return i + 1
        if c == K["return"]:
            return self.semi(i + 1 if s[i + 1] in ";N}" + END else self.sequence(i + 1))
        if c == K["throw"]:
            return self.semi(self.sequence(i + 1))
        if c in (K["break"], K["continue"]):
            return self.semi(i + 1 + (s[i + 1] in NAMES))
        if c == K["debugger"]:
            return self.semi(i + 1)
        return self.semi(self.sequence(i))

    @remember
    def condition(self, i: int) -> int:
        mode, self.mode = self.mode, 0
        i = self.need(self.sequence(self.need(i, "(")), ")")
        self.mode = mode
        return i

    def declarators(self, i: int, need_value: bool = False) -> int:
        s = self.s
        i += 1
        while True:
            pattern = s[i] in "[{"
            i = self.binding(i, False)
            if self.ts and s[i] == "!":
                i += 1
            if self.ts and s[i] == ":":
                i = self.type(i + 1)
            if s[i] == "=":
                i = self.assign(i + 1)
            elif (need_value or pattern) and not self.mode & 1:
                raise Bad(i, "a declaration without value")
            if s[i] != ",":
                return i
            i += 1

    def loop(self, i: int) -> int:
        s = self.s
        i = self.need(i + (s[i] == K["await"]), "(")
        self.mode |= 1
        try:
            if s[i] in DECLARES and s[i + 1] in NAMES + "[{":
                i = self.declarators(i)
            elif s[i] != ";":
                i = self.sequence(i)
        finally:
            self.mode &= ~1
        if s[i] == K["in"]:
            return self.need(self.sequence(i + 1), ")")
        if s[i] == K["of"]:
            return self.need(self.assign(i + 1), ")")
        i = self.need(i, ";")
        i = self.need(i if s[i] == ";" else self.sequence(i), ";")
        return self.need(i if s[i] == ")" else self.sequence(i), ")")

    def case(self, i: int) -> int:
        s = self.s
        if s[i] == K["case"]:
            return self.need(self.sequence(i + 1), ":")
        if s[i] == K["default"]:
            return self.need(i + 1, ":")
        return self.statement(i)

    def import_(self, i: int) -> int:
        s = self.s
        if s[i] == '"':
            return self.semi(self.attributes(i + 1))
        if self.ts and s[i] == K["type"] and s[i + 1] not in (",", K["from"], "="):
            i += 1
        if s[i] in NAMES:
            i += 1
            if self.ts and s[i] == "=":
                return self.semi(self.sequence(i + 1))
            if s[i] == ",":
                i += 1
                if s[i] not in "*{":
                    raise Bad(i, "expected names")
        if s[i] == "*":
            i = self.name(self.need(i + 1, K["as"], "'as'"))
        elif s[i] == "{":
            i = self.specifiers(i)
        i = self.need(i, K["from"], "'from'")
        return self.semi(self.attributes(self.need(i, '"', "a module")))

    def attributes(self, i: int) -> int:
        return self.object(i + 1) if self.s[i] == K["with"] else i

    def specifiers(self, i: int) -> int:
        s = self.s

        def one(i: int) -> int:
            if self.ts and s[i] == K["type"] and s[i + 1] not in ",}" and s[i + 1] != K["as"]:
                i += 1
            if s[i] not in WORDS and s[i] != '"':
                raise Bad(i, "expected a name")
            i += 1
            if s[i] == K["as"]:
                if s[i + 1] not in WORDS and s[i + 1] != '"':
                    raise Bad(i, "expected a name")
                i += 2
            return i

        return self.listed(i + 1, "}", one)

    def export(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == K["default"]:
            i = self.skip(i + 1)
            if s[i] == K["function"] or s[i] == K["async"] and s[i + 1] == K["function"]:
                return self.function(i, False)
            if s[i] in ("@", K["class"]) or self.ts and s[i] == K["abstract"] and s[i + 1] == K["class"]:
                return self.class_(i, False)
            if self.ts and s[i] == K["interface"]:
                return self.ts_statement(i)
            return self.semi(self.assign(i))
        if self.ts and c == "=":
            return self.semi(self.sequence(i + 1))
        if self.ts and c == K["type"] and s[i + 1] in "{*":
            i, c = i + 1, s[i + 1]
        if c == "*":
            i += 1
            if s[i] == K["as"]:
                i += 2
            return self.semi(self.attributes(self.need(self.need(i, K["from"], "'from'"), '"', "a module")))
        if c == "{":
            i = self.specifiers(i)
            if s[i] == K["from"]:
                i = self.attributes(self.need(i + 1, '"', "a module"))
            return self.semi(i)
        if c in DECLARES or c in (K["function"], K["class"], K["async"], "@") or self.ts:
            j = self.statement(i)
            if self.ts and c not in WORDS + "@":
                raise Bad(i, "nothing to export")
            return j
        raise Bad(i, "nothing to export")

    # functions and classes
    def function(self, i: int, named: bool) -> int:
        i = self.function_head(i)
        if named and self.kind == "nameless":
            raise Bad(i, "a function without name")
        if self.ts and self.s[i] != "{":
            return self.semi(i)
        return self.function_body(i)

    @remember
    def function_head(self, i: int) -> int:
        s = self.s
        i += s[i] == K["async"]
        i = self.need(i, K["function"], "'function'")
        i += s[i] == "*"
        kind = "nameless"
        if s[i] in NAMES:
            i, kind = i + 1, "named"
        i = self.signature(i)
        self.kind = kind
        return i

    def signature(self, i: int) -> int:
        s = self.s
        mode, self.mode = self.mode, 0
        if self.ts and s[i] == "<":
            i = self.type_params(i)
        i = self.listed(self.need(i, "("), ")", self.param)
        if self.ts and s[i] == ":":
            i = self.return_type(i + 1)
        self.mode = mode
        return i

    def param(self, i: int) -> int:
        s = self.s
        while s[i] == "@":
            i = self.postfix(self.primary(i + 1))
        if self.ts:
            while s[i] in MODIFIERS and s[i + 1] in NAMES + "{[":
                i += 1
            if s[i] == K["this"]:
                return self.type(i + 2) if s[i + 1] == ":" else i + 1
        if s[i] == K["..."]:
            i += 1
        i = self.binding(i, False)
        if self.ts:
            i += s[i] == "?"
            if s[i] == ":":
                i = self.type(i + 1)
        return self.assign(i + 1) if s[i] == "=" else i

    def binding(self, i: int, typed: bool = True) -> int:
        s = self.s
        if s[i] == "{":

            def one(i: int) -> int:
                if s[i] == K["..."]:
                    return self.binding(i + 1)
                j = self.key(i)
                if s[j] == ":":
                    j = self.binding(j + 1, False)
                elif s[i] not in NAMES:
                    raise Bad(i, "expected a name")
                return self.assign(j + 1) if s[j] == "=" else j

            i = self.listed(i + 1, "}", one)
        elif s[i] == "[":

            def item(i: int) -> int:
                if s[i] in ",]":
                    return i
                i = self.binding(i + (s[i] == K["..."]), False)
                return self.assign(i + 1) if s[i] == "=" else i

            i = self.listed(i + 1, "]", item)
        else:
            i = self.name(i)
        if typed and self.ts and s[i] == ":":
            i = self.type(i + 1)
        return i

    def key(self, i: int) -> int:
        s = self.s
        if s[i] == "[":
            return self.need(self.assign(i + 1), "]")
        if s[i] in WORDS or s[i] in '"0#':
            return i + 1
        raise Bad(i, "expected a name")

    def class_(self, i: int, named: bool) -> int:
        s = self.s
        while s[i] == "@":
            i = self.skip(self.postfix(self.primary(i + 1)))
        if s[i] == K["export"]:
            i += 1 + (s[i + 1] == K["default"])
        i += self.ts and s[i] in (K["abstract"], K["declare"])
        i = self.need(i, K["class"], "'class'")
        if s[i] in NAMES and not (s[i] == K["implements"] and s[i + 1] in NAMES):
            i += 1
        elif named:
            raise Bad(i, "a class without name")
        if self.ts and s[i] == "<":
            i = self.type_params(i)
        if s[i] == K["extends"]:
            i = self.postfix(self.primary(i + 1))
            if self.ts and s[i] == "<":
                i = self.type_args(i)
        if self.ts and s[i] == K["implements"]:
            i = self.type(i + 1)
            while s[i] == ",":
                i = self.type(i + 1)
        return self.body(i, self.member)

    def member(self, i: int) -> int:
        s = self.s
        if s[i] == ";":
            return i + 1
        if s[i] == K["static"] and s[i + 1] == "{":
            return self.function_body(i + 1)
        i = self.member_head(i)
        kind = self.kind
        if kind == "method":
            return self.function_body(i) if s[i] == "{" or not self.ts else self.semi(i)
        if s[i] == "=":
            i = self.assign(i + 1)
        return self.semi(i)

    @remember
    def member_head(self, i: int) -> int:
        s = self.s
        while s[i] == "@":
            i = self.skip(self.postfix(self.primary(i + 1)))
        while s[i] in MODIFIERS and s[i + 1] not in "(=;:?!<N}" and (self.ts or s[i] in (K["static"], K["async"], K["get"], K["set"], K["accessor"])):
            i += 1
        i += s[i] == "*"
        if self.ts and s[i] == "[" and s[i + 1] in NAMES and s[i + 2] == ":":
            i = self.need(self.type(i + 3), "]")
        else:
            i = self.key(i)
        if self.ts:
            i += s[i] in "?!"
        if s[i] in "(<":
            i = self.signature(i)
            self.kind = "method"
            return i
        if self.ts and s[i] == ":":
            i = self.type(i + 1)
        self.kind = "field"
        return i

    # expressions
    def sequence(self, i: int) -> int:
        i = self.assign(i)
        while self.s[i] == ",":
            i = self.assign(i + 1)
        return i

    def arrow_end(self, i: int) -> int:
        """The position of the arrow if parameters of an arrow function start at i, else -1."""
        s = self.s
        j = i + (s[i] == K["async"] and (s[i + 1] in "(" + NAMES or self.ts and s[i + 1] == "<"))
        if s[j] in NAMES:
            return j + 1 if s[j + 1] == K["=>"] else -1
        if s[j] == "(":
            k = self.closing(j)
            if k < 0 or s[k] != K["=>"] and not (self.ts and s[k] == ":"):
                return -1
        elif not (self.ts and s[j] == "<"):
            return -1
        try:
            k = self.signature(j)
        except Bad:
            if s[max(self.closing(j), 0)] == K["=>"] and s[j] == "(":
                raise
            return -1
        return k if s[k] == K["=>"] else -1

    def assign(self, i: int) -> int:
        s = self.s
        c = s[i]
        if (c == "(" or c in NAMES or c == "<") and (j := self.arrow_end(i)) > 0:
            i = j + 1
            i = self.function_body(i) if s[i] == "{" else self.assign(i)
            self.kind = "x"
            return i
        if c == K["yield"] and self.inside and s[i + 1] not in "=.":
            i += 1
            if s[i] in ");,]}:N" + END:
                return i
            return self.assign(i + (s[i] == "*"))
        i = self.ternary(i)
        if s[i] in ASSIGN or s[i] == ">" and s[i + 1] == ">":
            j = i
            while s[j] == ">":
                j += 1
            if s[j] in ASSIGN or j == i:
                if self.kind not in ("name", "pattern"):
                    raise Bad(i, "no target of an assignment")
                i = self.assign(j + 1)
                self.kind = "x"
        return i

    def ternary(self, i: int) -> int:
        s = self.s
        i = self.binary(i, 1)
        if s[i] == "?":
            mode, self.mode = self.mode, 0
            i = self.need(self.assign(i + 1), ":")
            self.mode = mode
            i = self.assign(i)
            self.kind = "x"
        return i

    def binary(self, i: int, least: int) -> int:
        s = self.s
        if s[i] == "#" and s[i + 1] == K["in"]:
            i += 1
        else:
            i = self.unary(i)
        while True:
            c = s[i]
            if self.ts and c in (K["as"], K["satisfies"]) and least <= 8:
                i = i + 2 if s[i + 1] == K["const"] else self.type(i + 1)
                continue
            power = POWER.get(c, 0)
            if power < least or not power or c == K["in"] and self.mode & 1:
                return i
            i += 1
            if c == ">":
                if s[i] == ">":
                    if s[i + 1] in "=" or s[i + 1] == ">" and s[i + 2] == "=" or s[i + 1] in (K["=="], K["=>"]):
                        return i - 1
                    i += 1 + (s[i + 1] == ">")
                elif s[i] == "=":
                    i += 1
                elif s[i] in (K["=="], K["==="]):
                    raise Bad(i, "unknown operator")
            i = self.binary(i, power + (c != K["**"]))
            self.kind = "x"

    def unary(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c in "+-!~" or c in (K["typeof"], K["void"], K["delete"]) or c == K["await"] and s[i + 1] not in "=.;,):N}]" + K["=>"]:
            i = self.unary(i + 1)
            self.kind = "x"
            return i
        if c in (K["++"], K["--"]):
            i = self.unary(i + 1)
            self.kind = "x"
            return i
        if self.ts and c == "<":
            i = self.unary(self.need(self.type(i + 1), ">"))
            self.kind = "x"
            return i
        i = self.postfix(self.primary(i))
        if s[i] in (K["++"], K["--"]):
            if self.kind != "name":
                raise Bad(i, "no target")
            i, self.kind = i + 1, "x"
        return i

    def primary(self, i: int) -> int:
        s = self.s
        c = s[i]
        self.kind = "x"
        if c in NAMES and not (c == K["async"] and s[i + 1] == K["function"]):
            self.kind = "name"
            return i + 1
        if c in CONST:
            return i + 1
        if c == "(":
            mode, self.mode = self.mode, 0
            i = self.need(self.sequence(i + 1), ")")
            self.mode = mode
            return i
        if c == "[":
            mode, self.mode = self.mode, 0
            i = self.listed(i + 1, "]", lambda i: i if s[i] in ",]" else self.assign(i + (s[i] == K["..."])))
            self.mode, self.kind = mode, "pattern"
            return i
        if c == "{":
            mode, self.mode = self.mode, 0
            i = self.object(i)
            self.mode, self.kind = mode, "pattern"
            return i
        if c == K["function"] or c == K["async"]:
            i = self.function(i, False)
            self.kind = "x"
            return i
        if c in (K["class"], "@"):
            i = self.class_(i, False)
            self.kind = "x"
            return i
        if c == K["new"]:
            if s[i + 1] == ".":
                return self.name_any(i + 2)
            i = self.members(self.primary(i + 1))
            if self.ts and s[i] == "<":
                i = self.type_args(i)
            if s[i] == "(":
                i = self.args(i)
            self.kind = "x"
            return i
        if c == K["super"]:
            if s[i + 1] not in ".([":
                raise Bad(i + 1, "nothing after 'super'")
            return i + 1
        if c == K["import"]:
            return self.args(i + 1) if s[i + 1] == "(" else self.name_any(self.need(i + 1, "."))
        raise Bad(i, "expected an expression")

    def name_any(self, i: int) -> int:
        if self.s[i] in WORDS or self.s[i] == "#":
            return i + 1
        raise Bad(i, "expected a name")

    def args(self, i: int) -> int:
        s = self.s
        mode, self.mode = self.mode, 0
        i = self.listed(self.need(i, "("), ")", lambda i: self.assign(i + (s[i] == K["..."])))
        self.mode = mode
        return i

    def members(self, i: int) -> int:
        s = self.s
        while True:
            if s[i] == ".":
                i, self.kind = self.name_any(i + 1), "name"
            elif s[i] == "[":
                i, self.kind = self.index(i), "name"
            else:
                return i

    def index(self, i: int) -> int:
        mode, self.mode = self.mode, 0
        i = self.need(self.sequence(i + 1), "]")
        self.mode = mode
        return i

    def postfix(self, i: int) -> int:
        s = self.s
        while True:
            c = s[i]
            if c == ".":
                i, self.kind = self.name_any(i + 1), "name"
            elif c == "(":
                i, self.kind = self.args(i), "call"
            elif c == "[":
                i, self.kind = self.index(i), "name"
            elif c == K["?."]:
                i += 1
                i = self.args(i) if s[i] == "(" else self.index(i) if s[i] == "[" else self.name_any(i)
                self.kind = "x"
            elif c == "`":
                i, self.kind = i + 1, "x"
            elif self.ts and c == "!" and s[i + 1] != "=":
                i += 1
            elif self.ts and c == "<":
                try:
                    j = self.type_args(i)
                except Bad:
                    return i
                if s[j] not in "(`" and s[j] not in ");,]}:.N":
                    return i
                i = j
            else:
                return i

    def object(self, i: int) -> int:
        return self.listed(self.need(i, "{"), "}", self.property)

    def property(self, i: int) -> int:
        s = self.s
        if s[i] == K["..."]:
            return self.assign(i + 1)
        j = i
        while s[j] in (K["async"], K["get"], K["set"]) and s[j + 1] not in ",:(=}N<":
            j += 1
        j += s[j] == "*"
        k = self.key(j)
        if s[k] in "(<" and (s[k] == "(" or self.ts):
            return self.function_body(self.signature(k))
        if j > i:
            raise Bad(k, "expected a method")
        if s[k] == ":":
            return self.assign(k + 1)
        if s[i] not in NAMES:
            raise Bad(k, "expected ':'")
        return self.assign(k + 1) if s[k] == "=" else k

    def ts_statement(self, i: int) -> int:
        return -1

    def type(self, i: int) -> int:
        raise Bad(i, "a type")

    type_args = type_params = return_type = enum = type


class TypeScript(JavaScript):
    lang = "typescript"
    ts = True

    def ts_statement(self, i: int) -> int:
        s = self.s
        c, n = s[i], s[i + 1]
        if c == K["interface"] and n in NAMES:
            return self.body(self.interface_head(i + 2), self.type_member)
        if c == K["type"] and n in NAMES:
            i += 2
            if s[i] == "<":
                i = self.type_params(i)
            return self.semi(self.type(self.need(i, "=")))
        if c == K["enum"]:
            return self.enum(i)
        if c == K["declare"] and n in WORDS and n not in (K["in"], K["instanceof"]):
            return self.statement(i + 1)
        if c == K["abstract"] and n == K["class"]:
            return self.class_(i, True)
        if c in (K["namespace"], K["module"]) and (n in NAMES or n == '"'):
            i += 2
            while s[i] == ".":
                i = self.name(i + 1)
            return self.body(i, self.statement) if s[i] == "{" else self.semi(i)
        return -1

    @remember
    def interface_head(self, i: int) -> int:
        s = self.s
        if s[i] == "<":
            i = self.type_params(i)
        if s[i] == K["extends"]:
            i = self.type(i + 1)
            while s[i] == ",":
                i = self.type(i + 1)
        return i

    def enum(self, i: int) -> int:
        def one(i: int) -> int:
            i = self.key(i)
            return self.assign(i + 1) if self.s[i] == "=" else i

        return self.listed(self.need(self.name(i + 1), "{"), "}", one)

    def type_params(self, i: int) -> int:
        s = self.s

        def one(i: int) -> int:
            while s[i] in (K["const"], K["in"]) or s[i] == "a" and s[i + 1] in NAMES:
                i += 1
            i = self.name(i)
            if s[i] == K["extends"]:
                i = self.type(i + 1)
            return self.type(i + 1) if s[i] == "=" else i

        return self.listed(i + 1, ">", one)

    def type_args(self, i: int) -> int:
        return self.listed(i + 1, ">", self.type, False)

    def return_type(self, i: int) -> int:
        s = self.s
        if s[i] == K["asserts"] and s[i + 1] in NAMES + K["this"]:
            i += 2
            return self.type(i + 1) if s[i] == K["is"] else i
        if s[i] in NAMES + K["this"] and s[i + 1] == K["is"]:
            return self.type(i + 2)
        return self.type(i)

    @remember
    def type(self, i: int) -> int:
        s = self.s
        i = self.union(i)
        if s[i] == K["extends"] and not self.mode & 4:
            self.mode |= 4
            try:
                i = self.need(self.type(i + 1), "?")
            finally:
                self.mode &= ~4
            i = self.need(self.type(i), ":")
            i = self.type(i)
        return i

    def union(self, i: int) -> int:
        s = self.s
        i += s[i] in "|&"
        i = self.operand(i)
        while s[i] in "|&":
            i = self.operand(i + 1)
        return i

    def operand(self, i: int) -> int:
        s = self.s
        while s[i] in (K["keyof"], K["readonly"], K["unique"]) and s[i + 1] not in ",;)>=|&]}N":
            i += 1
        c = s[i]
        if c == K["infer"] and s[i + 1] in NAMES:
            return i + 2
        if c == K["typeof"]:
            i = i + 1 if s[i + 1] != K["import"] else i + 1
            i = self.args(i + 1) if s[i] == K["import"] else self.name_any(i)
            while s[i] == ".":
                i = self.name_any(i + 1)
            if s[i] == "<":
                i = self.type_args(i)
        elif c == "(":
            j = self.closing(i)
            if j > 0 and s[j] == K["=>"]:
                return self.return_type(self.listed(i + 1, ")", self.param) + 1)
            i = self.need(self.type(i + 1), ")")
        elif c == "<" or c == K["new"] or c == K["abstract"] and s[i + 1] == K["new"]:
            i += c == K["abstract"]
            i += s[i] == K["new"]
            if s[i] == "<":
                i = self.type_params(i)
            i = self.listed(self.need(i, "("), ")", self.param)
            return self.return_type(self.need(i, K["=>"], "'=>'"))
        elif c == "{":
            i = self.type_body(i)
        elif c == "[":
            i = self.listed(i + 1, "]", self.tuple_item)
        elif c in NAMES or c in (K["this"], K["void"], K["null"]):
            i += 1
            while s[i] == "." and s[i + 1] in WORDS:
                i += 2
            if s[i] == "<":
                i = self.type_args(i)
        elif c in '"0`' or c in (K["true"], K["false"]):
            i += 1
        elif c == "-" and s[i + 1] == "0":
            i += 2
        elif c == K["import"]:
            i = self.args(i + 1)
            while s[i] == ".":
                i = self.name_any(i + 1)
            if s[i] == "<":
                i = self.type_args(i)
        else:
            raise Bad(i, "expected a type")
        while s[i] == "[":
            i = i + 2 if s[i + 1] == "]" else self.need(self.type(i + 1), "]")
        return i

    def tuple_item(self, i: int) -> int:
        s = self.s
        i += s[i] == K["..."]
        if s[i] in WORDS and (s[i + 1] == ":" or s[i + 1] == "?" and s[i + 2] == ":"):
            i += 2 + (s[i + 1] == "?")
        i = self.type(i)
        return i + (s[i] == "?")

    def type_body(self, i: int) -> int:
        s = self.s
        j = i + 1 + (s[i + 1] in "+-")
        j += s[j] == K["readonly"]
        if s[j] == "[" and s[j + 1] in NAMES and s[j + 2] == K["in"]:  # a mapped type
            j = self.type(j + 3)
            if s[j] == K["as"]:
                j = self.type(j + 1)
            j = self.need(j, "]")
            j += s[j] in "+-"
            j += s[j] == "?"
            if s[j] == ":":
                j = self.type(j + 1)
            return self.need(j + (s[j] in ";N"), "}")
        mode, self.mode = self.mode, 0
        i = self.body(i, self.type_member)
        self.mode = mode
        return i

    @remember
    def type_member(self, i: int) -> int:
        s = self.s
        if s[i] in ";,":
            return i + 1
        if s[i] in "(<":
            i = self.signature(i)
        elif s[i] == K["new"] and s[i + 1] in "(<":
            i = self.signature(i + 1)
        else:
            while s[i] in (K["readonly"], K["get"], K["set"]) and s[i + 1] not in "(?:;,N}<":
                i += 1
            if s[i] == "[" and s[i + 1] in NAMES and s[i + 2] == ":":
                i = self.need(self.type(i + 3), "]")
            else:
                i = self.key(i)
            i += s[i] == "?"
            if s[i] in "(<":
                i = self.signature(i)
            elif s[i] == ":":
                i = self.type(i + 1)
        return i + 1 if s[i] in ";,N" else i if s[i] == "}" else self.semi(i)

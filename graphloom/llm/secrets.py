"""Credentials embedded in source code (problem 2).

Literals near assignment contexts are segmented into dictionary words by Viterbi. What the words don't explain, the
residual, decides: long ones under a credential's name are secrets; known formats of digests, fillers, references to
vaults, environments and variables, and names made of words are not.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from bisect import bisect_right
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.arrow import map_rows, strings

#: Words that the dictionary keeps at most; they are counted over all documents and files.
DICTIONARY = 30_000
#: Letters and digits of a value that dictionary words must leave unexplained.
RESIDUAL = {"password": 2, "token": 8, "api_key": 8, "private_key": 60}
LEAST_LENGTH = {"password": 5, "token": 12, "api_key": 12, "private_key": 60}
CATEGORIES = ("private_key", "password", "token", "api_key")

#: Words of names, by what they name; after one of NOT_ITSELF a name names something about a credential.
PASSWORD_WORDS = set("password passwd pwd passphrase pass pw passwort kennwort motdepasse contrasena senha passcode userpass pword".split())
TOKEN_WORDS = set("token bearer jwt authtoken accesstoken sessiontoken refreshtoken bottoken pat oauth authorization tok".split())
KEY_PAIRS = set("api access client service signing secret maps app application account storage subscription master encryption encrypt decrypt deploy auth license licence admin shared webhook hmac x server integration payment stripe merchant write read ingest data project instrumentation functions consumer".split())
KEY_WORDS = set("apikey accesskey secretkey clientkey servicekey signingkey secret apisecret clientsecret appsecret appkey mapskey".split())
NOT_ITSELF = set("field name kind type id ids url uri path file filename dir ref env var variable column col label title hash digest checksum sum count len length limit size ttl expiry expires expired min max policy hint prompt help text message msg format pattern regex rule rules header prefix suffix index idx order list map set view page form input placeholder enabled required valid validator reset change location source provider issuer audience scope scopes class strength days age".split())
NOT_SECRET_KEYS = set("primary foreign public verify partition sort cache lookup map hash object row group composite unique natural surrogate index dict json config sorting shard routing translation i18n registry".split())
#: Words of fillers.
FILLERS = set("your my the a an here change me changeme changeit replace insert put set enter add this with value todo tbd example sample dummy fake test testing placeholder secret password passwd token key api none null undefined xxx redacted hidden removed masked default some any foo bar baz string fill in please use real actual own ref reference app user env var goes".split())
_REFERENCE = re.compile(r"^REDACTED_|\$\{|\$\(|^\$\w|\{\{|%\(\w+\)|%\w+%|<[^<>]*>|^(?:vault|env|ssm|sm|kms|secretsmanager|file|op|keyring|aws|gcp|azure|arn|ref|config)[:/]|process\.env|os\.environ|getenv|^@|#\{|\{\w*\}", re.I)
_DIGEST = re.compile(r"(?:sha-?\d+|md5|blake\w*|crc\d*|etag|digest)[:\-=_]|data:|\$2[aby]\$|\$argon2|\{SSHA", re.I)
_SAME = re.compile(r"(.)\1*|(?:x|X|\*|\.|-|_|0|#|•)+|(?:0123456789|1234567890|abcdef|123456789?)\w*", re.S)
_LOOKUP = re.compile(r"(?i)(?:environ(?:\.get)?|getenv|getproperty|\benv(?:\.get)?|get_?secret|lookup_?env)\s*[\[(]\s*$")
_TOKEN_FORMAT = re.compile(r"eyJ[\w-]+\.[\w-]+|gh[a-z]_|gl[a-z]-|xox[a-z]-|xq[a-z]{2}-")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NAME = re.compile(r"[A-Za-z_][\w.\-]*")


@lru_cache(maxsize=100_000)
def category_of(name: str) -> str | None:
    """The category of credential that a name announces, if any."""
    words = [w.lower() for w in _WORD.findall(name)]
    words = [w for w in words if not w.isdigit()]
    if not words:
        return None
    while len(words) > 1 and words[-1] in ("value", "val", "str", "string", "der", "pem", "data", "literal", "plain", "text", "raw", "b64", "base64", "encoded", "override", "old", "new"):
        words.pop()
    last = words[-1]
    if last in NOT_ITSELF:
        return None
    two = words[-2] if len(words) > 1 else ""
    if last == "key" and two == "private":
        return "private_key"
    if last in PASSWORD_WORDS or last == "word" and two == "pass" or last == "phrase" and two == "pass":
        return "password"
    if last in TOKEN_WORDS:
        return "token"
    if last in KEY_WORDS or last in ("key", "secret") and two in KEY_PAIRS and two not in NOT_SECRET_KEYS or last == "id" and two == "secret":
        return "api_key"
    if last in ("credential", "credentials", "creds", "cred"):
        return "password"
    return None


class Segmenter:
    """Dictionary words of a value by Viterbi over its letters."""

    OUTSIDE = -4.0  # a letter that no word explains

    def __init__(self, words: dict[str, float]):
        self.words, self.longest = words, max(map(len, words), default=1)
        self.residual = lru_cache(maxsize=50_000)(self._residual)

    def _residual(self, value: str) -> tuple[int, frozenset]:
        """Letters and digits outside of words, and the words."""
        left, found = 0, []
        for run in re.findall(r"[A-Za-z]+|\d+", value):
            if run[0].isdigit():
                left += len(run)
                continue
            for part in _WORD.findall(run) if not (run.islower() or run.isupper()) and min(map(len, _WORD.findall(run))) > 2 else [run]:
                own, n = self.best(part.lower())
                left += n
                found += own
        return left, frozenset(found)

    def best(self, s: str) -> tuple[list[str], int]:
        n = len(s)
        score, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        for j in range(1, n + 1):
            score[j], back[j] = score[j - 1] + self.OUTSIDE, -(j - 1) - 1
            for i in range(max(0, j - self.longest), j - 1):
                w = self.words.get(s[i:j])
                if w is not None and score[i] + w > score[j]:
                    score[j], back[j] = score[i] + w, i
        words, left, j = [], 0, n
        while j:
            if back[j] < 0:
                left += 1
                j = -back[j] - 1
            else:
                words.append(s[back[j] : j])
                j = back[j]
        return words, left


class Secret(NamedTuple):
    line: int
    category: str
    spans: tuple[tuple[int, int], ...]  # what redaction replaces


_LINE = re.compile(r"[^\n]*")
_QUOTED = re.compile(r"\"([^\"\\\n]*(?:\\.[^\"\\\n]*)*)\"|'([^'\\\n]*(?:\\.[^'\\\n]*)*)'|`([^`\n]*)`")
#: A superset of what names and forms below accept, in lower case, so that lines without it needn't be looked at.
_SHORT_HINTS = {"pw": r"pw(?![a-z])", "pat": r"pat(?![a-z])"}
_WORD_HINTS = (PASSWORD_WORDS | TOKEN_WORDS | KEY_WORDS | set("pass phrase key auth cred -----begin ls0tl curl --user basic login eyj value:".split())) - {*_SHORT_HINTS}
_HINT = re.compile("|".join([*(re.escape(w) for w in sorted(_WORD_HINTS) if not any(o != w and o in w for o in _WORD_HINTS)), *_SHORT_HINTS.values(), r"://[^\s/@\"']*:[^\s/@\"']+@", r"[ \t]-u[ =]"]))
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_STOP = re.compile(r"-----(END|BEGIN) [A-Z0-9 ]*KEY(?: BLOCK)?-----")
_MATERIAL = re.compile(r"(?<!\\)[A-Za-z0-9+/=]{24,}|(?<=[\n\"'])[A-Za-z0-9+/]{2,23}={0,2}(?=\\n|[\r\n\"'])|(?<=\\n)[A-Za-z0-9+/]{2,23}={0,2}(?=\\n|[\r\n\"']|$)")
_MATERIAL_LINE = re.compile(r"(?:[A-Za-z0-9+/=]{2,}(?:\\n)?)+|[A-Za-z\-]+: .*")
_URL = re.compile(r"[a-zA-Z][\w+.\-]*://([^\s:/@\"'`<>]*):([^\s/@\"'`<>]+(?:@(?=[^\s\"'`]*@)[^\s/@\"'`<>]*)*)@")
_BEARER = re.compile(r"(?i)\b(bearer|basic|token)\s+([A-Za-z0-9_\-.~+/]{8,}=*)")
_CURL = re.compile(r"(?:\s-u|--user)[ =]+['\"]?[^\s:'\"]+:([^\s'\"]+)")
_FLAG = re.compile(r"--?(password|passwd|pass|token|api-?key|secret)[ =]+['\"]?([^\s'\"]+)", re.I)
_LOOSE = re.compile(r"(?:^|(?<=[\s;,{(?&/:\"'#*_]))([A-Za-z_][\w.\-]*)[\"']?[ \t]*(?::=|=>|=|:)[ \t]*([^\s\"'`,;&<>(){}\[\]$|][^\s\"'`,;&<>(){}\[\]|]{3,})")
_SAID = re.compile(r"(?i)\b(password|passphrase|passwd|pwd|(?:api|access|client|service|signing|secret|secret access) ?key|(?:access|session|refresh|bearer|bot|deploy|auth|personal access)? ?token|secret)\s*(?:is|was|:|=|->)?\s+(?:is|was|:)?\s*[\"'`(]*([^\s\"'`,;)]{8,})")
_OPENS = re.compile(r"(?:[=:(+,]|:=|=>|>-?|\|[-+]?|\|\|)\s*$")
_K8S_NAME, _K8S_VALUE = re.compile(r"^\s*-?\s*[\"']?name[\"']?:\s*[\"']?([\w.\-]+)"), re.compile(r"^\s*[\"']?value[\"']?:\s*")
_ENV_ARG = re.compile(r"^\s*[:,=]\s*$|^\s*\)?\s*(?:=|:=|=>|:|\|\||\?\?|,)\s*(?:new\s+\w+\(\s*)?$")


class Finder:
    def __init__(self, words: dict[str, float]):
        self.words = Segmenter(words)
        self.category = lru_cache(maxsize=100_000)(self._category)

    def _category(self, name: str) -> str | None:
        """The category that a name announces; a name run together is segmented into words first."""
        known = category_of(name)
        last = (_WORD.findall(name) or [""])[-1].lower()
        if known or last in NOT_ITSELF or not last.isalpha() or last in self.words.words or len(last) < 6:
            return known
        words, left = self.words.best(last)
        return None if left or min(map(len, words)) < 3 else category_of("_".join(reversed(words)))

    def secret(self, value: str, category: str) -> bool:
        """Whether a value under a name of the category is a credential in use."""
        v = value.strip()
        if len(v) < LEAST_LENGTH[category] or any(c.isspace() for c in v) or _REFERENCE.search(v) or _DIGEST.match(v) or _SAME.fullmatch(v):
            return False
        if category == "private_key":
            return bool(re.fullmatch(r"[A-Za-z0-9+/=\\n\s]{60,}", v))
        if "://" in v:
            return False
        left, words = self.words.residual(v)
        if category != "password" and v.replace(".", "").replace("_", "").replace("-", "").isdigit():
            return False
        if words and words <= FILLERS and left < 4 + 2 * (category != "password"):
            return False
        return left + sum(not c.isalnum() and c not in "-_./: " for c in v) >= RESIDUAL[category]

    def find(self, text: str) -> list[Secret]:
        """All credentials of a file; line ends are line feeds."""
        low = text.lower()
        if not _HINT.search(low):
            return []
        starts = [m.start() for m in re.finditer(r"(?:^|(?<=\n))", text)]
        lines = text.split("\n")
        found: dict[tuple[int, str], list[tuple[int, int]]] = {}
        taken: list[tuple[int, int]] = []

        def add(line: int, category: str, *spans: tuple[int, int]) -> None:
            if not any(a < d and c < b for a, b in spans for c, d in taken):
                found.setdefault((line, category), []).extend(spans)
                taken.extend(spans)

        inside = -1  # lines of key material are done
        # lower case may change the length of a text, but not its lines
        begins = starts if len(low) == len(text) else [m.start() for m in re.finditer(r"(?:^|(?<=\n))", low)]
        near = {bisect_right(begins, m.start()) - 1 for m in _HINT.finditer(low)}
        for n in sorted(near):
            line = lines[n]
            if n <= inside:
                continue
            at = starts[n]
            if (m := _PEM.search(line)) or "LS0tL" in line:
                inside = self._key(text, lines, starts, n, m, add)
                if m:
                    continue
            for u in _URL.finditer(line):
                if self.secret(u[2], "password"):
                    add(n, "password", (at + u.start(2), at + u.end(2)))
            for b in _BEARER.finditer(line):
                self._bearer(b, n, at, line, add)
            for c in _CURL.finditer(line):
                if self.secret(c[1], "password"):
                    add(n, "password", (at + c.start(1), at + c.end(1)))
            for c in _FLAG.finditer(line):
                if (k := self.category(c[1].replace("-", "_"))) and self.secret(c[2], k):
                    add(n, k, (at + c.start(2), at + c.end(2)))
            self._quoted(lines, starts, n, add)
            for m in _LOOSE.finditer(line):
                k = self.category(m[1])
                if m[1] == "value" and n and (named := _K8S_NAME.match(lines[n - 1])):
                    k = self.category(named[1])
                value = m[2].rstrip(".")
                if k and k != "private_key" and self.secret(value, k) and not re.search(r"\w\.\w+$|^\w+\.\w+\.|\[", value if k != "password" and not value.startswith("eyJ") else ""):
                    add(n, k, (at + m.start(2), at + m.start(2) + len(value)))
                elif k == "private_key" and self.secret(value, k):
                    add(n, k, (at + m.start(2), at + m.start(2) + len(value)))
            for m in _SAID.finditer(line):
                k = self.category(m[1].strip().replace(" ", "_"))
                value = m[2].rstrip(".")
                if k and self.secret(value, k) and any(c.isdigit() for c in value) and not re.search(r"[=(\[{]", value):
                    add(n, k, (at + m.start(2), at + m.start(2) + len(value)))
            if "login" in line and (m := re.search(r"\blogin\s+\S+\s+password\s+([^\s'\"]+)", line)) and self.secret(m[1], "password"):
                add(n, "password", (at + m.start(1), at + m.end(1)))
            if m := re.search(r"\bauth\s*[=:]\s*\(\s*[\"'][^\"']*[\"']\s*,\s*[\"']([^\"']+)[\"']", line):
                if self.secret(m[1], "password"):
                    add(n, "password", (at + m.start(1), at + m.end(1)))
            if m := _OPENS.search(line):
                self._below(lines, starts, n, add)
        return sorted(Secret(n + 1, k, tuple(spans)) for (n, k), spans in found.items())

    def _key(self, text: str, lines: list[str], starts: list[int], n: int, m: re.Match | None, add) -> int:
        """Key material that begins in line n; the last line of it."""
        if m is None:
            for v in re.finditer(r"LS0tL[A-Za-z0-9+/=]{20,}", lines[n]):
                try:
                    plain = base64.b64decode(v[0] + "=" * (-len(v[0]) % 4))
                except (binascii.Error, ValueError):
                    continue
                if b"PRIVATE KEY" in plain:
                    add(n, "private_key", (starts[n] + v.start(), starts[n] + v.end()))
            return n - 1
        a = starts[n] + m.end()
        # the material ends at END or at the next BEGIN; without them at the first line that holds neither material nor a header
        end = _PEM_STOP.search(text, a)
        stop = end.start() if end else len(text)
        if not end or end[1] == "BEGIN":
            for k in range(n + 1, bisect_right(starts, stop)):
                x = lines[k].strip(" \t\r\"'`+,;\\#*/|")
                if x and not _MATERIAL_LINE.fullmatch(x):
                    stop = min(stop, starts[k])
                    break
        parts = [(x.start(), x.end()) for x in _MATERIAL.finditer(text, a, stop)]
        if sum(b - a for a, b in parts) < 40:
            return n - 1
        add(n, "private_key", *parts)
        return bisect_right(starts, parts[-1][1]) - 1

    def _bearer(self, b: re.Match, n: int, at: int, line: str, add) -> None:
        value, span = b[2], (at + b.start(2), at + b.end(2))
        if b[1].lower() == "basic":
            try:
                plain = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode()
            except (binascii.Error, ValueError):
                return
            if ":" in plain and self.secret(plain.split(":", 1)[1], "password"):
                add(n, "password", span)
        elif (b[1].lower() == "bearer" or "uthorization" in line) and self.secret(value, "token"):
            add(n, "token", span)

    def _quoted(self, lines: list[str], starts: list[int], n: int, add) -> None:
        line, at = lines[n], starts[n]
        before, key = 0, ""
        for q in _QUOTED.finditer(line):
            g = q.lastindex
            value, gap = q[g], line[before : q.start()]
            after = line[q.end() :]
            name = ""
            if key and re.fullmatch(r"\s*(?::|=|,|=>|:=)\s*", gap):
                name = key  # "name": "value", f("NAME", "value")
            else:
                names = [x for x in _NAME.findall(gap) if not re.fullmatch(r"process\.env\.\w+|string|String|final|static|const|let|var|export|r|b|f|u|rb|br", x)]
                if not names and not gap.strip() and not before and n and (k := _K8S_NAME.match(lines[n - 1])) and _K8S_VALUE.match(line):
                    name = k[1]
                # a call's or an assignment's last name; separators end what came before
                for x in reversed(re.split(r"[,;{]", gap)):
                    if own := [y for y in _NAME.findall(x) if y in names]:
                        name = own[-1] if self.category(own[-1]) or len(own) == 1 else own[-2] if self.category(own[-2]) else own[-1]
                        break
                if n and _K8S_VALUE.match(line) and (k := _K8S_NAME.match(lines[n - 1])):
                    name = k[1]
            key, before = value, q.end()
            if re.match(r"\s*:(?!:)", after) and not re.search(r"[=?]\s*$", gap):
                continue  # a key itself
            if _LOOKUP.search(gap):
                continue  # the name of a variable
            category = self.category(name)
            spans = [(at + q.start(g), at + q.end(g))]
            if category and re.match(r"\s*(?:\+\s*)?(?:\\\s*)?\r?$", after):
                more, parts = self._rest(lines, starts, n)
                value, spans = value + more, spans + parts
            if category and self.secret(value, category):
                add(n, category, *spans)
            elif not category and _TOKEN_FORMAT.match(value) and re.fullmatch(r"[\w.\-]{20,}", value) and self.secret(value, "token") and name and re.search(r"(?i)auth|cred|secret|session|access|login", name):
                add(n, "token", *spans)

    @staticmethod
    def _rest(lines: list[str], starts: list[int], n: int) -> tuple[str, list[tuple[int, int]]]:
        """Literals of the lines below that go on with one that ends line n."""
        value, spans = "", []
        for k in range(n + 1, len(lines)):
            m = re.match(r"\s*(?:\+\s*)?(?:\"([^\"\\]*)\"|'([^'\\]*)')\s*(\+|\\)?\s*([;,)\r]*)", lines[k])
            if not m or lines[k][m.end() :].strip():
                break
            g = 1 if m[1] is not None else 2
            value += m[g]
            spans.append((starts[k] + m.start(g), starts[k] + m.end(g)))
            if m[4].strip():
                break
        return value, spans

    def _below(self, lines: list[str], starts: list[int], n: int, add) -> None:
        """A value in the line below its name: folded text, or a literal in parentheses or after an operator."""
        k = n + 1
        while k < len(lines) and not lines[k].strip():
            k += 1
        if k >= len(lines):
            return
        head = lines[n]
        if _QUOTED.search(head) and not re.search(r"[\"']\s*:\s*\(?\s*$", head):
            return
        names = [x for x in _NAME.findall(head.split("#")[0]) if not re.fullmatch(r"string|String|const|let|var|export|final|static|private|public", x)]
        category = next((c for x in reversed(names[-3:]) if (c := self.category(x))), None)
        if not category:
            return
        if m := re.match(r"\s*(?:\"([^\"\\]*)\"|'([^'\\]*)')", lines[k]):
            g = m.lastindex
            more, spans = self._rest(lines, starts, k)
            if self.secret(m[g] + more, category):
                add(k, category, (starts[k] + m.start(g), starts[k] + m.end(g)), *spans)
        elif re.search(r":\s*[>|][-+]?\s*$", head):
            indent = len(lines[k]) - len(lines[k].lstrip())
            spans, value = [], ""
            for j in range(k, len(lines)):
                s = lines[j].strip()
                if not s or len(lines[j]) - len(lines[j].lstrip()) < max(indent, 1):
                    break
                value += s
                b = starts[j] + lines[j].index(s)
                spans.append((b, b + len(s)))
            if value and self.secret(value, category):
                add(k, category, *spans)


def redact(text: str, secrets: list[Secret]) -> str:
    """The text with each credential replaced by its category's name in capitals; all else, and all line ends, stay."""
    out, at = [], 0
    for a, b, k in sorted((a, b, s.category) for s in secrets for a, b in s.spans):
        if a < at:
            continue
        out += [text[at:a], f"REDACTED_{k.upper()}"]
        at = b
    return "".join(out) + text[at:]


def train(documents: DataFrame, files: DataFrame) -> dict[str, float]:
    """Words and their log probabilities, counted over all documents and files; the driver gets the DICTIONARY most frequent.
    Of files only lower-case names count, as values of their own might be credentials."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z]{3,})"))).alias("word")
    name = F.explode(F.regexp_extract_all("content", F.lit(r"(?<![\w/+=\-.$!@])([a-z]+(?:_[a-z]+)*)(?![\w/+=\-.$!@])"), F.lit(1)))
    part = files.select(name.alias("name")).groupBy("name").agg(F.count("*").alias("n")).select(F.explode(F.split("name", "_")).alias("word"), "n")
    every = documents.select(word).groupBy("word").agg(F.count("*").alias("n")).unionByName(part.where("length(word) > 1"))
    top = every.groupBy("word").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "word").limit(DICTIONARY)
    words = {w: n for w, n in top.collect()}
    words |= {w: max(words.get(w, 0), 20) for w in FILLERS | PASSWORD_WORDS | TOKEN_WORDS | NOT_ITSELF | KEY_PAIRS if len(w) > 1}
    total = sum(words.values())
    # letters outside must not beat a rare word
    return {w: max(math.log(n / total), -14.0, 0.98 * Segmenter.OUTSIDE * len(w)) for w, n in words.items()}


def _scan(files: DataFrame, documents: DataFrame, columns: list[str], rows_of, schema: str, fields) -> DataFrame:
    shared = files.sparkSession.sparkContext.broadcast(train(documents, files))

    def make():
        finder = Finder(shared.value)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for values in zip(*(strings(batch, c) for c in columns)):
                rows += rows_of(values, finder)
            cols = list(zip(*rows)) or [[]] * len(fields)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, fields)], names=[n for n, _ in fields])

        return run

    return map_rows(files.select(*columns), make, schema)


def credentials(files: DataFrame, documents: DataFrame) -> DataFrame:
    """file_path, line_number and category of each credential, once.

    Null and empty contents have none; any file with content is searched, whatever its language; a null path stays null;
    lines are read whole; repeated rows count once; other columns are ignored. The dictionary is broadcast; it has at
    most DICTIONARY words.
    """
    fields = [("file_path", pa.string()), ("line_number", pa.int32()), ("category", pa.string())]
    rows = lambda v, f: [(v[0], s.line, s.category) for s in f.find(v[1])] if v[1] else []
    return _scan(files, documents, ["file_path", "content"], rows, "file_path string, line_number int, category string", fields).distinct()


def redacted(files: DataFrame, documents: DataFrame) -> DataFrame:
    """file_path, credentials (their number) and content with the credentials replaced, for every file row; null stays null."""
    fields = [("file_path", pa.string()), ("credentials", pa.int32()), ("content", pa.string())]

    def rows(v, f):
        s = f.find(v[1]) if v[1] else []
        return [(v[0], len(s), redact(v[1], s) if s else v[1])]

    return _scan(files, documents, ["file_path", "content"], rows, "file_path string, credentials int, content string", fields)

"""Evaluation texts leaking into training text (problem 8).

Pigeonhole matching with edits: each item is cut into pieces so short that a passage of LEAST words holds more pieces
than the errors it may have; so one piece at least stands unchanged. An automaton finds all pieces in a document in one
pass; around each hit the edit distance over words decides whether a passage stands there. Hits are also joined to
segments, extended, and verified by Myers' bit-parallel edit distance.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.arrow import map_rows, strings
from graphloom.session import scratch_table

#: Successive words of an item that make a passage.
LEAST = 25
#: Errors that such a passage may have, and the words of a piece: LEAST words hold BUDGET + 1 whole pieces wherever they start.
BUDGET = 4
PIECE = (LEAST + 1) // (BUDGET + 2)
#: Words that the ends of a passage may lack because they were changed.
EDGE = 1
#: Part of a segment's words that may differ.
RATE = 0.2
#: A three-word sequence in at least this part of the items (four at least) is common; of a passage's other words, the
#: distinctive ones, at least OWN must stand in the document, so that sentences of one mould aren't taken for each other.
COMMON, OWN = 0.05, 0.75
#: A sentence that is the very first of at least so many items is a stock instruction.
STOCK_ITEMS = 3
#: Words of the shortest instruction; a shorter opening is part of the passage.
STOCK_WORDS = 5
#: Weight of the end of an item, more than all its words have.
END = 1e6
#: Items in one automaton; more are taken in blocks of so many, each one pass over the documents.
BLOCK = 20_000

_ESCAPE = re.compile(r"\\[nrt\"'\\/]|\\u[0-9a-f]{4}|&(?:quot|amp|lt|gt|apos|nbsp|#\d+);|</?\w+[^<>]*>")
_HYPHEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?:[#*>/+|-]+[ \t]*)?(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
#: For ASCII texts, the same by bytes.
_BLANK = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


def normal(text: str) -> str:
    """Words in lower case with single blanks around them; marks and escapes are gone."""
    text = text.lower()
    if "\\" in text or "&" in text or "<" in text:
        text = _ESCAPE.sub(" ", text)
    if "-" in text:
        text = _HYPHEN.sub("", text)
    words = text.encode().translate(_BLANK).decode().split() if text.isascii() else _WORD.findall(text)
    return f" {' '.join(words)} "


def sentences(text: str | None) -> list[str]:
    """The normalised sentences of an item."""
    return [p for s in _SENTENCE.split(text or "") if (p := normal(s).strip())]


def without_stock(parts: list[str], stock) -> list[str]:
    """Words of an item without the stock instructions that it opens with."""
    k = 0
    while k < len(parts) and parts[k].count(" ") >= STOCK_WORDS - 1 and parts[k] in stock:
        k += 1
    return " ".join(parts[k:]).split()


def passages(items: list[tuple[int, str]]) -> list[tuple[int, list[str]]]:
    """Words of each item without the stock instructions that open many items."""
    parts = {i: sentences(t) for i, t in items}
    lead = Counter(p[0] for p in parts.values() if p)
    stock = {x for x, n in lead.items() if n >= STOCK_ITEMS}
    return [(i, without_stock(p, stock)) for i, p in parts.items()]


def threes(words: list[str]) -> list[str]:
    """The different three-word sequences of an item."""
    return [*{" ".join(words[k : k + 3]) for k in range(len(words) - 2)}]


def common_threes(items: list[tuple[int, list[str]]]) -> set[str]:
    """Three-word sequences of so many items that they tell none of them."""
    count = Counter(t for _, w in items for t in threes(w))
    least = max(4, COMMON * len(items))
    return {t for t, n in count.items() if n >= least}


def myers(pattern: list, text: list) -> int:
    """The least edit distance, over words, between the pattern and any part of the text."""
    m = len(pattern)
    if not m:
        return 0
    masks: dict = defaultdict(int)
    for k, w in enumerate(pattern):
        masks[w] |= 1 << k
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for w in text:
        eq = masks.get(w, 0)
        d = (((eq & plus) + plus) ^ plus) | eq | minus
        hp, hm = minus | ~(d | plus) & full, d & plus
        score += 1 if hp & high else -1 if hm & high else 0
        hp, hm = (hp << 1) & full, (hm << 1) & full  # a match may start anywhere
        plus, minus = hm | ~(d | hp) & full, d & hp
        if score < best:
            best = score
    return best


class Finder:
    """Finds items in texts. ``common`` are the three-word sequences that tell no item; by default those of these items."""

    def __init__(self, items: list[tuple[int, list[str]]], common: set[str] | None = None):
        common = common_threes(items) if common is None else common
        self.number: dict[str, int] = {}  # of each word of an item; other words have none
        self.words: dict[int, list[int]] = {}
        self.distinct: dict[int, list[bool]] = {}
        self.arrays: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # both as arrays, ended by a word that is never there
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, words in items:
            self.words[i] = [self.number.setdefault(w, len(self.number)) for w in words]
            own = [True] * len(words)
            for k in range(len(words) - 2):
                if " ".join(words[k : k + 3]) in common:
                    own[k : k + 3] = [False] * 3
            self.distinct[i] = own
            self.arrays[i] = np.array([*self.words[i], -1], dtype=np.int64), np.array([*own, END], dtype=np.float64)
            for p in range(0, len(words) - PIECE + 1, PIECE):
                where[" " + " ".join(words[p : p + PIECE]) + " "].append((i, p))
        self.there = np.zeros(len(self.number) + 1)  # words of the text at hand; the last is none
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()
        self.any = bool(where)

    def found(self, text: str | None) -> list[int]:
        """Ids of the items of which a passage stands in the text."""
        return [i for i, n in self.lengths(text).items() if n >= LEAST - EDGE]

    def lengths(self, text: str | None) -> dict[int, int]:
        """For each item with hits, the words of its longest passage in the text; shorter ones than LEAST - EDGE may be left out."""
        if not text or not self.any:
            return {}
        line = normal(text)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, (n, at) in self.automaton.iter(line):
            for i, p in at:
                hits[i].append((end - n + 1, p))
        if not hits:
            return {}
        words, number = line.split(), self.number.get
        doc = [number(w, -1) for w in words]
        out, known = {}, {*doc}
        known.discard(-1)
        known = list(known)
        self.there[known] = 1
        near = self.may([*hits], self.there)
        self.there[known] = 0
        if not near:
            return {}
        starts = [0, *accumulate(len(w) + 1 for w in words)]
        for i in near:
            own = sorted((bisect_right(starts, c) - 1, p) for c, p in hits[i])
            if n := self.longest(self.words[i], self.distinct[i], doc, own):
                out[i] = n
        return out

    def may(self, items: list[int], there: np.ndarray) -> list[int]:
        """The items that have LEAST - EDGE successive words of whose distinctive ones enough are marked as there."""
        words, own = (np.concatenate([self.arrays[i][k] for i in items]) for k in (0, 1))
        sums = np.zeros(len(words) + 1)
        np.cumsum(own * (there[words] - OWN), out=sums[1:])  # each item's are below all before, by its end word
        n = LEAST - EDGE
        ends = np.flatnonzero(sums[n:] >= np.minimum.accumulate(sums)[:-n] - 1e-9) + n - 1
        item = np.searchsorted(np.cumsum([len(self.arrays[i][0]) for i in items]), ends, side="right")
        return [items[k] for k in dict.fromkeys(item.tolist())]

    def longest(self, item: list[int], distinct: list[bool], doc: list[int], hits: list[tuple[int, int]]) -> int:
        """The words of the longest passage around the hits, which go by their places in the document."""
        near = range(-BUDGET, BUDGET + 1)
        segments: dict[int, list[int]] = {}  # item from, to; document from, to: by the diagonal of their ends, if open
        closed, whole, last = [], [], {}
        for d, p in hits:
            g = d - p
            fits = [s for s in (segments.values() if len(segments) < 9 else filter(None, map(segments.get, range(g - BUDGET, g + BUDGET + 1)))) if -BUDGET <= g - s[3] + s[1] <= BUDGET and p >= s[1] and d >= s[3] and p - s[1] <= 2 * PIECE + BUDGET]
            s = max(fits, key=lambda s: s[3]) if fits else [p, p, d, d]
            if fits:
                del segments[s[3] - s[1]]
            s[1], s[3] = p + PIECE, d + PIECE
            if g in segments:
                closed.append(segments[g])
            segments[g] = s
            # a hit inside of a passage that is known needs no search of its own
            if not last or not any((s := last.get(g + x)) and s[0] <= p and p + PIECE <= s[1] and s[2] <= d and d + PIECE <= s[3] for x in near):
                if s := self.passage(item, doc, d, p):
                    whole.append(s)
                    last[g] = s
        grown = [[*s] for s in whole]
        segments = [*closed, *segments.values()]
        for s in segments + grown:
            self.extend(item, doc, s)
        good = set()
        for s in {tuple(s) for s in segments + whole + grown}:
            n, errors = s[1] - s[0], myers(item[s[0] : s[1]], doc[s[2] : s[3]])
            if n >= PIECE and errors <= RATE * n:
                there = set(doc[s[2] : s[3]])
                own = [item[k] in there for k in range(s[0], s[1]) if distinct[k]]
                good.add((*s, errors, len(own), sum(own)))
        # a passage may be split: segments that follow each other in the item; words between them count as errors
        best = 0
        # by the item's word that a chain ends before: start, errors, distinctive words and those found -> least end in the document
        chains: dict[int, dict[tuple[int, int, int, int], int]] = defaultdict(dict)
        for s in sorted(good):
            starts = {(s[0], *s[4:])}
            for end in range(s[0] - PIECE, min(s[0] + PIECE, s[1] - 1) + 1):
                for (start, errors, own, there), stop in chains.get(end, {}).items():
                    if s[2] >= stop - PIECE:
                        gap = max(s[0] - end, 0)
                        starts.add((start, errors + s[4] + gap, own + s[5] + sum(distinct[end : s[0]]), there + s[6]))
            for start, errors, own, there in starts:
                if errors <= RATE * (s[1] - start):
                    at = chains[s[1]]
                    at[start, errors, own, there] = min(at.get((start, errors, own, there), s[3]), s[3])
                    if there >= OWN * own:
                        best = max(best, s[1] - start)
        return best

    @staticmethod
    def side(item: list[int], doc: list[int], i: int, k: int, step: int, rows: int, columns: int) -> list[tuple[int, int]]:
        """For 0 to BUDGET errors the most words of the item (at most ``rows``) and of the document from a place on, in one
        direction, up to an equal pair: furthest points of each diagonal, error by error."""
        reached = {}
        best, top = [], (0, 0)
        for e in range(BUDGET + 1):
            now = {}
            for g in range(-e, e + 1):  # document words more than item words
                if e:
                    r = max(reached.get(g, -9) + 1, reached.get(g - 1, -9), reached.get(g + 1, -9) + 1)
                    if r > rows or r + g > columns:
                        r = min(rows, columns - g)
                    if r < 0 or r + g < 0:
                        continue
                else:
                    r = 0
                a, x, y, n = r, i + r * step, k + (r + g) * step, min(rows, columns - g)
                while r < n and item[x] == doc[y]:
                    r, x, y = r + 1, x + step, y + step
                now[g] = r
                if r > a and r > top[0]:
                    top = (r, r + g)
            best.append(top)
            if top[0] == rows:  # no errors more find more
                return best + [top] * (BUDGET - e)
            reached = now
        return best

    @classmethod
    def passage(cls, item: list[int], doc: list[int], d: int, p: int) -> list[int] | None:
        """The passage around an unchanged piece, as item from, to; document from, to: the longest of LEAST words at most
        on a side with BUDGET errors, or None. EDGE words may be missing at its ends, and count as errors."""
        side, far = LEAST - PIECE, LEAST - PIECE + BUDGET
        there = set(doc[max(0, d - far) : d + PIECE + far])
        if sum(map(there.__contains__, item[max(0, p - side) : p + PIECE + side])) < LEAST - BUDGET:
            return None  # fewer words of the item are near than any passage keeps
        left = cls.side(item, doc, p - 1, d - 1, -1, min(side, p), d)
        right = cls.side(item, doc, p + PIECE, d + PIECE, 1, min(side, len(item) - p - PIECE), len(doc) - d - PIECE)
        found = None
        for e, (lr, lc) in enumerate(left):
            for e2, (rr, rc) in enumerate(right[: BUDGET + 1 - e]):
                n = lr + PIECE + rr
                if n >= LEAST - EDGE and e + e2 + max(0, LEAST - n) <= BUDGET and (found is None or n > found[1] - found[0]):
                    found = [p - lr, p + PIECE + rr, d - lc, d + PIECE + rc]
        return found

    @staticmethod
    def extend(item: list[int], doc: list[int], s: list[int]) -> None:
        """Grow a segment at both ends over equal words, and over errors that two equal words follow, within the rate."""
        errors = abs((s[1] - s[0]) - (s[3] - s[2]))
        for step in (1, -1):
            i, d = (s[1], s[3]) if step == 1 else (s[0] - 1, s[2] - 1)
            while 0 <= i < len(item) and 0 <= d < len(doc):
                if item[i] == doc[d]:
                    i, d = i + step, d + step
                    continue
                length = (i - s[0] if step == 1 else s[1] - i) + 2
                for di, dd in ((1, 1), (0, 1), (1, 0), (2, 2), (0, 2), (2, 0)):
                    if errors + max(di, dd) > RATE * length:
                        continue
                    a, b = i + di * step, d + dd * step
                    a2, b2 = a + step, b + step
                    if 0 <= a < len(item) and 0 <= b < len(doc) and item[a] == doc[b] and (not 0 <= a2 < len(item) or not 0 <= b2 < len(doc) or item[a2] == doc[b2]):
                        i, d = a, b
                        errors += max(di, dd)
                        break
                else:
                    break
            if step == 1:
                s[1], s[3] = i, d
            else:
                s[0], s[2] = i + 1, d + 1


def prepared(items: DataFrame, block: int) -> tuple[DataFrame, set[str], int]:
    """Items as queries, written once: item_id, words (without stock instructions) and block; the common three-word
    sequences; and the number of blocks.

    Both statistics are counted over all items, so blocks don't change the result. Of the sequences at most 20 times the
    mean number of an item's words are common, so their set is small. A block follows from the hash of the id.
    """
    spark = items.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    whole = items.where("item_id IS NOT NULL AND text IS NOT NULL").groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_set("text")), "\n").alias("text"))

    def cut():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = pa.array([sentences(t) for t in strings(batch, "text")], pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([batch.column(0), parts], names=["item_id", "parts"])

        return run

    parts = scratch_table(map_rows(whole, cut, f"item_id {kind}, parts array<string>"), "items")
    lead = parts.where("size(parts) > 0").groupBy(F.col("parts")[0].alias("part")).agg(F.count("*").alias("n")).where(F.col("n") >= STOCK_ITEMS).select("part")
    opens = parts.select("item_id", F.explode("parts").alias("part")).join(lead, "part", "left_semi").groupBy("item_id").agg(F.collect_set("part").alias("stock"))

    def strip():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = [without_stock(p, set(s or ())) for p, s in zip(strings(batch, "parts"), strings(batch, "stock"))]
            cols = [pa.array(x, pa.list_(pa.string())) for x in (words, [threes(w) for w in words])]
            return pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["item_id", "words", "threes"])

        return run

    known = scratch_table(map_rows(parts.join(opens, "item_id", "left").select("item_id", "parts", "stock"), strip, f"item_id {kind}, words array<string>, threes array<string>"), "items")
    n = known.count()
    count = known.select(F.explode("threes").alias("three")).groupBy("three").agg(F.count("*").alias("n"))
    common = {t for (t,) in count.where(F.col("n") >= max(4.0, COMMON * n)).select("three").toLocalIterator()}
    blocks = max(1, -(-n // block))
    return known.select("item_id", "words", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")), common, blocks


def leaks(documents: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id and words (of the longest passage) for each document with a passage of an item, once.

    Items are a query set of stated size, read to the driver in blocks of about ``block`` items; each block is broadcast
    as an automaton and meets all documents in one pass without a shuffle. Null, empty and short items have no passages;
    null and empty texts hold none; repeated rows count once, and different texts of one item id are one item; texts are
    read whole; other columns are ignored.
    """
    spark = documents.sparkSession
    doc_kind, item_kind = (x.schema[c].dataType.simpleString() for x, c in ((documents, "doc_id"), (items, "item_id")))
    texts = documents.select("doc_id", "text")
    known, common, blocks = prepared(items, block)

    def search(number: int) -> DataFrame:
        rows = [(i, w) for i, w in known.where(F.col("block") == number).select("item_id", "words").toLocalIterator() if len(w) >= LEAST - EDGE]
        shared = spark.sparkContext.broadcast((rows, common))

        def make():
            finder = Finder(*shared.value)

            def run(batch: pa.RecordBatch) -> pa.RecordBatch:
                rows, keys = [], []
                for k, text in enumerate(strings(batch, "text")):
                    for i, n in finder.lengths(text).items():
                        if n >= LEAST - EDGE:
                            keys.append(k)
                            rows.append((i, n))
                ids = batch.column(0).take(pa.array(keys, pa.int32()))
                return pa.RecordBatch.from_arrays([ids, pa.array([i for i, _ in rows], pa.int64()), pa.array([n for _, n in rows], pa.int32())], names=["doc_id", "item_id", "words"])

            return run

        return map_rows(texts, make, f"doc_id {doc_kind}, item_id long, words int")

    found = search(0)
    for b in range(1, blocks):
        found = found.unionByName(search(b))
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words")).select("doc_id", F.col("item_id").cast(item_kind).alias("item_id"), "words")


def leak_pairs(documents: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(documents, items).select("doc_id", "item_id")

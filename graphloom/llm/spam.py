"""Keyword-stuffed and link-list pages (problem 9).

A page becomes a sequence of function-word and word classes. Links, tags, words that come again after the same word, and
long runs of words without a function word are symbols of that sequence. A trigram model trained on prose scores each
symbol; a line or window whose perplexity lies outside of what prose has is abnormal, too high (keywords, links, tags)
or too low (one pattern over and over), and a page is spam if most of its symbols stand in abnormal places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.arrow import map_rows, pieces, strings
from graphloom.llm.wordclasses import IDS, SIZE, TOKEN, TokenClass
from graphloom.session import scratch_table

#: Parts of the prose's lines whose perplexity counts as too high and as too low.
TOO_HIGH, TOO_LOW = 0.002, 0.0005
#: A page is spam if at least this part of its symbols stands in abnormal places, and it has at least so many symbols.
SPAM_SHARE, LEAST_SYMBOLS = 0.8, 16
#: A line is scored as a whole if it has so many symbols; a shorter one with as many symbols on both sides.
WINDOW = 8
#: A line is prose to the model if it has so many words and at least this part of them are function words.
PROSE_WORDS, PROSE_SHARE = 4, 0.2
#: A line of which this part of the words has come again and again isn't what the model learns from.
STUFFED_SHARE = 0.5
#: Content words without a function word, sentence end or figure between them that make a run long and very long.
LONG_RUN, VERY_LONG_RUN = 4, 8
#: Earlier times that a word has come after the same word, and the pair's part of the page's words, which make it repeated,
#: more repeated and stuffed.
REPEATED, REPEATED_SHARE = (1, 3, 5), (0, 0.007, 0.015)
#: A line without links and tags is technical, so neither prose nor spam, if it has at most so many words for each figure, or
#: for each bracket, figure and sign.
FIGURE_WORDS, SIGN_WORDS = 3, 2
#: Width of a bin of line scores in the histogram that the bounds come from.
BIN = 0.01

_FENCE = re.compile(r"(?ms)^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[^\n]*$|\Z)")
#: Common and reserved top-level domains.
_HOST = r"(?:[a-zA-Z0-9][a-zA-Z0-9\-]*\.)+(?:com|org|net|io|info|biz|dev|app|co|edu|gov|eu|uk|de|fr|es|it|pt|ru|cn|jp|example|test|invalid)\b(?!\()(?:/[^\s<>\"')\]]*)?"
_PIECE = re.compile(r"</?(?!meta\b)[a-zA-Z][^<>\n]*>|!?\[!?\[?(?=[^\[\]\n]*\]\()|\]\([^\s()]*\)|(?:https?://|www\.)[^\s<>\"')\]]+|" + _HOST + "|" + TOKEN.pattern)


def _kinds(*names: str) -> np.ndarray:
    out = np.zeros(SIZE, dtype=bool)
    out[[IDS[n] for n in names]] = True
    return out


_FUNCTION = np.arange(SIZE) <= IDS["adverb"]
_LETTERS = _kinds("han", "katakana", "hiragana", "han grammar")  # of scripts without blanks
_WORD, _CONTENT_LETTER = _kinds("word", "capital"), _kinds("han", "katakana")
_OTHER_WORD = _kinds("link", "tag", "code word")
_GRAMMAR = _FUNCTION | _kinds("hiragana", "han grammar")
_TEXT = _WORD | _CONTENT_LETTER | _GRAMMAR | _OTHER_WORD
_ENDS_RUN = _GRAMMAR | _kinds("end", "number")
_FIGURE, _SIGNS, _LINKS = _kinds("number"), _kinds("number", "bracket", "sign"), _kinds("link", "tag")
LINE, START = IDS["line"], IDS["start"]
# symbols beyond the classes: repeated function words, repeated letters, and words and letters by repetition and run
_AGAIN_FUNCTION, _AGAIN_LETTER, _MARKED_WORD, _MARKED_LETTER = SIZE - 1, SIZE + 2, SIZE + 6, SIZE + 18
SYMBOLS = SIZE + 30
_STUFFED = np.zeros(SYMBOLS, dtype=bool)
for _k in (2, 3):
    _STUFFED[[_AGAIN_FUNCTION + _k, _AGAIN_LETTER + _k, *(m + 3 * _k + r for m in (_MARKED_WORD, _MARKED_LETTER) for r in range(3))]] = True


class Classes(TokenClass):
    """Classes of tokens, with links by their markup; -1 for markup that is no symbol."""

    def __missing__(self, t: str) -> int:
        if len(t) > 1 and (t[0] == "<" and t[-1] == ">" or t[0] == "[" or t[:2] == "!["):
            return IDS["link"] if t[0] == "<" and re.search(r"https?:|www\.", t) else -1
        host = "." in t and t[0].isalnum() and t.strip("0123456789.,:")
        return IDS["link"] if host or t[:2] == "](" else super().__missing__(t)


def technical(kinds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each line, given by its start, is one of figures, code or output."""
    if not len(kinds):
        return np.zeros(0, dtype=bool)
    words, figures, signs, links = (np.add.reduceat(x[kinds].astype(np.int64), starts) for x in (_TEXT, _FIGURE, _SIGNS, _LINKS))
    return (links == 0) & (signs > 0) & ((FIGURE_WORDS * figures >= words) & (figures > 0) | (SIGN_WORDS * signs >= words))


def symbols(texts: list[str | None], known: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class and symbol of each token of all texts one after another, and the number of each text's tokens.

    Fenced code becomes a line of signs.
    """
    tokens = [_PIECE.findall(_FENCE.sub(lambda m: "\n" + "=" * (len(m[0]) // 5) + "\n", t) if "```" in t or "~~~" in t else t) if t else [] for t in texts]
    flat = [*chain.from_iterable(tokens)]
    kinds = np.fromiter(map(known.__getitem__, flat), dtype=np.int64, count=len(flat))
    page = np.repeat(np.arange(len(texts)), np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)))
    keep = kinds >= 0
    number: dict[str, int] = {}
    words = np.fromiter((number.setdefault(t.lower(), len(number)) for t in flat), dtype=np.int64, count=len(flat))
    kinds, page, words = kinds[keep], page[keep], words[keep]
    counts = np.bincount(page, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    if not len(kinds):
        return kinds, kinds, counts
    # earlier times of each pair of words (of four letters in scripts without blanks) in its page
    at = np.flatnonzero(_TEXT[kinds] | _LETTERS[kinds])
    again = np.zeros(len(kinds), dtype=np.int64)
    if len(at):
        w = words[at].astype(np.uint64)
        two = np.concatenate([w[:1], w[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + w
        four = np.concatenate([two[:1], two[:1], two[:-2]])[: len(two)] * np.uint64(0xC2B2AE3D27D4EB4F) + two
        key = np.where(_LETTERS[kinds[at]], four, two) ^ (page[at].astype(np.uint64) * np.uint64(0x165667B19E3779F9))
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        rank = np.empty(len(at), dtype=np.int64)
        rank[order] = np.arange(len(at)) - first
        size = np.diff(np.concatenate([np.flatnonzero(new), [len(at)]]))
        part = np.empty(len(at))
        part[order] = np.repeat(size, size)
        part /= np.bincount(page[at], minlength=len(texts))[page[at]]
        again[at] = sum(((rank >= n) & (part >= s)).astype(np.int64) for n, s in zip(REPEATED, REPEATED_SHARE))
    # content words since the last function word, sentence end, figure or page start; three letters count as a word
    total = np.cumsum((_WORD | _OTHER_WORD)[kinds] + _CONTENT_LETTER[kinds] / 3)
    begins = np.concatenate([[True], page[1:] != page[:-1]])
    base = np.maximum.accumulate(np.where(_ENDS_RUN[kinds], total, np.where(begins, np.concatenate([[0.0], total[:-1]]), 0)))
    run = (total - base > LONG_RUN).astype(np.int64) + (total - base > VERY_LONG_RUN)
    # names of figures come again from row to row: such lines have no repetitions
    starts = np.flatnonzero(begins | np.concatenate([[True], kinds[:-1] == LINE]))
    again[np.repeat(technical(kinds, starts), np.diff(np.concatenate([starts, [len(kinds)]])))] = 0
    marked = (again > 0) | (run > 0)
    out = np.where(_WORD[kinds] & marked, _MARKED_WORD + 3 * again + run, kinds)
    out = np.where(_CONTENT_LETTER[kinds] & marked, _MARKED_LETTER + 3 * again + run, out)
    out = np.where(_FUNCTION[kinds] & (again > 0), _AGAIN_FUNCTION + again, out)
    return kinds, np.where(_LETTERS[kinds] & ~_CONTENT_LETTER[kinds] & (again > 0), _AGAIN_LETTER + again, out), counts


class Pages:
    """Sequences of several pages, with their lines and contexts."""

    def __init__(self, kinds: np.ndarray, marks: np.ndarray, counts: np.ndarray):
        self.kinds, self.marks, self.counts = kinds.astype(np.int64), marks.astype(np.int64), counts
        n = len(self.kinds)
        stops = np.cumsum(counts)
        begin = np.zeros(n + 1, dtype=bool)
        begin[0] = True
        begin[np.minimum(np.concatenate([stops, np.flatnonzero(self.kinds == LINE) + 1]), n)] = True
        self.starts = np.flatnonzero(begin[:n])
        self.lengths = np.diff(np.concatenate([self.starts, [n]]))
        b = np.concatenate([[START], self.kinds[:-1]])[:n]
        a = np.concatenate([[START, START], self.kinds[:-2]])[:n]
        b[self.starts] = a[self.starts] = START
        second = self.starts[self.lengths > 1] + 1
        a[second] = START
        self.cells = (a * SIZE + b) * SYMBOLS + self.marks

    def per_line(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts) if len(self.starts) else np.zeros(0)

    def prose(self) -> np.ndarray:
        """Whether each line is prose: function words enough, and few words that come again and again."""
        words, grammar = (self.per_line(x[self.kinds].astype(np.int64)) for x in (_TEXT, _GRAMMAR))
        return (words >= PROSE_WORDS) & (grammar >= PROSE_SHARE * words) & (self.per_line(_STUFFED[self.marks].astype(np.int64)) < STUFFED_SHARE * words)

    def scores(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mean log probability of the line or window of each symbol, and of each line: negative logarithms of perplexities."""
        logp = table[self.cells].astype(np.float64)
        lines = self.per_line(logp) / np.maximum(self.lengths, 1)
        out = np.repeat(lines, self.lengths)
        stops = np.cumsum(self.counts)
        short = np.flatnonzero(np.repeat(self.lengths < WINDOW, self.lengths))
        page = np.repeat(np.arange(len(self.counts)), self.counts)[short]
        low, high = np.maximum(short - WINDOW, (stops - self.counts)[page]), np.minimum(short + WINDOW + 1, stops[page])
        sums = np.concatenate([[0.0], np.cumsum(logp)])
        out[short] = (sums[high] - sums[low]) / np.maximum(high - low, 1)
        return out, lines


def log_table(cells: np.ndarray) -> np.ndarray:
    """Log probabilities of a symbol after two classes, from counts: trigrams interpolated with bigrams and single symbols."""
    tri = cells.reshape(SIZE, SIZE, SYMBOLS) + 0.001
    bi, uni = tri.sum(0) + 0.01, tri.sum((0, 1)) + 1
    p = 0.6 * tri / tri.sum(2, keepdims=True) + 0.3 * (bi / bi.sum(1, keepdims=True))[None] + 0.1 * uni / uni.sum()
    return np.log(p).astype(np.float32).reshape(-1)


def bounds(histogram: dict[int, int]) -> tuple[float, float]:
    """Scores below and above which a place is abnormal, from the histogram of the prose lines' scores."""
    if not histogram:
        return -np.inf, np.inf
    bins = np.array(sorted(histogram))
    share = np.cumsum([histogram[b] for b in bins]) / sum(histogram.values())
    return float(bins[np.searchsorted(share, TOO_HIGH)] * BIN), float((bins[np.searchsorted(share, 1 - TOO_LOW)] + 1) * BIN)


def shares(pages: Pages, model: tuple[np.ndarray, float, float]) -> tuple[np.ndarray, np.ndarray]:
    """For each page the part of its symbols, line ends aside, in abnormal places, and the mean score of its symbols.

    Figures, code and output count as symbols in normal places.
    """
    table, low, high = model
    score, _ = pages.scores(table)
    page, real = np.repeat(np.arange(len(pages.counts)), pages.counts), pages.kinds != LINE
    long = np.repeat(pages.lengths >= WINDOW, pages.lengths)
    odd = real & ~np.repeat(technical(pages.kinds, pages.starts), pages.lengths) & ((score < low) | (score > high) & long)
    count = lambda x: np.bincount(page, weights=x, minlength=len(pages.counts))
    n = np.maximum(count(real), 1)
    return count(odd) / n, count(np.where(real, table[pages.cells], 0)) / n


def _decoded(batch: pa.RecordBatch) -> Pages:
    kinds, marks = (strings(batch, c) for c in ("kinds", "marks"))
    join = lambda x: np.frombuffer(b"".join(x), dtype=np.uint8)
    return Pages(join(kinds), join(marks), np.fromiter(map(len, kinds), dtype=np.int64, count=len(kinds)))


def page_symbols(documents: DataFrame) -> DataFrame:
    """doc_id, kinds and marks (a byte for each symbol) of every row, written once; further columns are left out."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def make():
        known = Classes()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            kinds, marks, counts = symbols(strings(batch, "text"), known)
            stops = np.cumsum(counts)
            cols = [[x[b - n : b].astype(np.uint8).tobytes() for b, n in zip(stops, counts)] for x in (kinds, marks)]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in cols)], names=["doc_id", "kinds", "marks"])

        return run

    return scratch_table(map_rows(documents.select("doc_id", "text"), make, f"doc_id {kind}, kinds binary, marks binary"), "pages")


def _totals(pages: DataFrame, counted) -> dict[int, int]:
    """Sums over all rows of the counts that ``counted`` gives for parts of them; few keys, so the result is small."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in it:
            for part in pieces(batch):
                for k, n in zip(*counted(_decoded(part))):
                    total[int(k)] = total.get(int(k), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int64()), pa.array([*total.values()], pa.int64())], names=["k", "n"])

    return dict(map(tuple, pages.select("kinds", "marks").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n")).collect()))


def train(pages: DataFrame) -> tuple[np.ndarray, float, float]:
    """The trigram table of the prose lines of all pages, and the bounds of its lines' scores.

    The driver gets a count for each pair of classes and symbol at most, and for each bin of scores.
    """
    cells = _totals(pages, lambda p: np.unique(p.cells[np.repeat(p.prose(), p.lengths)], return_counts=True))
    counts = np.zeros(SIZE * SIZE * SYMBOLS)
    counts[[*cells]] = [*cells.values()]
    table = log_table(counts)
    shared = pages.sparkSession.sparkContext.broadcast(table)

    def bins(p: Pages):
        own = p.scores(shared.value)[1][p.prose() & (p.lengths >= WINDOW)]
        return np.unique(np.floor(own / BIN).astype(np.int64), return_counts=True)

    return (table, *bounds(_totals(pages, bins)))


def spam_scores(documents: DataFrame) -> DataFrame:
    """doc_id, spam_share (part of the symbols in places of abnormal perplexity), perplexity (of the page) and spam.

    Null, empty and blank texts have share 0 and perplexity 1 and are no spam; repeated rows stay repeated; texts are
    read whole; other columns are ignored. Texts are cut into symbols once; the model and its bounds are counted over all
    rows, and their size is fixed by the number of classes.
    """
    pages = page_symbols(documents)
    model = documents.sparkSession.sparkContext.broadcast(train(pages))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def make():
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = _decoded(batch)
            share, mean = shares(own, model.value)
            cols = [pa.array(share), pa.array(np.exp(-mean)), pa.array((share >= SPAM_SHARE) & (own.counts >= LEAST_SYMBOLS))]
            return pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "spam_share", "perplexity", "spam"])

        return run

    return map_rows(pages, make, f"doc_id {kind}, spam_share double, perplexity double, spam boolean")


def spam_pages(documents: DataFrame) -> DataFrame:
    return spam_scores(documents).where("spam").select("doc_id").distinct()

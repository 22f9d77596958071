"""Natural language hidden inside code (problem 4).

A hidden Markov model over letters, with one state for code and one for each language, segments whole files. A state
emits a letter given the two letters before it. Its best path (Viterbi) counts only inside comments and literals.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.arrow import bounded_sample, map_rows, strings
from graphloom.llm.lex import SPANS, language_of
from graphloom.llm.syntax import GRAMMARS, syntax_errors

LANGS = ("en", "de", "fr", "es", "pt", "it", "ru", "zh", "ja")
STATES = ("code", *LANGS)
S = len(STATES)
#: The model is fitted on at most so many documents and source files, chosen by the hashes of their ids.
TRAIN_DOCS, TRAIN_FILES = 6000, 600
#: Log probability of a change of state, and the part of a file's letters that a language must have.
SWITCH, LEAST_SHARE = -9.0, 0.05
#: Letters whose back pointers are kept at once.
BLOCK = 8192

# Letters by class: what tells languages and code apart has a class of its own.
_SINGLE = "abcdefghijklmnopqrstuvwxyz äöüßàâçéèêëîïôùûñáíóúãõìò" + ".,;:'\"-_()[]{}<>=+*/\\|&%$#@!?`~^" + "\n。，、"
K = len(_SINGLE) + 8
_UPPER, _DIGIT, _CYRILLIC, _HIRAGANA, _KATAKANA, _HAN, _OTHER, _PAD = range(len(_SINGLE), K)


def _class_table() -> np.ndarray:
    table = np.full(0x10000, _OTHER, dtype=np.uint8)
    for a, b, c in ((0x3040, 0x30A0, _HIRAGANA), (0x30A0, 0x3100, _KATAKANA), (0x3400, 0xA000, _HAN), (0x400, 0x530, _CYRILLIC), (0x30, 0x3A, _DIGIT), (0x41, 0x5B, _UPPER)):
        table[a:b] = c
    for i, c in enumerate(_SINGLE):
        table[ord(c)] = i
        if ord(c.upper()[0]) > 127 and len(c.upper()) == 1:
            table[ord(c.upper())] = i
    table[[9, 13, 0xA0]] = _SINGLE.index(" ")
    return table


CLASSES = _class_table()
_SPACE, _LINE = _SINGLE.index(" "), _SINGLE.index("\n")


def letter_classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return CLASSES[np.minimum(codes, 0xFFFF)]


def trigrams(c: np.ndarray) -> np.ndarray:
    """The number of each letter with the two before it; before the first lies a line end."""
    x = np.concatenate([[_LINE, _LINE], c]).astype(np.int32)
    return (x[:-2] * K + x[1:-1]) * K + x[2:]


def _log_table(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of one state from its trigram counts, interpolated with bigrams and single letters."""
    tri = counts.reshape(K, K, K).astype(np.float64)
    bi, uni = tri.sum(0), tri.sum((0, 1)) + 0.5
    two = tri.sum(2, keepdims=True)
    uni = uni / uni.sum()
    pb = (bi + 30 * uni) / (bi.sum(1, keepdims=True) + 30)
    return np.log((tri + 10 * pb[None]) / (two + 10)).astype(np.float32).reshape(-1)


#: Marks that stand before prose in files; the training prose gets them in turn.
MARKS = ("", "# ", "// ", " * ", '"', '"""', "/** ", "    ")


def fit(docs: list[tuple[str, str]], code: list[str]) -> np.ndarray:
    """The emission table, one row of S values for each trigram. docs: (language as labelled, prose); wrong labels are
    corrected first, by the trigrams' plain frequencies in each language."""
    own = [(STATES.index(lang), trigrams(letter_classes(t))) for lang, t in docs if lang in LANGS]
    plain = np.zeros((S, K**3), dtype=np.float32)
    for s, x in own:
        np.add.at(plain[s], x, 1)
    plain = np.log((plain + 0.01) / (plain.sum(1, keepdims=True) + 0.01 * K**3)).astype(np.float32)
    right = [1 + int(plain[1:, x].sum(1).argmax()) for _, x in own]
    table = np.zeros((S, K**3), dtype=np.float32)
    for s, (_, t) in zip(right, ((lang, t) for lang, t in docs if lang in LANGS)):
        marked = "\n".join(MARKS[k % len(MARKS)] + line for k, line in enumerate(t.split("\n")))
        np.add.at(table[s], trigrams(letter_classes(marked)), 1)
    for t in code:
        np.add.at(table[0], trigrams(letter_classes(t)), 1)
    return np.ascontiguousarray(np.stack([_log_table(c) for c in table]).T)


def viterbi(table: np.ndarray, pieces: list[np.ndarray], block: int = BLOCK) -> list[np.ndarray]:
    """The best path of states of each file (an array of trigram numbers), many files side by side.

    Back pointers are kept for ``block`` letters at a time: a first pass keeps the scores at each block's start, a second
    one goes over the blocks from the last to the first. So the path is that of the whole file, whatever its length.
    """
    out: list = [None] * len(pieces)
    order = sorted((k for k in range(len(pieces)) if len(pieces[k])), key=lambda k: len(pieces[k]), reverse=True)
    at = 0
    while at < len(order):
        own = order[at : at + max(1, min(1024, 3_000_000 // len(pieces[order[at]])))][::-1]  # by rising length
        at += len(own)
        lengths = np.array([len(pieces[k]) for k in own])
        longest, width = int(lengths[-1]), len(own)
        first = np.searchsorted(lengths, np.arange(longest), side="right")  # the first file that is longer than t
        x = np.zeros((longest, width), dtype=np.int32)
        for j, k in enumerate(own):
            x[: lengths[j], j] = pieces[k]
        rows = np.arange(width)
        moved = np.zeros((min(block, longest), width, S), dtype=bool)
        source = np.zeros((min(block, longest), width), dtype=np.uint8)

        def forward(score: np.ndarray, begin: int, end: int) -> None:
            for t in range(begin, end):
                f = first[t]
                sc = score[f:]
                best = sc.argmax(1)
                sc -= sc[rows[: width - f], best][:, None]  # the best is 0, so a change is SWITCH for all
                np.less(sc, SWITCH, out=moved[t - begin, f:])
                np.maximum(sc, SWITCH, out=sc)
                source[t - begin, f:] = best
                sc += table[x[t, f:]]

        score, starts = np.zeros((width, S), dtype=np.float32), {}
        for begin in range(0, longest, block):
            starts[begin] = score.copy()
            forward(score, begin, min(begin + block, longest))
        state = score.argmax(1)
        path = np.zeros((longest, width), dtype=np.uint8)
        for begin in sorted(starts, reverse=True):
            end = min(begin + block, longest)
            if end < longest:  # the pointers of the last block are still there
                forward(starts[begin], begin, end)
            for t in range(end - 1, begin - 1, -1):
                f = first[t]
                cur = state[f:]
                path[t, f:] = cur
                state[f:] = np.where(moved[t - begin, rows[f:], cur], source[t - begin, f:], cur)
        for j, k in enumerate(own):
            out[k] = path[: lengths[j], j]
    return [np.zeros(0, np.uint8) if x is None else x for x in out]


class Segmenter:
    def __init__(self, table: np.ndarray):
        self.table = table

    def count(self, files: list[tuple[str, str]]) -> np.ndarray:
        """For each (language, text) the letters of each state inside comments and literals."""
        classes = [letter_classes(t) for _, t in files]
        paths = viterbi(self.table, [trigrams(c) for c in classes])
        out = np.zeros((len(files), S), dtype=np.int64)
        for n, ((lang, text), c, path) in enumerate(zip(files, classes, paths)):
            step = np.zeros(len(c) + 1, dtype=np.int32)
            ends = np.array([m.span() for m in SPANS[lang].finditer(text) if m.lastindex], dtype=np.int64).reshape(-1, 2)
            np.add.at(step, ends[:, 0], 1)
            np.add.at(step, ends[:, 1], -1)
            inside = np.cumsum(step[:-1]) > 0
            blank = (c == _SPACE) | (c == _LINE)
            inside[1:] &= ~(blank[1:] & blank[:-1])  # indents are no prose
            # Latin letters between others are no Russian, Chinese or Japanese prose
            inside &= (path < STATES.index("ru")) | ~((c < 26) | (c == _UPPER))
            out[n] = np.bincount(path[inside], minlength=S)
        return out


_CODE_LINE = re.compile(r"[{}=;|`]|https?:|^\s*(?:[#$>]|\d+[.)])")


def train(documents: DataFrame, files: DataFrame, train_docs: int = TRAIN_DOCS, train_files: int = TRAIN_FILES) -> np.ndarray:
    """Fit on a bounded sample of labelled documents and of source files; the samples follow from the ids alone."""
    least = bounded_sample(documents, "doc_id", train_docs).where("lang IS NOT NULL AND length(text) > 0")
    docs = []
    for lang, text in least.select("lang", "text").toLocalIterator():
        prose = "\n".join(x for x in text.splitlines() if len(x) > 15 and not _CODE_LINE.search(x))
        if prose:
            docs.append((lang.strip().lower(), prose))
    code = []
    some = bounded_sample(files, "file_id", train_files).where("length(content) > 0")
    for path, lang, text in some.select("file_path", "language", "content").toLocalIterator():
        if (lang := language_of(lang, path)) in SPANS:
            # code without its comments and literals; literals without blanks are code too
            code.append(SPANS[lang].sub(lambda m: m.group() if m.lastindex == 2 and not re.search(r"\s|[^\x00-\x7f]", m.group()) else "", text))
    return fit(docs, code)


def prose_shares(files: DataFrame, documents: DataFrame, train_docs: int = TRAIN_DOCS, train_files: int = TRAIN_FILES) -> DataFrame:
    """file_path, lang, letters and share for each file that parses (or has no grammar here) and each natural language
    in its comments and literals; one row for each file row, so repeated rows stay repeated.

    share is the part of all letters of the content. Null and empty contents, and languages without known comments, give
    no rows; a null path stays null; texts are segmented whole; other columns are ignored. The model is broadcast; its
    size is fixed by the letters and states.
    """
    model = files.sparkSession.sparkContext.broadcast(train(documents, files, train_docs, train_files))

    def make():
        segmenter = Segmenter(model.value)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = []
            for path, lang, text in zip(*(strings(batch, c) for c in ("file_path", "language", "content"))):
                lang = language_of(lang, path)
                if text and lang in SPANS and not (lang in GRAMMARS and syntax_errors(lang, text)):
                    own.append((path, lang, text))
            counts = segmenter.count([x[1:] for x in own])
            n, s = np.nonzero(counts[:, 1:]) if own else (np.zeros(0, int), np.zeros(0, int))
            letters = counts[n, s + 1] if own else np.zeros(0, np.int64)
            share = letters / np.array([len(own[k][2]) for k in n.tolist()] or np.zeros(0))
            cols = [pa.array([own[k][0] for k in n.tolist()], pa.string()), pa.array([LANGS[k] for k in s.tolist()], pa.string()), pa.array(letters, pa.int64()), pa.array(share, pa.float64())]
            return pa.RecordBatch.from_arrays(cols, names=["file_path", "lang", "letters", "share"])

        return run

    return map_rows(files.select("file_path", "language", "content"), make, "file_path string, lang string, letters long, share double")


def found_prose(files: DataFrame, documents: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    return prose_shares(files, documents).where(F.col("share") >= least_share).select("file_path", "lang").distinct()

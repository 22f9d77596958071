"""Abnormal perplexity alone decides about a page."""

from __future__ import annotations

import random

import numpy as np

from graphloom.llm import spam
from graphloom.llm.wordclasses import SIZE

RND = random.Random(3)
_SYLLABLES = "ba ke li mo nu pra sti vo der gan tel ri".split()
_NOUNS = ["".join(RND.choice(_SYLLABLES) for _ in range(3)) for _ in range(300)]
PROSE = "\n".join(f"The {RND.choice(_NOUNS)} {RND.choice(_NOUNS)} the {RND.choice(_NOUNS)} when it is {RND.choice(_NOUNS)}, and this is {RND.choice(['what', 'why', 'how'])} we have {RND.choice(_NOUNS)} in a {RND.choice(_NOUNS)} of {RND.choice(_NOUNS)}." for _ in range(120))
KEYS = ", ".join(["best free online parser download", "cheap code viewer price", "free graph tool"] * 30)


def model():
    known = spam.Classes()
    pages = spam.Pages(*spam.symbols([PROSE, "One more note on the cache, which is empty.\n" * 3], known))
    counts = np.bincount(pages.cells[np.repeat(pages.prose(), pages.lengths)], minlength=SIZE * SIZE * spam.SYMBOLS)
    table = spam.log_table(counts.astype(float))
    lines = pages.scores(table)[1][pages.prose()]
    return table, float(lines.min()) - 0.5, float(lines.max()) + 0.01


def test_only_the_model_decides():
    m, known = model(), spam.Classes()
    pages = spam.Pages(*spam.symbols([PROSE, KEYS, None, "", "  \n", KEYS * 50, PROSE + "\n" + "#tag " * 3], known))
    share, _ = spam.shares(pages, m)
    assert (share >= spam.SPAM_SHARE).tolist() == [False, True, False, False, False, True, False]
    assert not spam.shares(pages, (m[0], -np.inf, np.inf))[0].any()  # without bounds nothing is left


def test_a_page_is_scored_the_same_in_any_batch():
    m, texts = model(), [PROSE, KEYS, "", KEYS[:200] + "\n\n" + PROSE[:300], "a", "\n\n\n", "best tool\nbest tool\n" * 20]
    whole = spam.shares(spam.Pages(*spam.symbols(texts, spam.Classes())), m)[0]
    alone = [spam.shares(spam.Pages(*spam.symbols([t], spam.Classes())), m)[0][0] for t in texts]
    assert np.allclose(whole, alone)


def test_technical_lines_are_no_spam():
    m = model()
    table = "| metric | value |\n|---|---|\n" + "\n".join(f"| cache size | {k}81 |" for k in range(30))
    code = "```\n" + "best free parser download\n" * 40 + "```"
    assert (spam.shares(spam.Pages(*spam.symbols([table, code], spam.Classes())), m)[0] < spam.SPAM_SHARE).all()

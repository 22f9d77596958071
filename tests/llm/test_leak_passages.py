"""Passages that a hit alone must find, and openings that are no instructions."""

from __future__ import annotations

import random
import re

import numpy as np

from graphloom.llm import leaks

ITEM = [f"w{k}" for k in range(60)]


def changed(words, at):
    return " ".join("changed" if k in at else w for k, w in enumerate(words))


def test_one_unchanged_piece_is_enough():
    finder = leaks.Finder([(1, ITEM)])
    # words 1 to 25 of the item; of its pieces only 4 to 7 stands unchanged
    assert finder.found("before " + changed(ITEM[1:26], {10, 11, 18, 19}) + " after") == [1]
    assert finder.found("before " + changed(ITEM[1:26], {5, 10, 11, 15, 18, 19}) + " after") == []  # six errors
    assert finder.found("before " + " ".join(ITEM[1:21]) + " after") == []  # a short quote


def test_any_four_changes_inside():
    finder, rnd = leaks.Finder([(1, ITEM)]), random.Random(4)
    for _ in range(300):
        a = rnd.randrange(60 - 25)
        part = ITEM[a : a + 25]
        for k in sorted(rnd.sample(range(1, 24), 4), reverse=True):
            part[k : k + 1] = rnd.choice([["other"], [], [part[k], "more"]])
        assert finder.found("x y " + " ".join(part) + " z") == [1]


def test_a_mould_with_a_colon_is_no_instruction():
    stock = "Read the passage and choose the best explanation."
    texts = [f"{stock}\nTwo players alternate: " + " ".join(f"u{i}w{k}" for k in range(22)) for i in range(4)]
    texts += ["Two players alternate: " + " ".join(f"u{i}w{k}" for k in range(22)) for i in range(4, 8)]
    words = dict(leaks.passages([*enumerate(texts)]))
    assert all(w[:3] == ["two", "players", "alternate"] and len(w) == 25 for w in words.values())
    finder = leaks.Finder([*words.items()])
    assert finder.found("x y " + texts[5] + " z") == [5]


def test_a_short_opening_line_stays():
    words = dict(leaks.passages([(i, f"Two players alternate.\nrest of item {i}") for i in range(5)]))
    assert words[2] == "two players alternate rest of item 2".split()


def test_shortest_passages_with_errors_anywhere():
    finder, rnd = leaks.Finder([(1, ITEM)]), random.Random(5)
    for errors in range(5):
        hits = 0
        for _ in range(300):
            a = rnd.randrange(60 - 25 + 1)
            part = ITEM[a : a + 25]
            for k in sorted(rnd.sample(range(25), errors), reverse=True):
                part[k : k + 1] = rnd.choice([["other"], [], [part[k], "more"]])
            hits += finder.found("x y " + " ".join(part) + " z") == [1]
        assert hits >= 0.95 * 300, (errors, hits)


def test_many_copies_in_one_text():
    finder = leaks.Finder([(1, ITEM)])
    assert finder.lengths((" ".join(ITEM[3:40]) + " x y z ") * 3000) == {1: 37}
    assert finder.found((" ".join(ITEM[3:10]) + " x y z ") * 3000) == []


def test_blocks_do_not_change_the_result(spark):
    rnd = random.Random(6)
    items = [(i, f"Two players alternate in the game of stones {i}. " + " ".join(f"u{rnd.randrange(400)}" for _ in range(40))) for i in range(60)]
    docs = [(k, f"some words {k} " + " ".join(items[k % 60][1].split()[8 : 8 + 20 + k % 17])) for k in range(200)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + items[:5], "item_id long, text string")
    found = [sorted(map(tuple, leaks.leaks(d, i, block).collect())) for block in (10, 30, 20_000)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 50


def test_many_items_are_looked_at_at_once():
    """As one by one: 24 successive words of whose distinctive ones three quarters are there; shorter items never are."""
    rnd = random.Random(9)
    items = [(i, [f"w{rnd.randrange(60)}" for _ in range(rnd.choice([5, 23, 24, 30, 80]))]) for i in range(60)]
    finder = leaks.Finder(items, {" ".join(w[3:6]) for _, w in items})
    n = leaks.LEAST - leaks.EDGE
    for share in (0.5, 0.7, 0.75, 0.9):
        there = np.array([float(rnd.random() < share) for _ in finder.number] + [0.0])
        want = []
        for i, words in items:
            own = [(there[finder.number[w]] - leaks.OWN) * d for w, d in zip(words, finder.distinct[i])]
            if any(sum(own[a:b]) >= 0 for a in range(len(own)) for b in range(a + n, len(own) + 1)):
                want.append(i)
        assert finder.may([i for i, _ in items], there) == want


def test_words_of_ascii_and_other_texts():
    other = re.compile(r"[\W_]+")
    for text in ["", " _ ", "a_b\x00c\x1fd-2", "Ärger²_über ſ½ x", "snake_case\tAND\r\nmore..", "".join(map(chr, range(128))), "".join(map(chr, range(0x250)))]:
        plain = text.replace("\\", " ").replace("&", " ").replace("<", " ").replace("-", " ")
        assert leaks.normal(plain) == f" {other.sub(' ', plain.lower()).strip()} "

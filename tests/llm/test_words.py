from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from factgraph.llm import _words
from factgraph.llm.quality import Rules, measure
from factgraph.llm.substring import chosen

WORD = re.compile(r"[^\x20\x09-\x0D]+")
texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab é梦\n\t\x0b#$ ", max_size=60)), max_size=8)


@given(texts)
@settings(max_examples=60, deadline=None)
def test_words_match_the_pattern(values):
    w = _words.Words(pa.array(values, pa.string()))
    got = [[bytes(w.data[w.start[k] : w.end[k]]).decode() for k in range(w.first[i], w.first[i + 1])] for i in range(len(values))]
    assert got == [WORD.findall(v or "") for v in values]


def test_hashes_depend_on_the_word_alone():
    long = "x" * 3_000_000
    w = _words.Words(pa.array(["foo bar foo", f"{long} foo", "bar"]))
    assert w.hash[0] == w.hash[2] == w.hash[4] and w.hash[1] == w.hash[5] and w.hash[0] != w.hash[1]


@given(st.lists(st.integers(0, 12), max_size=60))
@settings(max_examples=60, deadline=None)
def test_twice_and_later(values):
    key = np.array(values, np.uint64)
    assert _words.twice(key).tolist() == [values.count(v) > 1 for v in values]
    assert _words.later(key).tolist() == [v in values[:i] for i, v in enumerate(values)]


@given(st.lists(st.integers(0, 5), min_size=6, max_size=40))
@settings(max_examples=60, deadline=None)
def test_chosen_is_the_last_least(values):
    g = np.array(values, np.uint64)
    for m in (1, 3, 5, 6):
        want = [max(range(i, i + m), key=lambda k: (-values[k], k)) for i in range(len(values) - m + 1)]
        assert chosen(g, m).tolist() == want


def brute(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}


@given(texts)
@settings(max_examples=80, deadline=None)
def test_quality_measures(values):
    got = measure(pa.array(values, pa.string()), Rules())
    for i, v in enumerate(values):
        assert {k: int(got[k][i]) for k in brute(v)} == brute(v)


def test_coverage_marks_repetition_and_leaves_clean_text():
    clean = " ".join(f"w{i}" for i in range(300))
    block = " ".join(f"v{i}" for i in range(40))
    m = measure(pa.array([clean, " ".join([block] * 2 + [f"u{i}" for i in range(60)]), "a b", None]), Rules())
    assert m["kept"].tolist() == [True, False, False, False] and m["base_failed"].tolist() == [False, True, True, True]
    assert m["cover"][0].tolist() == [0, 0, 0] and (m["cover"][1] > 0).all()

"""Winnowed decontamination against a direct count of windows."""

import random
import re

import numpy as np
import pytest

from threadloom.llm.decontaminate import decontaminate, winnow
from threadloom.llm.words import mixed

DOCS = "doc_id bigint, text string, items string, start int"
random.seed(11)
VOCABULARY = [f"w{k}" for k in range(60)] + ["É", "ünï", "42"]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    wins = {}
    for i, t, *_ in items:
        w = words_of(t)
        k = min(len(w), window)
        for p in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[p : p + k]), set()).add(None if i is None else str(i))
    for d, t, *_ in docs:
        w, hit, found = words_of(t), set(), set()
        for k in {len(x) for x in wins}:
            for p in range(len(w) - k + 1):
                if tuple(w[p : p + k]) in wins:
                    hit |= set(range(p, p + k))
                    found |= wins[tuple(w[p : p + k])]
        spans = []
        for p in sorted(hit):
            if spans and spans[-1][1] == p:
                spans[-1][1] = p + 1
            else:
                spans.append([p, p + 1])
        out.append((d, len(w), len(hit), tuple(map(tuple, spans)), tuple(sorted(found - {None})), bool(hit)))
    return sorted(out, key=repr)


def got(spark, docs, items, **options):
    df = decontaminate(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, "item_id bigint, text string, row int"), **options)
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple((s.first, s.last) for s in r.spans), tuple(r["items"]), r.contaminated) for r in df.collect()), key=repr)


def some(n):
    return " ".join(random.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def items():
    # long ones, exactly a window, shorter than one, one word, none, null, copies under other ids and under none
    texts = [some(30), some(25), some(10), some(9), some(4), "w59", "... !", None, ""]
    rows = [(k, t, k) for k, t in enumerate(texts)]
    return [*rows, (100, texts[0], 1), (None, texts[1], 1), (2, texts[2], 2), (12, some(12) + " " + texts[2], 3)]


def test_against_brute_force(spark, items):
    texts = [None, "", "?!", some(5), some(9), some(400)]
    for _, t, _ in items:
        w = (t or "").split()
        texts += [some(20) + " " + (t or "") + "\n" + some(7), (t or "").upper(), " ".join(w[1:]), some(3) + " -- " + ", ".join(w[3:15]) + " " + some(2), " ".join(w[:8]) + " zz " + " ".join(w[9:])]
    texts.append(" ".join(some(3000) if k % 2 else items[0][1] for k in range(20)))
    docs = [(k, t, "x", 1) for k, t in enumerate(texts)] + [(3, texts[7], "x", 1), (3, texts[7], "x", 1), (None, texts[6], "x", 1)]
    assert got(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("window", [1, 2, 3, 7, 10])
def test_window_lengths_and_a_full_filter(spark, items, window):
    """Every span of a window's length is found; a filter where all bits are set loses and adds nothing."""
    docs = [(k, some(60) + " " + " ".join((t or "").split()[: window + k % 3]) + " " + some(30), "x", 1) for k, (_, t, _) in enumerate(items)]
    assert got(spark, docs, items, window=window, filter_bits=64) == brute(docs, items, window)


def test_winnow_keeps_what_windows_alone_decide():
    rng = np.random.default_rng(3)
    h = mixed(rng.integers(0, 5, 500).astype(np.uint64))  # few values: many ties
    for length in range(1, 11):
        starts = np.arange(len(h) - length + 1)
        place, prints = winnow(h, starts, length)
        assert (place >= starts).all() and (place + (length + 1) // 2 <= starts + length).all()
        seen = {}
        for s in starts:
            key = tuple(h[s : s + length])
            assert seen.setdefault(key, (place[s] - s, prints[s])) == (place[s] - s, prints[s])
        if length > 2:
            assert len(set(place)) < len(starts)  # fewer fingerprints than windows


def test_empty_tables_and_hot_passage(spark, items):
    assert got(spark, [], items) == []
    docs = [(k, items[0][1], "x", 1) for k in range(50)]
    assert got(spark, docs, []) == brute(docs, [])
    same = [(k, items[0][1], 1) for k in range(40)]
    assert got(spark, docs, same) == brute(docs, same)
    with pytest.raises(ValueError):
        decontaminate(spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id bigint, text string"), filter_bits=100)


def test_plan_has_no_pairs_of_fingerprints(spark, items):
    docs = spark.createDataFrame([(1, items[0][1], "x", 1)], DOCS)
    plan = decontaminate(docs, spark.createDataFrame(items, "item_id bigint, text string, row int"))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan

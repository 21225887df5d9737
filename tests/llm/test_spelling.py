"""Spelling variants against edit distance over all pairs."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from threadloom.llm.spelling import checksums, near_pairs, spelling_variants, word_counts

DOCS = "doc_id bigint, text string, n int, word string"
random.seed(12)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def counts(docs, damage=97, letters=5, least=3):
    c = Counter()
    for i, t, *_ in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damage and h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            c[w] += len(w) >= letters
    return {w: n for w, n in c.items() if n >= least}


def variants(c, factor=2):
    near_to = {w: [] for w in c}
    for a, b in itertools.combinations(sorted(c), 2):
        if abs(len(a) - len(b)) <= 1 and near(a, b):
            near_to[a].append(b)
            near_to[b].append(a)
    form = {}
    for w, others in near_to.items():
        best = min(others, key=lambda o: (-c[o], o), default=None)
        form[w] = best if best is not None and c[best] >= factor * c[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), c[w], len(near_to[w]), c.get(form[w])) for w in c)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_counts(spark):
    base = ["Étéöß" + "a" * k for k in range(9)] + ["hello", "HELLO", "wörld", "naïve", "x" * 300, "abc÷×def", "plain"]
    texts = [None, "", "1 2 3", *[" ".join(random.choices(base, k=80)) for _ in range(60)], "q" * 5000 + " ﬀ éclat́ " * 3, "long " * 40000]
    docs = [(k, t, 1, "x") for k, t in enumerate(texts)] + [(4, texts[4], 1, "x"), (None, texts[5], 1, "x")]
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    for damage in (97, 3, 1, None):
        assert dict(rows_of(word_counts(frame, damage=damage))) == counts(docs, damage)
    assert dict(rows_of(word_counts(frame, letters=1, count=1, damage=2))) == {w: n for w, n in counts(docs, 2, 1, 1).items() if w}


def test_checksums_of_spans():
    flat = np.frombuffer(bytes(random.randrange(256) for _ in range(3000)), np.uint8)
    starts = np.array([0, 5, 5, 100, 200, 1000, 7])
    ends = np.array([5, 5, 6, 163, 264, 2990, 72])
    heads = np.array([zlib.crc32(b"%d:" % k) for k in range(7)], np.uint32)
    want = [zlib.crc32(flat[s:e].tobytes(), int(h)) for h, s, e in zip(heads, starts, ends, strict=True)]
    assert checksums(heads, flat, starts, ends).tolist() == want


def edits(w, letters):
    k = random.randrange(len(w))
    return random.choice([w[:k] + w[k + 1 :], w[:k] + random.choice(letters) + w[k:], w[:k] + random.choice(letters) + w[k + 1 :], w + random.choice(letters), random.choice(letters) + w])


@pytest.mark.parametrize("letters", ["ab", "abcé", "abcdefghijklmnopqrstuvwxyzàÿ"])
def test_variants_against_all_pairs(spark, letters):
    words = set()
    while len(words) < 250:
        w = "".join(random.choices(letters, k=random.randrange(5, 12)))
        words |= {w, *(edits(w, letters) for _ in range(3))}
    c = {w: random.choice([3, 3, 4, 6, 8, 16, 40, 90]) for w in words if len(w) >= 5}
    frame = spark.createDataFrame(list(c.items()), "word string, n bigint").repartition(3)
    assert rows_of(spelling_variants(frame)) == variants(c)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("aabbcé", min_size=4, max_size=9), min_size=2, max_size=60, unique=True))
def test_no_near_pair_is_lost(spark, words):
    """Repeated bigrams, ties of frequency and edits at either end."""
    found = {(r.one, r.other) for r in near_pairs(spark.createDataFrame([(w, 3) for w in words], "word string, n bigint")).collect()}
    assert found == {(a, b) for a, b in itertools.combinations(sorted(words), 2) if near(a, b)}


def test_chain_of_forms_star_and_empty(spark):
    chain = ["aaaaa" + "b" * k for k in range(12)]
    c = {w: 3 * 2**k for k, w in enumerate(chain)}
    c |= {"zzzzzz" + x: 5 for x in "abcdefghijklmnopqrstuvwxy"} | {"zzzzzz": 1000} | {"y" * 40000: 3, "y" * 40001: 6, "y" * 39990 + "x" + "y" * 9: 20, "é" + "y" * 40000: 3, "y" * 20000 + "zz" + "y" * 19999: 9}
    assert rows_of(spelling_variants(spark.createDataFrame(list(c.items()), "word string, n bigint"))) == variants(c)
    assert rows_of(spelling_variants(spark.createDataFrame([], "word string, n bigint"))) == []
    assert rows_of(spelling_variants(word_counts(spark.createDataFrame([], DOCS)))) == []

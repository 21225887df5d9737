"""Overlaps of ranges of very different lengths, words in common, and the largest counts, by hand."""

import random
from collections import Counter

from threadloom.operators.archive import top_counts
from threadloom.operators.storage import overlap_pairs
from threadloom.plans.texts import shared_words

random.seed(7)


def test_overlaps_of_all_lengths(spark):
    """One range of ten million among short ones, single points, negative starts, a range turned round, a null."""
    rows = [("a", k, s, s + random.choice([0, 0, 1, 3, 9, 40])) for k, s in enumerate(random.randrange(-60, 200) for _ in range(120))]
    rows += [("a", 900, -100, 9_999_900), ("a", 901, 5, 2), ("a", 902, None, 3), ("a", 903, 10_000, 2_000_000), ("b", 904, 0, 9), ("b", 905, 0, 9), ("c", 906, 1, 1)]
    got = {tuple(r) for r in overlap_pairs(spark.createDataFrame(rows, "session_id string, block_id bigint, block_range_start bigint, block_range_end bigint")).collect()}
    want = set()
    for s, i, a, b in rows:
        for t, j, c, d in rows:
            if s == t and i < j and None not in (a, c) and a <= b and c <= d and (o := min(b, d) - max(a, c) + 1) > 0 and 5 * o >= 4 * min(b - a + 1, d - c + 1):
                want.add((s, i, j))
    assert got == want and ("a", 5, 900) in got


def test_a_long_range_does_not_widen_the_tiles(spark):
    """Short ranges far apart never meet, whatever else the session holds: joined rows stay few."""
    rows = [("a", k, 100 * k, 100 * k + 7) for k in range(400)] + [("a", 9999, 0, 10_000_000)]
    plan = overlap_pairs(spark.createDataFrame(rows, "session_id string, block_id bigint, block_range_start bigint, block_range_end bigint"))
    assert plan.count() == 400
    assert "CartesianProduct" not in plan._jdf.queryExecution().executedPlan().toString()


def test_shared_words(spark):
    words = [f"w{k}" for k in range(30)]
    items = {k: set(random.sample(words, random.randrange(0, 14))) for k in range(25)}
    docs = {k: set(random.choices(words, [1 / (j + 1) for j in range(30)], k=random.randrange(0, 40))) for k in range(60)}
    frame = lambda sets, name: spark.createDataFrame([(k, w) for k, s in sets.items() for w in s], f"{name} int, w string")
    for least in (1, 2, 5, 8):
        got = {tuple(r) for r in shared_words(frame(items, "item_id"), frame(docs, "doc_id"), least).collect()}
        assert got == {(i, d, len(a & b)) for i, a in items.items() for d, b in docs.items() if len(a & b) >= least}


def test_top_counts(spark):
    rows = [(s, random.choice("abcdefghij"[: 3 + 4 * (s % 3)])) for s in range(4) for _ in range(60)]
    counts = Counter(rows)
    got = dict(map(tuple, top_counts(spark.createDataFrame([(*k, n) for k, n in counts.items()], "source int, key string, n bigint"), "source").collect()))
    for s in range(4):
        mine = sorted(((-n, k) for (t, k), n in counts.items() if t == s))
        want = ", ".join(f"{k}({-n})" for n, k in mine[:5]) + (f", +{len(mine) - 5} more" if len(mine) > 5 else "")
        assert got[s] == want

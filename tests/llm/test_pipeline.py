"""The pipeline on the small tables: every stage works on what the one before kept, and its decisions take effect."""

import itertools
import re

import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F

from threadloom.llm.mixing import mix_sources
from threadloom.llm.quality import fit_quality, score_quality


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    text = {r.doc_id: r.text for r in docs.collect()}
    seen = [set(text)]
    for name, stage in C.STAGES:
        docs = C.kept_table(stage(spark, docs, sf), name.replace(" ", "-"))
        if name != C.STAGES[-1][0]:
            assert docs.columns == columns
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert seen[-1] <= seen[-2]
        if name == "exact copies":
            assert len({text[i] for i in seen[-1]}) == len(seen[-1]) == len({text[i] for i in seen[-2]})
    weights = fit_quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r.doc_id for r in score_quality(spark.read.parquet(f"{sf}/documents.parquet"), weights).filter("kept").collect()}
    assert seen[1] == kept
    assert seen[3] and seen[4] and seen[5] == seen[4]
    assert docs.filter("not exact").count() == 0


EXTRA = "doc_id bigint, text string, lang string, source string, n_chars bigint, whole string, id string, row bigint, digest string, own double, want int, have int, check int, size int, host string"


@pytest.fixture(scope="module")
def edges(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with the stages' own names."""
    words = [f"word{k % 97}x{k % 89}" for k in range(200_000)]
    plain = "The plain text of a clean document says one thing after another and then it ends. "
    texts = [None, "", " ".join(words), " ".join([*words[:-3], "an", "other", "end"]), plain * 3, plain * 3, plain * 3 + "Not quite.", "one"]
    rows = [(k, t, "en", f"s{k % 2}", 1, "a", "b", 2, "c", 0.5, 3, 4, 5, 6, "h") for k, t in enumerate(texts)]
    rows += [rows[4]] * 3 + [(*(None,) * 15,)] * 2 + [(None, plain * 3, None, None, None, *("x", "y"), *(None,) * 8), (9, plain + "Of its own, with words of its own.", None, None, *(None,) * 11)]
    return spark.createDataFrame(rows, EXTRA).repartition(3)


@pytest.mark.parametrize("name", [n for n, _ in C.STAGES])
def test_stage_on_edges(spark, sf, edges, name):
    stage = dict(C.STAGES)[name]
    out = stage(spark, edges, sf)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    before, after = [tuple(r) for r in edges.collect()], [tuple(r) for r in out.collect()]
    assert stage(spark, edges.filter("false"), sf).count() == 0
    if name == "pieces":
        assert len(after) == len(before) and all(r.exact for r in out.select("exact").collect())
        return
    assert out.columns == edges.columns and {key(r) for r in after} <= {key(r) for r in before}
    texts = [r[1] or "" for r in after]
    if name == "exact copies":
        assert sorted(texts) == sorted({r[1] or "" for r in before})
        assert max(r[0] for r in after if r[1] == edges.filter("doc_id = 4").first().text) == 5
    if name == "near copies":
        ids = [r[0] for r in after]
        assert sorted(ids, key=str) == sorted([0, 2, 4, 7, 9], key=str)
    if name == "mixture":
        assert {r[3] for r in after if r[1]} == {"s0", "s1", None}


def test_run_is_what_the_stages_give(spark, sf):
    """run() against its parts by other means: exact copies and near copies by brute force on what quality keeps."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [(r.doc_id, r.text or "") for r in dict(C.STAGES)["quality"](spark, docs, sf).collect()]
    last = {}
    for i, t in sorted(kept):
        last[t] = i
    left = {i: t for t, i in last.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in ((i, re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", t.lower())) for i, t in left.items())}
    root = {i: i for i in left}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(sorted(left), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    roots = {find(i) for i in left}
    got = {}
    for r in C.run(spark, sf).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    mixed = {r.doc_id: r.epochs for r in mix_sources(docs.filter(F.col("doc_id").isin(*roots))).collect() if r.epochs}
    assert got == mixed


def test_run(spark, sf):
    out = C.run(spark, sf)
    assert out.columns[0] == "doc_id" and out.count() > 0

"""The corpus operators against brute force on small fixtures, and on the edge cases their docstrings define."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import pieces as P
from threadloom.llm.embedding_join import embedding_join
from threadloom.llm.exact_dedup import drop_exact_copies, exact_dedup
from threadloom.llm.language_id import fit_language, predict_language, windows_of
from threadloom.llm.mixing import mix_sources, mixed_documents
from threadloom.llm.ngram_join import drop_near_copies, ngram_join, recall, stop_of
from threadloom.llm.quality import fit_quality, host_of, keep_quality, path_of, score_quality
from threadloom.llm.sharding import quotas, shard_documents
from threadloom.llm.token_counts import encoded_lengths, length_histogram, length_quantiles, truncated_totals
from threadloom.llm.toxicity import ToxicityModel, fit_toxicity, segments, toxic_passages

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
rng = np.random.default_rng(5)
WORDS = ["w" + "".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]


def sentence(n):
    return " ".join(rng.choice(WORDS, n))


def changed(text, places):
    w = text.split()
    for p in places:
        w[p] = "zz" + str(p)
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus(spark):
    """Nulls, empty and long texts, copies, near copies, a hot group, short texts, an extra column with a name of the operators' own."""
    long = sentence(6000)
    base = [sentence(80) for _ in range(6)]
    texts = [None, "", "", "one two", "One, two!", long, changed(long, [10, 4000]), *base, *(changed(b, [40]) for b in base), *(changed(base[0], [k]) for k in range(3, 78, 5)), *[base[1]] * 9, "ünï çødé ﬀ 😀"]
    rows = [(i, t, "en", None if i % 7 == 6 else f"s{i % 3}", len(t or ""), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA + ", row string").withColumn("copies", F.lit(1)).repartition(3)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- exact dedup


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(corpus, keep):
    docs = [(r.doc_id, r.text or "") for r in corpus.collect()]
    groups = {}
    for i, t in docs:
        groups.setdefault(t, []).append(i)
    pick = max if keep == "largest" else min
    want = sorted((i, pick(groups[t]), len(groups[t]), i == pick(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in docs)
    assert rows_of(exact_dedup(corpus, keep=keep, partitions=9, radix=3)) == want
    assert sorted(r.doc_id for r in drop_exact_copies(corpus, keep=keep).collect()) == sorted(pick(g) for g in groups.values())


def test_exact_dedup_repeats_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "c"), (2, "d")], "doc_id bigint, text string")
    got = exact_dedup(docs).collect()
    assert sum(r.kept for r in got) == 4 and {r.group_size for r in got if r.doc_id == 1} == {3}
    assert sum(r.kept for r in got if r.doc_id == 1) == 1
    kept = drop_exact_copies(docs)
    assert rows_of(kept.filter("doc_id is not null")) == [(1, "a"), (2, "c"), (2, "d")] and kept.count() == 4


def test_exact_dedup_empty(empty):
    assert exact_dedup(empty).count() == 0


# --- n-gram join


def shingle_sets(docs, size=5):
    out = {}
    for i, t in docs:
        w = re.findall(r"[0-9a-z_\u0080-\U0010ffff]+", (t or "").lower())
        out[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    return out


def test_ngram_join(corpus):
    docs = {r.doc_id: r.text for r in corpus.collect()}
    sets = shingle_sets(docs.items())
    near = {i: set() for i in docs}
    for a, b in itertools.combinations(docs, 2):
        same = (docs[a] or "") == (docs[b] or "")
        both = sets[a] & sets[b]
        if same or (both and len(both) >= 0.8 * len(sets[a] | sets[b]) - 1e-9):
            near[a].add(b), near[b].add(a)
    root = {i: i for i in docs}
    for _ in docs:
        root = {i: min([root[i], *(root[j] for j in near[i])]) for i in docs}
    got = {r.doc_id: r for r in ngram_join(corpus).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: len(near[i]) for i in docs}
    assert {i: r.class_id for i, r in got.items()} == root
    assert {i for i, r in got.items() if r.kept} == set(root.values())
    assert sorted(r.doc_id for r in drop_near_copies(corpus).collect()) == sorted(set(root.values()))


def test_ngram_join_blocks(corpus, monkeypatch):
    """Nodes and components cut into small blocks give the same."""
    import threadloom.llm.ngram_join as N

    want = rows_of(ngram_join(corpus))
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "GATHER", 4)
    assert rows_of(ngram_join(corpus)) == want


def test_ngram_recall_target():
    p = stop_of(0.8, 16, 8, 0.995)
    assert recall(0.8, 16, p) >= 0.995 > recall(0.8, 16, p + 1)


def test_walk():
    """Whatever agrees as linked sets do is connected by ties, whoever covers it; covered members are no leaders."""
    from threadloom.llm.grouping import local_roots
    from threadloom.llm.ngram_join import walk

    r = np.random.default_rng(8)
    for _ in range(40):
        sig = []
        for _ in range(int(r.integers(1, 6))):
            base = r.integers(0, 60000, 128)
            for _ in range(int(r.integers(1, 9))):
                one = base.copy()
                some = r.random(128) < r.choice([0.02, 0.1, 0.25])
                one[some] = r.integers(0, 60000, int(some.sum()))
                sig.append(one)
        sig = np.array(sig, np.uint16)[r.permutation(len(sig))]
        if len(sig) < 2:
            continue
        open_, a, b = walk(sig, sig[:, 5:8], 0.8, 0.5)
        root = local_roots(len(sig), a, b)
        alike = (sig[:, None] == sig[None]).mean(axis=2)
        linked = np.argwhere(alike >= 0.8)
        assert (root[linked[:, 0]] == root[linked[:, 1]]).all() and open_.any()
        assert all((alike[k][open_] >= 0.5).any() for k in np.flatnonzero(~open_))


@pytest.mark.parametrize("gather", [1024, 8])
def test_ngram_recall_in_crowded_parts(spark, monkeypatch, gather):
    """Pairs at 0.80 to 0.85 in families that share most shingles, in parts of the trie far over what is gathered at once."""
    import threadloom.llm.ngram_join as N

    monkeypatch.setattr(N, "GATHER", gather)
    r = np.random.default_rng(12)
    docs, pairs = [], []
    for _ in range(6):
        base = list(r.choice(WORDS, 300))
        for _ in range(40):
            t = list(base)
            for p in r.choice(300, 14, replace=False):  # members of a family: about 0.6 to 0.7 with one another
                t[p] = "q" + str(r.integers(10**6))
            docs.append((len(docs), " ".join(t)))
        for _ in range(10):
            i = int(r.integers(len(docs) - 40, len(docs)))
            t = docs[i][1].split()
            for p in np.linspace(20, 280, 6).astype(int):
                t[p] = "z" + str(r.integers(10**6))
            pairs.append((i, len(docs)))
            docs.append((len(docs), " ".join(t)))
    sets = shingle_sets(docs)
    want = {p for p in pairs if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])}
    assert len(want) >= 40
    got = {x.doc_id: x.class_id for x in ngram_join(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert np.mean([got[a] == got[b] for a, b in want]) >= 0.98


def test_ngram_join_empty_and_repeats(spark, empty):
    assert ngram_join(empty).count() == 0
    t = sentence(30)
    docs = spark.createDataFrame([(1, t), (1, t), (None, t), (2, changed(t, [0]))], "doc_id bigint, text string")
    got = ngram_join(docs).collect()
    assert sum(r.kept for r in got) == 1 and {r.class_id for r in got} == {1} and drop_near_copies(docs).count() == 1


# --- embeddings


def test_embedding_join(spark):
    x = rng.standard_normal((300, 20))
    x[50:80] = x[50] + 0.05 * rng.standard_normal((30, 20))
    x[100:110] = x[100]
    x[120] = 3 * x[121]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (901, [0.0] * 20), (902, [float("nan")] * 20), (903, [1.0, None] * 10), (904, [1.0] * 3), (905, []), (906, [float("inf")] * 20), (None, x[0].tolist())]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>").repartition(3)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T) >= 0.95
    np.fill_diagonal(near, False)
    root = np.arange(300)
    for _ in range(50):
        root = np.minimum(root, np.where(near, root[None], 10**6).min(axis=1))
    for leaf in (8192, 40):
        got = {r.vec_id: r for r in embedding_join(df, leaf=leaf).collect()}
        assert [got[i].n_links for i in range(300)] == near.sum(axis=1).tolist()
        assert [got[i].component_id for i in range(300)] == root.tolist()
        assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i, _ in bad[:-1]) and got[None].component_id is None


def test_full_leaves_are_split(spark, monkeypatch):
    """Cuts from a sample far below the leaves: results are those of brute force, and no part of a leaf holds over four times the mean."""
    from threadloom.llm import embedding_join as E

    r = np.random.default_rng(8)
    x = r.standard_normal((1500, 32)) * np.r_[np.ones(2) * 4, np.ones(30) * 0.05] + 3.0  # all near one direction: leaves can't tell them apart
    x[:40] = x[40:80] + r.standard_normal((40, 32)) * 0.001
    monkeypatch.setattr(E, "SAMPLE", 24)
    monkeypatch.setattr(E, "PER_LEAF", 0)
    seen = []
    real = E._parted
    monkeypatch.setattr(E, "_parted", lambda dealt, full: seen.append(real(dealt, full)) or seen[-1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(3)
    got = {t.vec_id: t.n_links for t in E.embedding_join(df, leaf=16, threshold=0.999).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert got == dict(enumerate(((unit @ unit.T >= 0.999).sum(axis=1) - 1).tolist()))
    loads = [t.n for t in seen[0].filter("not visitor").groupBy("task").agg(F.count("*").alias("n")).collect()]
    assert max(loads) <= 4 * max(16, np.mean(loads)) and sum(loads) == 2 * 1500


def test_embedding_join_lengths(spark):
    x = {d: rng.standard_normal((40, d)) for d in (3, 9, 20)}
    for v in x.values():
        v[10:20] = v[10] + 0.01 * rng.standard_normal((10, v.shape[1]))
        v[25] = v[26]
    rows = [(1000 * d + i, v.tolist()) for d in x for i, v in enumerate(x[d])] + [(7, [1.0] * 5)]
    for leaf in (8192, 10):
        got = {r.vec_id: r for r in embedding_join(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), leaf=leaf).collect()}
        assert len(got) == len(rows) and got[7].n_links == 0 and got[7].kept
        for d, v in x.items():
            u = v / np.linalg.norm(v, axis=1)[:, None]
            near = (u @ u.T) >= 0.95
            np.fill_diagonal(near, False)
            root = np.arange(len(v))
            for _ in range(50):
                root = np.minimum(root, np.where(near, root[None], 10**6).min(axis=1))
            assert [got[1000 * d + i].n_links for i in range(len(v))] == near.sum(axis=1).tolist()
            assert [got[1000 * d + i].component_id - 1000 * d for i in range(len(v))] == root.tolist()


def test_leaves_within():
    """Each leaf that holds a vector near enough is visited, whatever the cuts."""
    from threadloom.llm.embedding_join import cuts_of, leaves_within

    x = rng.standard_normal((500, 4))
    tree = cuts_of(x, 5)
    own, at, leaf = leaves_within(x, tree, 0.3)
    visits = set(zip(at.tolist(), leaf.tolist(), strict=True))
    gap = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for i, j in np.argwhere(gap <= 0.3).tolist():
        assert own[i] >= own[j] or (i, own[j]) in visits
    assert len(visits) < 500 * 31 / 4 and np.bincount(own).max() < 30


def test_embedding_join_extremes(spark):
    """Components whose squares overflow or vanish, a repeated id with two vectors, extra columns with the operator's own names."""
    rows = [(1, [1e200, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1e-200, 1e-210, 0.0]), (4, [0.0, 1.0, 0.0]), (5, [0.0, 0.0, 1.0]), (5, [1.0, 1e-3, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("n_links", F.lit("x")).withColumn("root", F.lit(7)).withColumn("e", F.lit(7))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_join(df).collect())
    assert got == [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (4, 0, 4, True), (5, 0, 5, True), (5, 3, 1, False)]


def test_embedding_join_empty(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert embedding_join(df).count() == 0


# --- toxicity


def brute_segments(values):
    """Maximal scoring subsequences: recursively the best one, then left and right of it."""
    best, at = 0.0, None
    for i in range(len(values)):
        s = 0.0
        for j in range(i, len(values)):
            s += values[j]
            if s > best + 1e-12:
                best, at = s, (i, j)
    if at is None:
        return []
    i, j = at
    left, right = brute_segments(values[:i]), brute_segments(values[j + 1 :])
    return [*left, (i, j, best), *((a + j + 1, b + j + 1, s) for a, b, s in right)]


def test_segments():
    for _ in range(300):
        hit = rng.random(rng.integers(1, 25)) < 0.4
        score = np.where(hit, rng.integers(1, 8, len(hit)) + rng.random(len(hit)), -0.9)
        at = np.flatnonzero(hit)
        got = [(int(at[a]), int(at[b]), round(s, 6)) for a, b, s in segments(score[at], np.diff(np.r_[-1, at]) - 1, 0.9)]
        assert got == [(a, b, round(s, 6)) for a, b, s in brute_segments(score.tolist())]


def test_toxicity(spark, empty):
    docs, labels = [], []
    for i in range(600):
        w = sentence(60).split()
        if i % 6 == 0:
            for p in rng.choice(60, 6, replace=False):
                w[p] = str(rng.choice(["vileword", "nastyone", "gruesomely"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 6 == 0)))
    docs += [(1000, None), (1001, "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id bigint, toxic int")
    model = fit_toxicity(d, lab.filter("doc_id % 5 <> 0 or doc_id is null"))
    got = {r.doc_id: r for r in toxic_passages(d, model).collect()}
    right = [(got[i].score >= 0.5) == bool(t) for i, t in labels if i % 5 == 0]
    assert np.mean(right) > 0.97 and got[6].passages and 0 <= got[1000].score == got[1001].score < 0.5
    assert toxic_passages(empty, ToxicityModel()).count() == 0
    assert fit_toxicity(empty, lab.filter("false")).weights[0] < 0


# --- quality



def test_quality(spark, empty):
    good = [(i, sentence(50).capitalize() + ".", "en", f"h{i % 4}", 0) for i in range(200)]
    bad = [(200 + i, " ".join(w + "$$$" for w in sentence(50).upper().split()), "en", f"h{i % 4}", 0) for i in range(60)]
    d = spark.createDataFrame([*good, *bad, (900, None, None, None, 0), (901, "", "en", "sparse.org/a", 0)], SCHEMA)
    lab = spark.createDataFrame([(i, int(i < 200)) for i in range(0, 260, 2)], "doc_id bigint, quality int")
    w = fit_quality(d, lab)
    got = {r.doc_id: r for r in score_quality(d, w).collect()}
    assert len(got) == 262 and all(got[i].kept for i in range(200)) and not any(got[i].kept for i in range(200, 260))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.doc_id for r in keep_quality(d, w).collect()} == {i for i, r in got.items() if r.kept} and keep_quality(d, w).columns == d.columns
    assert score_quality(empty, w).count() == 0
    assert np.count_nonzero(fit_quality(d, lab.filter("quality = 1"))) == 1
    one = spark.createDataFrame([("https://A.org/x/y",), (None,), ("src1",)], "s string").select(host_of(F.col("s")).alias("h"), path_of(F.col("s"), F.lit("en")).alias("p"))
    assert rows_of(one) == [("", "en"), ("a.org", "x"), ("src1", "en")]


def brute_rates(rows):
    """site_rates by hand: {(host, path): (host_rate, path_rate)}, and for each row its path's rate without its own score."""
    n = len(rows)
    rate = min(max(sum(o for *_, o in rows) / n, 0.001), 0.999)
    noise = sum(o * o for *_, o in rows) / n - (sum(o for *_, o in rows) / n) ** 2
    paths, hosts = {}, {}
    for h, p, o in rows:
        paths.setdefault((h, p), []).append(o), hosts.setdefault(h, []).append(o)
    strength = lambda spread, groups: min(max(rate * (1 - rate) / max(spread - noise * groups / n, 1e-9) - 1, 1.0), 1e6)
    a = strength(sum(len(x) * (np.mean(x) - rate) ** 2 for x in hosts.values()) / n, len(hosts))
    host = {h: (sum(x) + a * rate) / (len(x) + a) for h, x in hosts.items()}
    b = strength(sum(len(x) * (np.mean(x) - host[h]) ** 2 for (h, _), x in paths.items()) / n, len(paths))
    path = {k: (host[k[0]], (sum(x) + b * host[k[0]]) / (len(x) + b)) for k, x in paths.items()}
    others = []
    for h, p, o in rows:
        up = (sum(hosts[h]) - o + a * rate) / (len(hosts[h]) - 1 + a)
        others.append((sum(paths[h, p]) - o + b * up) / (len(paths[h, p]) - 1 + b))
    return path, others, rate


def test_site_rates_by_hand(spark):
    from threadloom.llm.quality import posterior, site_rates, without_own

    r = np.random.default_rng(4)
    rows = [(f"h{h}", f"p{p}", float(np.clip(r.normal(0.3 + 0.06 * h + 0.05 * p, 0.1), 0.01, 0.99))) for h in range(8) for p in range(3) for _ in range(int(r.integers(1, 30)))]
    d = spark.createDataFrame(rows, "host string, path string, own double").repartition(5)
    rates = site_rates(d)
    path, others, rate = brute_rates(rows)
    got = {(x.host, x.path): x for x in rates.collect()}
    assert all(math.isclose(got[k].host_rate, v[0], rel_tol=1e-9) and math.isclose(got[k].path_rate, v[1], rel_tol=1e-9) for k, v in path.items())
    odds = lambda p: math.log(p / (1 - p))
    want = sorted(1 / (1 + math.exp(-(odds(o) + odds(q) - odds(rate)))) for (*_, o), q in zip(rows, others, strict=True))
    score = d.join(rates, ["host", "path"]).select(posterior(F.col("own"), without_own(F.col("own")), F.col("global_rate")).alias("s"))
    assert np.allclose(sorted(x.s for x in score.collect()), want, rtol=1e-9)


def test_sites_decide_doubtful_documents(spark):
    """One doubtful text is kept on a good site and goes on a bad one; alone on its site it stays what it is."""
    from threadloom.llm import quality as Q

    good, bad = sentence(50).capitalize() + ".", " ".join(w + "$$$" for w in sentence(50).upper().split())
    half = " ".join([*good.split()[:25], *bad.split()[:25]])
    rows = [(i, good, "en", "fine.org", 0) for i in range(60)] + [(100 + i, bad, "en", "junk.org", 0) for i in range(60)] + [(200, half, "en", "fine.org", 0), (201, half, "en", "junk.org", 0), (202, half, "en", "lone.org", 0)]
    d = spark.createDataFrame(rows, SCHEMA)
    lab = spark.createDataFrame([(i, int(i < 100)) for i in (*range(30), *range(100, 130))], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in Q.score_quality(d, Q.fit_quality(d, lab)).collect()}
    assert got[200].own_score == got[201].own_score and got[200].score > got[202].score > got[201].score
    assert abs(got[202].score - got[202].own_score) < 0.05


def test_site_rates_shrink(spark):
    """Sparse hosts move to the global rate more than hosts with many documents of the same mean."""
    from threadloom.llm.quality import site_rates

    rows = [("big", "p", 0.1 + 0.01 * (k % 3)) for k in range(300)] + [("small", "p", 0.1)] + [(f"h{k % 10}", "p", 0.9 - 0.01 * (k % 5)) for k in range(600)]
    got = {r.host: r for r in site_rates(spark.createDataFrame(rows, "host string, path string, own double")).collect()}
    assert got["big"].path_rate < got["small"].path_rate < got["small"].global_rate


# --- language


def test_language(spark, empty):
    letters = {"aa": "abcdefgh", "bb": "mnopqrst"}
    docs = [(i, " ".join("".join(rng.choice(list(letters["aa" if i % 2 else "bb"]), 6)) for _ in range(20)), "aa" if i % 2 else "bb", "s", 0) for i in range(240)]
    d = spark.createDataFrame([*docs, (900, None, "aa", "s", 0), (901, "12 34!", None, "s", 0), (902, "", "bb", "s", 0), (903, "x" * 5000, None, "s", 0)], SCHEMA)
    net = fit_language(d.filter("doc_id < 160"))
    got = {r.doc_id: r for r in predict_language(d, net).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang, *_ in docs[160:]]) > 0.97
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and all(0 <= r.score <= 1 for r in got.values())
    assert fit_language(empty) is None and {r.lang_pred for r in predict_language(d, None).collect()} == {"und"} and predict_language(empty, net).count() == 0


def test_windows_cover_all_bytes():
    w, first = windows_of(pa.array(["", "é" * 100, None, "b" * 300]))
    assert first.tolist() == [0, 0, 2, 2, 5] and w[:2].tobytes().rstrip(b"\0") == ("é" * 100).encode() and w[2:].tobytes().rstrip(b"\0") == b"b" * 300


def plain_loss(net, window, label):
    """One window through the network with plain loops."""
    from threadloom.llm.language_id import FILTERS, WIDTHS

    e = net.embed.shape[1]
    padded = [*window, *[0] * (max(WIDTHS) - 1)]
    pooled = []
    for f in range(net.filters.shape[1]):
        width = WIDTHS[f // FILTERS]
        answers = [sum(net.embed[padded[at + k], j] * net.filters[k * e + j, f] for k in range(width) for j in range(e)) for at in range(len(window))]
        pooled.append(max(max(answers) + net.bias[f], 0))
    z = [sum(p * net.out[f, c] for f, p in enumerate(pooled)) + net.shift[c] for c in range(len(net.labels))]
    total = sum(math.exp(x) for x in z)
    return [math.exp(x) / total for x in z], -math.log(math.exp(z[label]) / total)


def test_network_by_hand():
    """Probabilities by plain loops, derivatives by small steps."""
    from threadloom.llm.language_id import ByteNetwork, gradients, mask_of

    r = np.random.default_rng(1)
    mask = mask_of()
    net = ByteNetwork(["a", "b", "c"], r.normal(0, 0.5, (256, 6)), r.normal(0, 0.3, mask.shape) * mask, r.normal(0, 0.1, mask.shape[1]), r.normal(0, 0.2, (mask.shape[1], 3)), r.normal(0, 0.1, 3))
    windows, labels = r.integers(97, 105, (4, 12)).astype(np.uint8), np.array([0, 1, 2, 1])
    by_hand = [plain_loss(net, w, y) for w, y in zip(windows.tolist(), labels.tolist(), strict=True)]
    assert np.allclose(net.probabilities(windows), [p for p, _ in by_hand], atol=1e-5)
    loss, g = gradients(net, windows, labels, mask)
    assert math.isclose(loss, np.mean([x for _, x in by_hand]), rel_tol=1e-9)
    for name in ("embed", "filters", "bias", "out", "shift"):
        array = getattr(net, name)
        strong = np.argsort(-np.abs(g[name]).ravel())[:6]
        for k in strong:
            at = np.unravel_index(k, array.shape)
            was = array[at]
            array[at] = was + 1e-6
            up, _ = gradients(net, windows, labels, mask)
            array[at] = was - 1e-6
            down, _ = gradients(net, windows, labels, mask)
            array[at] = was
            assert math.isclose((up - down) / 2e-6, g[name][at], rel_tol=1e-3, abs_tol=1e-7)
    assert not (g["filters"] * (1 - mask)).any()


def test_language_layout(spark):
    """The same network from any layout; windows from whole texts."""
    docs = [(i, ("qu " if i % 2 else "zz ") * (40 + 9 * i), "aa" if i % 2 else "bb", "s", 0) for i in range(60)]
    d = spark.createDataFrame(docs, SCHEMA)
    one, two = fit_language(d.repartition(7)), fit_language(d.repartition(2, "text"))
    assert all(np.array_equal(getattr(one, k), getattr(two, k)) for k in ("embed", "filters", "bias", "out", "shift"))


# --- pieces


@pytest.fixture(scope="module")
def toy():
    names = [b" ", b"a", b"b", b" a", b"ab", b" ab", b"ba", b"aba", b"bb", b"  "]
    return P.Lattice([(n, -float(k % 4) - 1, 300 + k) for k, n in enumerate(names)], np.arange(256, dtype=np.int32))


def all_paths(lat, data):
    piece = {lat.bytes[lat.at[i] : lat.at[i + 1]].tobytes(): (i, s) for i, s in zip(lat.ids.tolist(), lat.scores.tolist(), strict=True)}
    out = []

    def grow(at, score, ids):
        if at == len(data):
            out.append((score, ids))
            return
        for end in range(at + 1, min(len(data), at + 4) + 1):
            if data[at:end] in piece:
                i, s = piece[data[at:end]]
                grow(end, score + s, (*ids, i))
        if data[at : at + 1] not in piece:
            grow(at + 1, score + lat.byte_score, (*ids, data[at]))

    grow(0, 0.0, ())
    return sorted(out, key=lambda x: -x[0])


def test_n_best(toy):
    for _ in range(150):
        text = "".join(rng.choice(list("ab c"), rng.integers(1, 9)))
        want = all_paths(toy, (" " + text).encode())
        ids, at, best, ways, chunk_at, padded, bounds = P.encode_batch(toy, pa.array([text]), 6)
        scores = [s for s, _ in ways[0]]
        assert scores == [s for s, _ in want[: len(scores)]] and len(scores) == min(6, len(want)) and best[0] == want[0][0]
        full = [tuple(P.n_best_ids(ids, at[0], at[1], c, chunk_at).tolist()) for _, c in ways[0]]
        known = {i: s for s, i in want}
        assert len(set(full)) == len(full) and [known[x] for x in full] == scores


def test_round_trip(spark):
    texts = ["Hello  world\nfoo ▁ bar", "", None, " lead", "naïve 😀\t\tx", "a" * 5000, "  ", "\n"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    e = P.encode_pieces(d, all_ids=True)
    got = {r.doc_id: r for r in e.withColumn("back", P.decode_pieces(F.col("ids"))).withColumn("others", F.transform("n_best_ids", lambda x: x)).collect()}
    for i, t in enumerate(texts):
        assert got[i].back == (t or "") and got[i].exact and got[i].n_pieces == len(got[i].ids)
        assert [len(x) for x in got[i].n_best_ids] == got[i].n_best_sizes and len(got[i].n_best_scores) == len(got[i].n_best_sizes)
        assert got[i].n_best_scores == sorted(got[i].n_best_scores, reverse=True)
    assert spark.createDataFrame([(None,), ([99999, -1],)], "ids array<int>").select(P.decode_pieces(F.col("ids")).alias("t")).collect() == [(None,), ("",)]


# --- mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(order)}
    full, left = set(), 1.5 * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        level = left / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] > 2 * sizes[s]]
        if not over:
            return {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in order}
        for s in over:
            full.add(s)
            left -= 2.0 * sizes[s]


def test_mixing(spark, corpus, empty):
    docs = [(i, sentence(int(rng.integers(0, 40))) if i % 50 else None, "en", None if i % 9 == 8 else f"s{'é' if i % 9 == 7 else min(i % 9, 3)}", 0) for i in range(600)]
    d = spark.createDataFrame(docs, SCHEMA).repartition(4)
    got = mix_sources(d).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in docs}
    assert {r.doc_id: r.size for r in got} == size
    sums = {}
    for i, _, _, s, _ in docs:
        sums[s] = sums.get(s, 0) + size[i]
    want = brute_targets(sums)
    for s in sums:
        mine = [r for r in got if r.source == s]
        assert all(math.isclose(r.target, want[s], rel_tol=1e-9) and r.source_size == sums[s] for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(size.values()) / 2 and all(r.taken in (0, r.size, 2 * r.size) for r in mine)
    assert rows_of(mix_sources(d.repartition(2)).select("doc_id", "taken")) == rows_of(mix_sources(d).select("doc_id", "taken"))
    assert mix_sources(empty).count() == 0 and mix_sources(corpus).count() == corpus.count()
    assert mixed_documents(d).count() == sum(r.epochs for r in got)


@pytest.mark.parametrize("weight", [1e-6, 0.02, 1.0])
def test_mixing_follows_the_keys(spark, weight):
    """What is sampled is a prefix of the order of keys, whatever the weights."""
    docs = [(i, " ".join(["w"] * (1 + i % 7)), "en", f"s{i % 3}", 0) for i in range(3000)] + [(None, "null id " * (k % 5), "en", "s0", 0) for k in range(20)]
    d = spark.createDataFrame(docs, SCHEMA).repartition(5)
    w = F.when(F.col("doc_id") % 2 == 0, F.lit(weight)).otherwise(F.lit(weight / 3))
    got = mix_sources(d, weight=w).collect()

    def key(i):
        u = (int(hashlib.md5(f"7:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / max(weight if i % 2 == 0 else weight / 3, 1e-6)

    for s in ("s0", "s1", "s2"):
        mine = [r for r in got if r.source == s and r.doc_id is not None]
        extra = min(r.epochs for r in mine)
        taken, left = [key(r.doc_id) for r in mine if r.epochs > extra], [key(r.doc_id) for r in mine if r.epochs == extra]
        assert not taken or not left or max(taken) <= min(left)
        rows = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 10


def test_source_targets_of_many(spark):
    """Ranges of sources give what one list of all gives."""
    from threadloom.llm.mixing import source_targets

    sizes = {None: 500} | {f"h{k:03d}{'é' if k % 7 == 0 else ''}": int(rng.integers(0, 50)) ** 3 for k in range(300)}
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint").repartition(7)).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)


# --- sharding


def test_sharding(corpus, empty, spark):
    got = shard_documents(corpus).collect()
    docs = {r.doc_id: r.text for r in corpus.collect()}
    for r in got:
        b = (docs[r.doc_id] or "").encode()
        assert r.size == len(b) + 1 and r.text_crc32 == zlib.crc32(b) and r.law == "rows" and r.grown_shard is None
    for shards in (8, 3):
        g = shard_documents(corpus, n_shards=shards).collect()
        counts = [sum(r.shard == k for r in g) for k in range(shards)]
        assert max(counts) - min(counts) <= 1 and sum(counts) == len(docs)
        for k in range(shards):
            assert sorted(r.slot for r in g if r.shard == k) == list(range(counts[k]))
    pairs = spark.createDataFrame([(i, f"text {i // 2}") for i in range(400)], "doc_id bigint, text string")
    where = {}
    for r in shard_documents(pairs).collect():
        where.setdefault(r.doc_id // 2, set()).add(r.shard)
    assert np.mean([len(s) == 1 for s in where.values()]) > 0.6
    assert shard_documents(empty).count() == 0


def test_sharding_of_any_layout(spark):
    """The same shards and slots however rows are dealt; repeated rows and null ids have places of their own."""
    docs = [(i, f"text {i // 3}", i) for i in range(900)] + [(7, "text 2", 0)] * 30 + [(None, None, 0)] * 5 + [(3, "", 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, shard int").withColumn("hub", F.lit("x"))
    a, b = (sorted(tuple(r) for r in shard_documents(x).select(F.coalesce("doc_id", F.lit(-1)), "size", "text_crc32", "shard", "slot").collect()) for x in (d.repartition(7), d.coalesce(1).orderBy(F.desc("doc_id"))))
    assert a == b and len(a) == len(docs) and len({(r[3], r[4]) for r in a}) == len(a)
    counts = np.bincount([r[3] for r in a], minlength=8)
    assert counts.max() - counts.min() <= 1


def plain_propagation(pairs, shards, rounds):
    """Balanced label propagation on edges with dicts: every node wishes for the shard of most neighbours, wishes are swapped."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b), near.setdefault(b, []).append(a)
    nodes = sorted(near)
    where = {x: k % shards for k, x in enumerate(np.random.default_rng(3).permutation(nodes))}
    for _ in range(rounds):
        wish = {}
        for x in nodes:
            n = np.bincount([where[x], *(where[y] for y in near[x])], minlength=shards)
            if n.argmax() != where[x]:
                wish.setdefault((where[x], int(n.argmax())), []).append(x)
        for (a, b), go in wish.items():
            if a < b:
                for x, y in zip(go, wish.get((b, a), []), strict=False):
                    where[x], where[y] = b, a
    return sum(where[a] != where[b] for a, b in pairs)


def test_sharding_cuts_few_edges(spark):
    """Edges as hubs of two: fewer are cut than at random, and hardly more than by propagation with dicts."""
    r = np.random.default_rng(9)
    pairs = sorted({tuple(sorted((int(c * 20 + i), int(c * 20 + j)))) for c in range(40) for i, j in r.integers(0, 20, (60, 2)) if i != j})
    d = spark.createDataFrame([(i, f"own {i}") for i in range(800)], "doc_id bigint, text string")
    links = spark.createDataFrame([(x, f"{a}-{b}") for a, b in pairs for x in (a, b)], "doc_id bigint, hub string")
    where = {x.doc_id: x.shard for x in shard_documents(d, n_shards=4, rounds=8, links=links).collect()}
    cut = sum(where[a] != where[b] for a, b in pairs)
    assert cut < 0.6 * 0.75 * len(pairs) and cut <= 1.25 * plain_propagation(pairs, 4, 8)
    counts = np.bincount(list(where.values()))
    assert counts.max() - counts.min() <= 1


def test_quotas():
    swap, fill = quotas({(0, 1): 5, (1, 0): 2, (2, 1): 4}, {1: 6}, 3)
    assert swap[0, 1] == 2 + fill[1, 0] and swap[1, 0] == 2 and fill[1, 0] + fill.get((1, 2), 0) <= 6


# --- token counts


def test_token_counts(spark, corpus, empty):
    lengths = encoded_lengths(corpus)
    n = [r.n_tokens for r in lengths.collect()]
    h = length_histogram(lengths)
    for r in h.collect():
        L = r.n_tokens
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (n.count(L), sum(x >= L for x in n), sum(x for x in n if x >= L))
        assert (r.tokens_kept, r.docs_cut, r.tokens_cut) == (sum(min(x, L) for x in n), sum(x > L for x in n), sum(max(x - L, 0) for x in n))
    for r in truncated_totals(h, [0, 7, 100, 10**6]).collect():
        assert (r.docs_cut, r.tokens_kept) == (sum(x > r.context for x in n), sum(min(x, r.context) for x in n))
    for r in length_quantiles(h, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == sorted(n)[math.ceil(r.share * len(n)) - 1]
    assert length_histogram(encoded_lengths(empty)).count() == 0
    assert "MapInArrow" not in h._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.n_tokens for r in lengths.collect()}[0] == 0


def greedy(ranks, piece):
    """Byte pairs merged by hand: of all neighbours the pair of lowest rank, the first of equals."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while len(parts) > 1:
        rank, k = min((ranks.get(parts[i] + parts[i + 1], math.inf), i) for i in range(len(parts) - 1))
        if rank == math.inf:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return len(parts)


def test_token_counts_by_hand(spark):
    import base64

    import regex
    from threadloom.llm.token_counts import PATTERN, VOCABULARY

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(VOCABULARY, "rb") if line.strip())}
    texts = ["Hello world, it's 2024!", "naïve 😀\t\tx", "  two  blanks\n\n", "antidisestablishmentarianism " * 9, "<|endoftext|>", "日本語のテキスト", sentence(60)]
    d = spark.createDataFrame([(i, t, i) for i, t in enumerate([*texts, texts[0]])], "doc_id bigint, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in encoded_lengths(d).collect()}
    want = [sum(greedy(ranks, p.encode()) for p in regex.findall(PATTERN, t)) for t in texts]
    assert got == dict(enumerate([*want, want[0]]))

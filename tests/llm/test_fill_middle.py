"""Fill-in-the-middle against the rule said in Python, and the exact round trip."""

import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from threadloom.llm.fill_middle import SCHEMA, fill_in_middle

DOCS = "doc_id bigint, text string, n int, output string, form string"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def brute(i, text, seed="1", rate=90, spm=20):
    t = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    n, h = len(u), hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = "".join(u[:lo]), "".join(u[lo:hi]), "".join(u[hi:])
    if not t or re.search("<[PSM]>", t) or c % 100 >= rate:
        return i, n, "plain", None, None, t, sha(t), sha(t)
    out = f"<S>{s}<P>{p}<M>{m}" if d % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return i, n, "spm" if d % 100 < spm else "psm", len(p), len(m), out, sha(out), sha(t)


def got(spark, texts, **options):
    rows = [(i, t, 1, "x", "y") for i, t in texts]
    df = fill_in_middle(spark.createDataFrame(rows, DOCS).repartition(2), **options)
    return sorted((tuple(r) for r in df.collect()), key=repr)


TEXTS = [None, "", " ", "a", "<P>", "x <S> y", "a<M", "a < P > b", "<", "<<<S", "ab\x00cd\r\n", "Ünï çødé ﬀ 😀 é", "one two\nthree", "word " * 30000, "<" * 50, "P>S>M>", "  ", "abcdef" * 2000]


@pytest.mark.parametrize("options", [{}, {"rate": 100, "spm": 50}, {"rate": 0}, {"seed": "it's", "rate": 100, "spm": 100}])
def test_against_brute_force(spark, options):
    rows = [(k * 20 + j, t) for k, t in enumerate(TEXTS) for j in range(6)] + [(None, "no id"), (7, "twice the same"), (7, "twice the same")]
    assert got(spark, rows, **options) == sorted((brute(i, t, **options) for i, t in rows), key=repr)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]) | st.sampled_from("<PSM>"), max_size=40), min_size=1, max_size=40))
def test_round_trip_of_any_text(spark, texts):
    for i, n, form, _, _, output, _, restored in got(spark, list(enumerate(texts)), rate=100, spm=50):
        assert restored == sha(texts[i])
        assert (i, n, form, output) == (*brute(i, texts[i], rate=100, spm=50)[:3], brute(i, texts[i], rate=100, spm=50)[5])


def test_all_forms_columns_and_empty_table(spark):
    rows = [(k, "some text of a few words") for k in range(400)]
    forms = [r[2] for r in got(spark, rows)]
    assert 20 < forms.count("plain") < 60 and 45 < forms.count("spm") < 105
    assert got(spark, []) == []
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    docs = spark.createDataFrame([(1, "a b", 1, "x", "y")], DOCS)
    assert fill_in_middle(docs, texts=False).columns == ["doc_id", *[c for c in names[1:] if c != "output"]]
    assert fill_in_middle(docs, digests=False).columns == ["doc_id", *names[1:6]]

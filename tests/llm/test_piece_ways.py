"""The N best segmentations that op6 returns: whole, in order, each of them the text."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from threadloom.llm.pieces import N_BEST, VOCABULARY, decode_pieces
from threadloom.llm.queries import op6_pieces


def test_all_ways_are_returned(spark, sf):
    if not Path(VOCABULARY).exists():
        pytest.skip("no vocabulary here")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ways = op6_pieces(spark, sf)
    rows = ways.collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert len(r.n_best_ids) == len(r.n_best_scores) <= N_BEST and [len(w) for w in r.n_best_ids] == r.n_best_sizes
        assert len({tuple(w) for w in r.n_best_ids}) == len(r.n_best_ids) and (not r.n_best_ids or r.n_best_ids[0] == r.ids)
    back = ways.select("doc_id", F.explode("n_best_ids").alias("w")).select("doc_id", decode_pieces(F.col("w")).alias("t")).collect()
    assert len(back) > len(texts) and all(r.t == texts[r.doc_id] for r in back)

"""A conclusion is made from one pass over its text."""

from pyspark.sql import functions as F

from threadloom.functions import text as X


def test_conclusion_cuts_sentences_once(spark):
    texts = ["One. Two! Three? ", "", None, "   ", "no end", "A. " + "b" * 400 + ".", "x ``` y. " + "z" * 299 + "!", "一。二！三"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.conclusion(F.col("t")).alias("c"))
    got = {r.i: r.c for r in frame.collect()}
    assert [got[i] for i in range(5)] == ["Two! Three?", "", "", "", "no end"] and got[7] == "二！ 三"
    assert got[5] == ("A. " + "b" * 297 + "…") and got[6] == ("x ``` y. " + "z" * 291 + "…\n```")
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1

"""Words shared with documents: their texts are read once, and words that no item has go no further."""

from threadloom.plans import texts


def test_texts_are_read_once(spark, sf):
    plan = texts.overlap(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in "".join(line for line in plan.splitlines() if "doc_id" in line)


def test_shared_words(spark):
    items = spark.createDataFrame([(1, w) for w in "abcdef"] + [(2, w) for w in "abxy"], "item_id int, w string")
    documents = spark.createDataFrame([(d, w) for d, ws in {10: "abcdz", 11: "abx", 12: "qrst", 13: "abcdefxy", 14: "ab"}.items() for w in ws], "doc_id int, w string")
    got = {(r.item_id, r.doc_id): r.shared for r in texts.shared_words(items, documents, 3).collect()}
    assert got == {(1, 10): 4, (1, 13): 6, (2, 11): 3, (2, 13): 4}

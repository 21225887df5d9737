"""Search for three places a query: texts are attached to what is chosen, and matches are made once."""

from test_texts_last import exchanged

from threadloom.plans import catalog


def test_texts_are_not_shuffled(spark, sf):
    found = list(exchanged(catalog.queries()["h9_budgeted"](spark, sf)._jdf.queryExecution().executedPlan()))
    assert found and not [columns for _, columns in found if columns & {"summary_text", "text", "content_hash"}]


def test_matches_are_made_once(spark, sf):
    plan = catalog.queries()["f15_recall_outcome"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "keyword" not in plan and "content_hash" not in plan

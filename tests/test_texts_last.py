"""Answers get their texts last: no exchange by session carries them."""

import pytest

from threadloom.plans import catalog


def exchanged(node):
    """What each exchange below a node of a plan is dealt by, and the names of its columns."""
    if node.nodeName() == "AdaptiveSparkPlan":
        yield from exchanged(node.initialPlan())
    if "Exchange" in node.nodeName():
        yield node.simpleString(200), {node.output().apply(i).name() for i in range(node.output().size())}
    for i in range(node.children().size()):
        yield from exchanged(node.children().apply(i))


@pytest.mark.parametrize("name", ["j1_compress", "j3_eager", "c19_eager_stub", "f16_saved_tokens"])
def test_no_text_by_session(spark, sf, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of size
    try:
        found = list(exchanged(catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any("session_id" in how.split("]")[0] for how, _ in found)
    assert not [how for how, columns in found if "session_id" in how and columns & {"content", "text"}]

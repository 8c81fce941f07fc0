"""A staged table with an explode in its plan looks small to Spark; its rows must not go through the driver."""

from telemill.llm import spelling as SP
from telemill.llm.shared import stage


def test_no_join_of_spelling_variants_is_a_broadcast(spark, documents, monkeypatch):
    plans = []

    def staged(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, name)

    monkeypatch.setattr(SP, "stage", staged)
    plans.append(SP.variants(documents)._jdf.queryExecution().executedPlan().toString())
    # Words, near words, links and their moves, and the last look-up.
    assert len(plans) >= 5 and sum("Join" in p for p in plans) >= 3
    assert not [p for p in plans if "Broadcast" in p]

"""Components by small plans, which the driver's memory needs: a step must not compute its tables again and again."""

import pytest

from lexiloom.llm import components


@pytest.fixture
def written(monkeypatch):
    """The logical plan of each table that components writes."""
    plans = []

    def durable(df, tag, write=components.durable):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, tag)

    monkeypatch.setattr(components, "durable", durable)
    return plans


def roots(spark, edges):
    return {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}


def test_a_step_joins_once(spark, written):
    hub = [(500, i) for i in range(501, 900)]
    chain = [(i, i + 1) for i in range(20)]
    assert roots(spark, [*hub, *chain, (899, 20), (20, 899)]) == {i: 0 for i in [*range(21), *range(500, 900)]}
    assert max(p.count("Join ") for p in written) == 2, "the hubs' and the others'"
    assert max(p.count("Aggregate ") for p in written) == 1


def test_stars_take_no_round(spark, written):
    assert roots(spark, [(1, 2), (3, 1), (7, 8), (8, 7)]) == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert len(written) == 2

import pytest

import __spark_entry__ as entry
from orrery.plans.queries import QUERIES
from orrery.plans.sql import ORACLES
from tests.conftest import SF
from tests.oracle import check


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        check(spark, SF, QUERIES[name], ORACLES[name])
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(ORACLES) <= set(QUERIES)
    assert entry.entry(spark).count() > 0


def test_plans_push_down_and_stay_generated(spark, capsys):
    QUERIES["label_counts"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<label:int>" in plan and "CartesianProduct" not in plan
    QUERIES["knn_l2"](spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan

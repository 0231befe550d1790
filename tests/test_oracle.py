"""Every registered query against its SQL on the smallest data."""
import pytest

from checks.all import QUERIES, SQL
from checks.compare import compare, connect
from checks.views import Views
from conftest import SMALL

ROWS_ONLY = {name for name in QUERIES if name not in SQL}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def run(spark, name):
    """The query's result; its plan pairs no two tables row by row."""
    df = QUERIES[name](Views(spark, SMALL))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    return df


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    assert compare(run(spark, name), duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_runs(spark, name):
    assert run(spark, name).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["store_id", "observed_on", "new_products", "removed_products", "price_changes"]

import pytest

from lodestone.plans import catalogue, mapped, more, scalar  # noqa: F401

from .conftest import SMALL
from .oracle import connection, same


@pytest.fixture(scope="module")
def duck():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    if name in catalogue.ORACLES:
        same(df, duck, catalogue.ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pushdown(spark):
    plan = catalogue.QUERIES["filter_eq_in_options"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(lang,en)" in plan and "html" not in plan

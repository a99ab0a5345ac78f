"""Every query with SQL gives the SQL's rows; the others run."""

import pytest

from lumbung.plans import folders, reports  # noqa: F401
from lumbung.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf_dir, duck, same_rows, name):
    same_rows(QUERIES[name](spark, sf_dir), duck.sql(ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["product_id", "n_reviews", "log_lik", "prop_state1", "pos_transisi", "idx_transisi", "occ_state1"]
    assert set(entry.oracle_sql()) <= set(entry.queries())

import pytest
from oracle import same

from trackloom import plans

SQL = plans.oracle_sql()


@pytest.mark.parametrize("name", [n for n in plans.queries() if n in SQL])
def test_matches_sql(spark, duck, sf_dir, name):
    same(spark, duck, sf_dir, plans.queries()[name], SQL[name])


def test_every_sql_has_a_query():
    assert set(SQL) <= set(plans.queries())


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["fits_roundtrip", "seq_extend", "report_fallback", "evidence_json"])
def test_runs(spark, sf_dir, name):
    assert plans.queries()[name](spark, sf_dir).count() > 0

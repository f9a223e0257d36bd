import pytest
from oracle import same

from trailmark import queries

SQL = queries.oracle_sql()


#: Half a minute of small jobs; what they call is tested in test_engine.py.
LONG = {"experiment_parameters", "experiment_ablation"}


@pytest.mark.parametrize("name", sorted(set(SQL) - LONG))
def test_same_rows_as_sql(spark, small, name):
    same(queries.queries()[name](spark, small), SQL[name], small)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries.queries())


def test_codecs_return_every_array(spark, small):
    rows = queries.queries()["codec_roundtrip"](spark, small).collect()
    assert len(rows) == 13 and all(r.n == r.n_same for r in rows)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert {"entry", "queries", "oracle_sql"} <= set(dir(__spark_entry__))

"""Every query of the movie analysis against its SQL, and those without SQL for rows."""

import pytest
from oracle import same

from myospark.jobs import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(name, spark, sf_dir):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name], spark, sf_dir)


@pytest.mark.parametrize("name", ["segment_zdiscs", "smooth_gpr", "find_valleys", "ts_params", "ward_linkage", "leaf_order", "j_valleys", "bootstrap_length"])
def test_has_rows(name, spark, sf_dir):
    assert queries.QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__

    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(queries.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).columns == ["movie_id", "frame", "mean_norm", "median_norm"]

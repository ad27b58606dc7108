"""Every registered query against its SQL on the smallest tables."""

import pytest

from tests.conftest import same_as_sql
from tessera.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        same_as_sql(df, SQL[name], sf)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["st2_windowed_counts", "st3_lockout_stream", "st4_activity_sessions"])
def test_streams_of_a_folder_of_part_files(spark, sf, tmp_path, name):
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    one, parts = (sorted(map(str, QUERIES[name](spark, at).collect())) for at in (sf, str(tmp_path)))
    assert one and one == parts

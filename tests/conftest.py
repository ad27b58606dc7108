import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    place = tempfile.mkdtemp(prefix="tessera-tests-")
    session = (
        SparkSession.builder.master("local[*]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"{place}/shared").config("spark.sql.warehouse.dir", f"{place}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf():
    return SF


def same_as_sql(df, sql, sf):
    """Whether a DataFrame has the rows that DuckDB gives for sql on the tables of sf."""
    import glob

    import duckdb

    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    rel = c.sql(sql)
    rows, names = rel.fetchall(), rel.columns
    assert sorted(names) == sorted(df.columns)
    names = sorted(names)
    order = [rel.columns.index(n) for n in names]

    def plain(x):
        return round(x, 9) if isinstance(x, float) else str(x)[:26] if hasattr(x, "year") else x

    a = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=str)
    b = sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)
    assert len(a) == len(b) and a == b, [x for x in zip(a, b) if x[0] != x[1]][:3]

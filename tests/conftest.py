import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def same_rows(spark_df, duck_rel):
    """Order-free comparison of a Spark result with a DuckDB relation by column name."""
    import math

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if hasattr(v, "as_tuple") or isinstance(v, float):
            v = round(float(v), 6)
            return int(v) if v == int(v) else v
        return v

    names = sorted(spark_df.columns)
    assert names == sorted(duck_rel.columns)
    a = sorted((tuple(plain(r[c]) for c in names) for r in spark_df.collect()), key=repr)
    at = [duck_rel.columns.index(c) for c in names]
    b = sorted((tuple(plain(r[i]) for i in at) for r in duck_rel.fetchall()), key=repr)
    assert a == b


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con

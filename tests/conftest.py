import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.environment["PYTHONPATH"] = ROOT
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    """Compares a query with its SQL: column names and all rows."""

    def compare(query, sql):
        df = query(spark, SF)
        cursor = duck.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        at = [names.index(c) for c in df.columns]
        shown = lambda row: tuple(round(float(v), 5) if isinstance(v, float) else v for v in row)
        assert sorted((shown(r) for r in df.collect()), key=repr) == sorted((shown([r[i] for i in at]) for r in cursor.fetchall()), key=repr)

    return compare

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def compare():
    """Rows of a query and of its SQL in DuckDB, as sorted text."""
    import duckdb

    def both(spark, query, sql, sf_dir):
        con = duckdb.connect()
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        a = query(spark, sf_dir)
        names = sorted(a.columns)
        left = sorted(repr(tuple(r)) for r in a.select(*names).collect())
        got = con.execute(f"select {', '.join(names)} from ({sql}) q")
        return left, sorted(map(repr, got.fetchall()))

    return both

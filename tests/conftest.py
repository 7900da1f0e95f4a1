import os
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SMALL}/{name}'")
    return con


def rows(pdf: pd.DataFrame) -> list:
    """Rows as sorted texts, columns by name, so that engines can be compared."""
    plain = pdf[sorted(pdf.columns)].astype(object)
    plain = plain.where(plain.notna(), None)

    def value(v):
        v = v.tolist() if hasattr(v, "tolist") else v
        return int(v) if isinstance(v, float) and v.is_integer() else v  # pandas has no integer column with nulls

    return sorted(repr([value(v) for v in r]) for r in plain.values.tolist())


@pytest.fixture(scope="session")
def same():
    def check(got, expected):
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)

    return check

import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("fieldwarden-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture()
def people(spark):
    data = [
        (i, f"Test User {i}", f"user{i}@example.com", f"404555{1000 + i}", f"{100 + i}-{10 + i}-{1000 + i}")
        for i in range(1, 51)
    ]
    return spark.createDataFrame(data, "rid long, name string, email string, phone string, ssn string")

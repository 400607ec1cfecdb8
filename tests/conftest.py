import os
import tempfile

import pytest
from pyspark.sql import SparkSession


def make_session():
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("barloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="barloom-tests-"))
        .config("spark.driver.memory", os.environ.get("TEST_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()

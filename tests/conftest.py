import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        # Short queries end before an optimizing compiler pays off.
        .config("spark.driver.extraJavaOptions", "-XX:TieredStopAtLevel=1")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session

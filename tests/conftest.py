import os

import pytest
from pyspark.sql import SparkSession

from folioscope.sources import scratch


@pytest.fixture(scope="session")
def spark():
    out = (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    out.sparkContext.setLogLevel("ERROR")
    yield out
    scratch.release(out)
    out.stop()

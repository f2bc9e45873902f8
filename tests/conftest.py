import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def table(spark):
    """rows, schema -> DataFrame; numbers in lists may be written as integers."""
    real = lambda v: [float(x) if isinstance(x, int) else x for x in v] if isinstance(v, list) else v
    return lambda rows, schema: spark.createDataFrame([tuple(map(real, r)) for r in rows], schema)


def rows(df):
    return sorted(tuple(r) for r in df.collect())

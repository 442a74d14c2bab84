import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))


@pytest.fixture(scope="session")
def spark():
    from termsheet.session import local_session
    return local_session("tests", 8)


@pytest.fixture
def one(spark):
    """Evaluate a column function on one text."""
    from pyspark.sql import functions as F

    def run(fn, text):
        df = spark.createDataFrame([(text,)], "raw STRING")
        return df.select(fn(F.col("raw")).alias("v")).first()["v"]
    return run

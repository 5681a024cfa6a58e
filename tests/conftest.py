import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tuturan.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("8", "tests")


@pytest.fixture(scope="session")
def apply(spark):
    """Apply a column function to a list of texts."""
    from pyspark.sql import functions as F

    def run(fn, values, kind="string"):
        rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
        out = rows.repartition(3).select("i", fn(F.col("v")).alias("o")).collect()
        return [r["o"] for r in sorted(out, key=lambda r: r["i"])]

    return run

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from labelflow.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def values(spark):
    """Run a column expression builder over literal inputs and return the results in order."""

    def run(build, inputs, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
        return [r[0] for r in df.select(build("v").alias("o"), "i").orderBy("i").select("o").collect()]

    return run

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from contentfit.session import ensure_checkpoint_dir, get_spark
    s = get_spark("contentfit-tests", master="local[4]", shuffle_partitions=4)
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture
def one(spark):
    """Evaluate a Column expression on a one-row frame."""
    def run(col):
        return spark.range(1).select(col.alias("v")).first()[0]
    return run

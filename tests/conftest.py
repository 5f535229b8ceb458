import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from stockflow.session import get_session
    s = get_session("local[4]", shuffle_partitions=4, app_name="stockflow-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def seed(spark):
    from stockflow.sources.seed import seed_rows
    return seed_rows(spark)

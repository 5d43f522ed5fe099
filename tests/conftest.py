import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from data_paths import SF01  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from normsmith.session import local_session

    s = local_session("*", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def cells01(spark):
    from normsmith.plans import flows

    return flows.rating_cells(spark, SF01).cache()

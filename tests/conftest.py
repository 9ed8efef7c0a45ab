import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tenderlake.session import get_session
    s = get_session(master="local[4]", shuffle_partitions=4, app_name="tenderlake-tests")
    yield s


@pytest.fixture(scope="session", autouse=True)
def prepared_views(request):
    """The derived tables of the small folder once for all tests that may read them."""
    if any("/llm/" not in item.nodeid for item in request.session.items):
        from tenderlake.session import scratch_path
        from tenderlake.sources.stored import prepare, use_prepared
        spark = request.getfixturevalue("spark")
        folder = scratch_path(spark, "test-views")
        prepare(spark, SF_SMALL, folder)
        use_prepared(SF_SMALL, folder)


@pytest.fixture(scope="session")
def duck_small():
    from tenderlake.plans.check import duck
    return duck(SF_SMALL)

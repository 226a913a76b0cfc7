import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = os.environ.get("GEARLENS_CHECK_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    from gearlens.session import get_session
    s = get_session("local[*]", shuffle_partitions=8, app_name="gearlens-tests")
    yield s
    s.stop()

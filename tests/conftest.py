import os

import pytest

from tessera.session import get_session

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return get_session("local[4]", 4)


@pytest.fixture(scope="session")
def sf_dir():
    return SF

import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from lodestone.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return get_session("tests")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"

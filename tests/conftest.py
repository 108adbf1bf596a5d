import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cityloom.runtime import session


@pytest.fixture(scope="session")
def spark():
    return session("local[8]", shuffle_partitions=4)


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)

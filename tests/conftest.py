import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from seriesloom.session import clear_written, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(shuffle_partitions=4)
    yield session
    clear_written(session)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"

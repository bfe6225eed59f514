import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tagweave.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=8, app_name="tagweave-tests")
    yield s
    s.stop()


@pytest.fixture
def scratch(spark):
    from tagweave.session import scratch_path
    return lambda name: scratch_path(spark, name)


@pytest.fixture
def write_text():
    """write_text(path, text) -> the path as a string."""
    def write(path, text: str) -> str:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return str(path)
    return write

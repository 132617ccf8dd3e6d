import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewatch.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[4]", 4, spark__checkpoint__dir="file://" + tempfile.mkdtemp(prefix="tidewatch-tests-"))
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()

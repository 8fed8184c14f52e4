import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quorate.session import build_session
    s = build_session("quorate-tests", "local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="8g", spark__ui__enabled="false")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()

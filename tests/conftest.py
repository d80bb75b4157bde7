import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from millrace.session import session

    at = tmp_path_factory.mktemp("shared")
    s = session("tests", spark__master="local[4]", spark__driver__memory="4g", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__checkpoint__dir=f"file:{at}", spark__sql__warehouse__dir=f"file:{at}/warehouse")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()

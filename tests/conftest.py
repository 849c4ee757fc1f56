import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from glosa.session import build_session

    work = str(tmp_path_factory.mktemp("work"))
    session = build_session("tests", cores="4", shuffle_partitions=4, work=work, spread=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()

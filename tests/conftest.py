import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from labelloom.session import local_session

    s = local_session(4, 4, spark__sql__autoBroadcastJoinThreshold="1m")
    yield s
    s.stop()

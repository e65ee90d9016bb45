import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lotwise.session import local_session

    s = local_session("*", 8, app="lotwise-tests")
    # tests have no cluster-provided shared folder: use a fresh local one
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lotwise-test-ckpt-"))
    yield s


@pytest.fixture
def scratch():
    return tempfile.mkdtemp(prefix="lotwise-test-")

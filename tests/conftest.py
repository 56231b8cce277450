import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fieldloom.session import checkpoint_root, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    checkpoint_root(session, tempfile.mkdtemp(prefix="spark-"))
    yield session
    session.stop()


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="spark-")

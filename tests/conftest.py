import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ionweave.session import ensure_checkpoint_dir, local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, memory="4g", name="tests")
    ensure_checkpoint_dir(session)
    yield session
    session.stop()

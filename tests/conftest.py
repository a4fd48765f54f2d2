from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from cohortline.runtime import local_session, release

    session = local_session("4", shuffle_partitions=4, app="cohortline-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()

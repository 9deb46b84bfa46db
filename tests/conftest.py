from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from weftline.session import local_session, ship_package

    session = local_session("4", 4, "4g")
    ship_package(session)
    yield session
    session.stop()

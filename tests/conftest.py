from __future__ import annotations

import pytest

from lumenfield.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(8, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return "/root/testdata/sf0.001"

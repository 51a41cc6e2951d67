import os

os.environ.setdefault("LEXIVEC_SHUFFLE", "4")

import pytest

from lexivec.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, "lexivec-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()

from __future__ import annotations

import pytest

from weir.session import local


@pytest.fixture(scope="session")
def spark():
    session = local(4, "4g", 4)
    yield session
    session.stop()

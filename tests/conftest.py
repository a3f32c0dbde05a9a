import os
import sys
from pathlib import Path

os.environ.setdefault("PYTHONPATH", str(Path(__file__).resolve().parent.parent))

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from vitrine.session import local_session

    session = local_session(4, 4, "tests")
    yield session
    session.stop()

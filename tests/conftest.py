import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from checks.compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from fleetvitals import tune

    made = tune(session(4))
    yield made
    made.stop()


@pytest.fixture
def rows():
    """Rows of a frame as a sorted list of dicts."""

    def collect(df):
        return sorted((r.asDict() for r in df.collect()), key=repr)

    return collect

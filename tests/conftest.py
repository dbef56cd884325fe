import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from clickatlas.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(shuffle_partitions=4, **{"spark.ui.showConsoleProgress": "false"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rows():
    """Rows of a DataFrame as sorted tuples."""
    return lambda df: sorted(map(tuple, df.collect()), key=str)

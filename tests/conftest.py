import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from telemill.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("shared tables not present")
    return DATA


def rows(df, *order):
    """Collected rows as plain tuples in a fixed order."""
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def close(a, b, tol=1e-9):
    """Equal tuples, floats up to a relative tolerance."""
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            if isinstance(u, float) and isinstance(v, float):
                assert abs(u - v) <= tol * max(1.0, abs(u), abs(v)), (x, y)
            else:
                assert u == v, (x, y)

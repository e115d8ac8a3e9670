import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from auralith.session import build_session

    s = build_session("local[4]", shuffle_partitions=8, app="auralith-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collect small test results as sorted tuples."""
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())

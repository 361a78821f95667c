import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from fleetcases.session import get_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[*]", shuffle_partitions=8, app="fleetcases-tests")
    yield s


def srt(tuples):
    """Tuples sorted with nulls last in every position."""
    return sorted((tuple(t) for t in tuples), key=lambda t: tuple((x is None, x) for x in t))


def rows(df, *cols):
    """Sorted tuples of the given columns (all columns if none given)."""
    return srt(df.select(*cols).collect() if cols else df.collect())

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tradebook.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4, "tradebook-tests")


@pytest.fixture()
def rows(spark):
    """rows(df) -> list of tuples in a stable order."""

    def collect(df):
        return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))

    return collect


def one(df, col=0):
    return df.first()[col]

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from statloom.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def split_small(spark):
    """Treat groups above 40 rows as too large for one task."""
    spark.conf.set("statloom.maxGroupRows", "40")
    yield
    spark.conf.unset("statloom.maxGroupRows")


def rows(df, *order):
    """Rows as tuples, floats rounded, in a fixed order."""
    def cell(v):
        return round(v, 9) if isinstance(v, float) else v

    out = [tuple(cell(v) for v in r) for r in df.collect()]
    return sorted(out, key=lambda t: tuple((v is None, str(v)) for v in t))

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from netloom.session import get_session, tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    yield tune(s)


@pytest.fixture()
def tiny_segments(spark):
    """Force the paths for keys too large for one task."""
    from netloom.plans import ordered

    spark.conf.set(ordered.SEGMENT_SETTING, "7")
    yield spark
    spark.conf.unset(ordered.SEGMENT_SETTING)

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_session
    s = get_session("local[4]", shuffle_partitions=4, app="tessera-tests")
    yield s


def hours(n, start=dt.datetime(2024, 1, 1)):
    return [start + dt.timedelta(hours=i) for i in range(n)]


@pytest.fixture
def panel_schema():
    return "station string, datetime timestamp_ntz, PM2_5 double, TEMP double, wd string"

import datetime as dt

import pytest

from panelcast.session import prepare
from tests.oracle import make_spark

UTC = dt.timezone.utc


@pytest.fixture(scope="session")
def spark():
    s = prepare(make_spark())
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def hourly(spark):
    """Builds ``(series_key, ts, <name>)`` hourly rows from lists of values."""

    def build(series, name="price", start=dt.datetime(2023, 1, 1), step=3600):
        rows = [
            (k, start.replace(tzinfo=UTC) + dt.timedelta(seconds=step * i), None if v is None else float(v))
            for k, values in series.items() for i, v in enumerate(values)
        ]
        return spark.createDataFrame(rows, f"series_key string, ts timestamp, {name} double")

    return build

import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from pulsegrid import build_session

    session = build_session("tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture()
def series(spark):
    """Builder of one or more series with one row per minute: name -> values."""
    from datetime import datetime, timedelta

    def build(step=timedelta(minutes=1), start=datetime(2024, 1, 1), **values):
        rows, i = [], 0
        for name, vs in values.items():
            for n, v in enumerate(vs):
                rows.append((i, start + n * step, name, None if v is None else float(v)))
                i += 1
        return spark.createDataFrame(rows, "event_id long, timestamp timestamp, metric_name string, value double")

    return build

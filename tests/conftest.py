import sys
from pathlib import Path

import pytest
from days import day

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from quantspark.session import local_session

    session = local_session(8, "quantspark-tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def bars(spark):
    """Build bars from {ticker: {date: close}}."""

    def build(quotes, volume=None):
        rows = [(t, day(d), c, c, float(volume) if volume else 100.0) for t, series in quotes.items() for d, c in series.items()]
        return spark.createDataFrame(rows, "ticker string, d date, open double, close double, volume double")

    return build


@pytest.fixture(scope="session")
def market(spark):
    def build(series):
        return spark.createDataFrame([(day(d), c) for d, c in series.items()], "d date, close double")

    return build

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marketloom.session import local_session  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from marketloom.sources import Tables

    return Tables(spark, FOLDER)


@pytest.fixture(scope="session")
def hot(spark):
    """Three symbols, one of them with a third of all rows and more, irregular times, many equal values."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    parts = []
    for sym, n in (("HOT", 3000), ("A", 900), ("B", 37)):
        ts = pd.Timestamp("2020-01-01") + pd.to_timedelta(np.cumsum(rng.integers(1, 4000, n)), unit="s")
        parts.append(pd.DataFrame({"symbol": sym, "ts": ts, "seq": np.arange(n), "close": 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n))), "x": rng.integers(0, 50, n).astype(float)}))
    pdf = pd.concat(parts)
    return pdf, spark.createDataFrame(pdf).cache()

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from orrery.runtime import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """Rows of a matrix as (offset, key, vector)."""

    def make(m, keys=None, key_prefix=None):
        rows = [(i, keys[i] if keys else f"{key_prefix}{i}" if key_prefix else None, [float(x) for x in r]) for i, r in enumerate(np.asarray(m))]
        return spark.createDataFrame(rows, "offset long, key string, vector array<double>")

    return make


def values(df, vector="vector", on="offset"):
    return np.array([r[0] for r in df.orderBy(on).select(vector).collect()], float)

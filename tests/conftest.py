import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from tarnfield.runtime import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4)
    yield session
    session.stop()


@pytest.fixture
def grid_frame(spark):
    """Arrays of equal shape to a long cell table."""

    def build(**arrays):
        import numpy as np
        import pandas as pd

        first = next(iter(arrays.values()))
        rows, cols = np.indices(first.shape)
        data = {"row": rows.ravel().astype("int32"), "col": cols.ravel().astype("int32")}
        data.update({k: v.ravel() for k, v in arrays.items()})
        return spark.createDataFrame(pd.DataFrame(data))

    return build


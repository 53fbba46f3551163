import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pixelquarry.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", master="local[8]", shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def image(spark):
    """Make a pixel DataFrame from {image_id: array (h, w, 3) in b, g, r order}."""

    def make(arrays):
        rows = [
            (i, a.shape[1], a.shape[0], x, y, *(int(v) for v in a[y, x]))
            for i, a in arrays.items() for y in range(a.shape[0]) for x in range(a.shape[1])
        ]
        return spark.createDataFrame(rows, "image_id bigint, w int, h int, x int, y int, b int, g int, r int")

    return make

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rankloom.session import build_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4, 4, "4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


# (query, true_label, score)
GOLDEN = [
    ("q1", 1, 0.9), ("q1", 0, 0.8), ("q1", 1, 0.8), ("q1", 0, 0.1),
    ("q2", 0, 0.7), ("q2", 1, 0.2),
    ("q3", 0, 0.5), ("q3", 0, 0.4),
    ("q4", 1, 0.3),
]


@pytest.fixture(scope="session")
def golden(spark):
    rows = [(f"p{i}", q, y, s, "m") for i, (q, y, s) in enumerate(GOLDEN)]
    return spark.createDataFrame(rows, "pair_id string, query string, true_label int, score double, model string")

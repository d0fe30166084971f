from __future__ import annotations

import os
import random
import sys
import warnings

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from textweir.policy import PolicyWarning  # noqa: E402
from textweir.session import local_session  # noqa: E402

warnings.simplefilter("ignore", PolicyWarning)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, memory="4g", app="tests")


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def random_texts(n: int, pieces: list[str], seed: int, most: int = 12) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.fixture
def texts(spark):
    """Factory: strings -> ``(i, text)``."""
    def make(rows):
        return spark.createDataFrame(list(enumerate(rows)), "i int, text string")
    return make


def iter_admit(times, max_requests: int, window_us: int):
    """The limiter's rule, one request at a time."""
    log: list[int] = []
    for now in times:
        log = [t for t in log if now - t < window_us]
        if len(log) < max_requests:
            log.append(now)
            yield True
        else:
            yield False

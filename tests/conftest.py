from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from talentmill.session import build_session, drop_intermediates  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        master="local[8]",
        shuffle_partitions=8,
        extra={
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="talentmill-tests-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    drop_intermediates(session)
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

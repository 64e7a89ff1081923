from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fixed import AS_OF  # noqa: E402
from runlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def seed(spark):
    """Two workflows and forty executions, one per minute back from ``AS_OF``."""
    rows = []
    for i in range(40):
        start = AS_OF - dt.timedelta(minutes=i)
        rows.append((1000 + i, "wf-a" if i % 2 else "wf-b", "error" if i % 5 == 0 else "success",
                     start, start + dt.timedelta(seconds=2.5)))
    executions = spark.createDataFrame(
        rows, "id long, workflow_id string, status string, started_at timestamp, stopped_at timestamp")
    workflows = spark.createDataFrame([("wf-a", "Alpha", True), ("wf-b", "Beta", True)],
                                      "id string, name string, active boolean")
    return executions, workflows

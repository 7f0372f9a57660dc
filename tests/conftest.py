import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from metricloom.scale import GROUP_LIMIT_CONF
from metricloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",  # small test tables must really span blocks
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="metricloom-tests-"),
    })
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def tiny_groups(spark):
    """Force every ordered computation onto the split way."""
    spark.conf.set(GROUP_LIMIT_CONF, "7")
    yield
    spark.conf.unset(GROUP_LIMIT_CONF)

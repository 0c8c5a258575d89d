import tempfile

import pytest
from pyspark.sql import SparkSession


def pytest_configure(config):
    """One session for all tests, begun before they are collected so that modules can build expressions."""
    shared = tempfile.mkdtemp(prefix="corvane-tests-")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared)
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    config.stash[_KEY] = session


_KEY = pytest.StashKey()


@pytest.fixture(scope="session")
def spark(request):
    return request.config.stash[_KEY]

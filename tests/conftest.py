import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """Files from (name, content) pairs, numbered in order, in one change unless said otherwise."""

    def make(pairs, change_id=1):
        rows = [(change_id, at, at, name, "modified", 1, 0, content)
                for at, (name, content) in enumerate(pairs)]
        return spark.createDataFrame(
            rows, "change_id long, file_ord long, file_id long, filename string, status string, "
                  "additions int, deletions int, content string")

    return make


@pytest.fixture(scope="session")
def hits():
    """Findings as sorted tuples of the named columns."""

    def collect(findings, *columns):
        return sorted((tuple(row) for row in findings.select(*columns).collect()), key=repr)

    return collect

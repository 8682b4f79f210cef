import atexit
import shutil
import tempfile

import pytest
from pyspark.sql import SparkSession

SHARED = tempfile.mkdtemp(prefix="noticeloom-tests-")
atexit.register(shutil.rmtree, SHARED, ignore_errors=True)
# columns are built when test modules are imported, so the session has to exist before them
SESSION = (
    SparkSession.builder.master("local[4]")
    .config("spark.sql.shuffle.partitions", "4")
    .config("spark.ui.enabled", "false")
    .config("spark.sql.session.timeZone", "UTC")
    .config("spark.driver.memory", "4g")
    .config("spark.checkpoint.dir", f"file://{SHARED}")
    .getOrCreate()
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tallymill.session import get_session

    session = get_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": 4, "spark.ui.enabled": "false", "spark.driver.memory": "6g",
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))},
    )
    yield session
    session.stop()


@pytest.fixture
def small_cells(spark):
    """Cuts every group above three rows, so that small data takes the split plans."""
    spark.conf.set("tallymill.cell.rows", "3")
    yield
    spark.conf.unset("tallymill.cell.rows")


SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark):
    from tallymill.tables import Tables

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return Tables(spark, SF)

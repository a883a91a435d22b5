import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sondage.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "sondage-tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return SMALL


@pytest.fixture
def conf(spark):
    """Set library limits for one test."""
    names = []

    def put(**values):
        for k, v in values.items():
            spark.conf.set(f"spark.sondage.{k}", str(v))
            names.append(f"spark.sondage.{k}")

    yield put
    for n in names:
        spark.conf.unset(n)


@pytest.fixture
def rows(spark):
    """Small table from a list of tuples and a schema string, in a given number of partitions."""

    def make(data, schema, parts=3):
        return spark.createDataFrame(data, schema).repartition(parts)

    return make

import pytest

from callscope.session import local_session

# Made before the test modules are read: columns cannot be written without a session.
_SESSION = local_session(8, 4)
_SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield _SESSION
    _SESSION.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over one row of given columns."""

    def run(expr, schema="t string", row=(None,)):
        return spark.createDataFrame([row], schema).select(expr.alias("v")).first()["v"]

    return run

import pytest

from codelattice.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, partitions=4, memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """``frame("a string, b int", [(…), …])``."""
    return lambda schema, rows: spark.createDataFrame(rows, schema)


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)

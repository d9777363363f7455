import pytest

from quarryline.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    folders = {"spark.sql.warehouse.dir": str(base / "warehouse"), "spark.checkpoint.dir": str(base / "checkpoint")}
    session = local_session(4, settings=folders)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """Builds a DataFrame from tuples and a schema string."""
    return lambda data, schema: spark.createDataFrame(data, schema)


@pytest.fixture
def schema(spark, tmp_path):
    """A schema of its own below the test's folder."""
    import uuid

    from quarryline.sources.tables import open_schema

    return open_schema(spark, f"t_{uuid.uuid4().hex}", str(tmp_path / "schema"))

import pytest

from dailyfolio.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=8, partitions=8, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate one expression on literal rows: one(values, type, column -> column)."""

    def run(values, kind, expression):
        rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {kind}")
        out = rows.select("i", expression(rows["x"]).alias("y")).orderBy("i").collect()
        return [r["y"] for r in out]

    return run

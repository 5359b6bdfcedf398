import pytest

from hard_documents import SCHEMA, hard_rows


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from clusterlens.llm.ship import ship

    ship(spark)


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def data(spark):
    return lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")

import pytest


@pytest.fixture(scope="session")
def spark():
    from oracle import session

    spark = session(4)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    from docloom.deploy import ship

    ship(spark)
    return spark


@pytest.fixture(scope="session")
def rows(spark):
    """A DataFrame from tuples and a schema, spread over partitions."""

    def make(data, schema, parts=2):
        return spark.createDataFrame(data, schema).repartition(parts)

    return make

import pytest

from quire.session import ship_package


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)

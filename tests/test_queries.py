import pytest

from spokeflow import catalog
from tests.oracle import SF, connection, same


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, con, name):
    same(catalog.queries()[name](spark, SF), con, catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", ["trailing_wavelet_features", "wheel_turning", "image_geometry", "cart_forest", "stratified_folds"])
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).schema.names == ["user_id", "bin", "click", "view", "purchase", "click_mean"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

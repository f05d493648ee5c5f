import pytest
from compare import both

from lumenfold.plans import alerts, calibration, claims, clusters, copying, feeds, linking, lists, ownership, reads, resolution, scalars, signals  # noqa: F401
from lumenfold.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    ours, wanted = both(spark, QUERIES[name], SQL[name])
    assert ours == wanted and ours

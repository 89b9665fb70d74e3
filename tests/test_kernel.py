import pytest
from compare import compare

from routeloom import catalog
from routeloom.plans import kernel


@pytest.mark.parametrize("name", [n for n, f in catalog.QUERIES.items() if f.__module__ == kernel.__name__])
def test_equals_its_sql(spark, name):
    got, want, _, _ = compare(spark, name, "/root/testdata/sf0.001")
    assert got == want and got[1]

"""Every query of the library against its SQL, and the others for shape, on the smallest tables."""

import pytest
from compare import duck_rows, spark_rows

from quillon.plans import registry

registry.load_all()
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, name):
    assert spark_rows(registry.QUERIES[name](spark, SF)) == duck_rows(SF, registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    """Some rows, each column with a value somewhere, and no value that is not a number."""
    rows = registry.QUERIES[name](spark, SF.replace("0.001", "0.01") if name == "clu1_linkage" else SF).collect()
    assert rows
    for c in rows[0].__fields__:
        values = [r[c] for r in rows if r[c] is not None]
        assert values, c
        assert not any(isinstance(v, float) and v != v for v in values), c


def test_entry_without_the_optional_part(monkeypatch):
    import __spark_entry__

    monkeypatch.setattr(__spark_entry__, "_llm", lambda: ({}, {}))
    assert set(__spark_entry__.queries()) == set(registry.QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(registry.ORACLES)

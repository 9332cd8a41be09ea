import re

import __spark_entry__ as E


def test_entry_runs_on_smoke_data(spark):
    df = E.entry(spark)
    assert df.columns == ["feature", "outlier_count"]
    rows = df.collect()
    assert len(rows) == 3 and rows == sorted(rows, key=lambda r: (-r.outlier_count, r.feature))


def test_registry_contract():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 90 and len(sql) >= 80
    for name in qs:
        assert re.match(r"^[a-z][a-z0-9_]*$", name)

"""Registered tree queries against their SQL at the smallest scale."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from grovekit.plans import registry

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")
NAMES = sorted(registry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("orders", "customer", "nation", "lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = registry.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    rounded = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    expect = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert rounded(tuple(r) for r in df.select(*columns).collect()) == rounded(expect)

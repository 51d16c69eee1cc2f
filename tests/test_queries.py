"""Each query of the engine against its oracle on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import catalog

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return v


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    df = catalog.QUERIES[name](spark, str(FOLDER))
    rows = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in catalog.ORACLES:
        assert rows
        return
    found = oracle.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    want = [tuple(plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)) for r in found.fetchall()]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, rows)) == sorted(map(repr, want))

"""Every query of the catalog against its SQL on the small tables."""

import duckdb
import pytest

from postbag import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set threads=2")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def cell(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(cell(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in catalog.ORACLE_SQL:
        r = duck.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in r.description]
        want = sorted((tuple(cell(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=repr)
        assert got == want
    else:
        assert got

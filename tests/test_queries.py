"""Every query with a twin gives the same rows as DuckDB on the smallest tables that both support."""

import math

import duckdb
import pytest

from corrvox import catalog

DATA = "/root/testdata/sf0.001"
NAMES = sorted(n for n in catalog.oracle_sql() if n not in ("strain_fit", "interpolate_seed_field"))  # these need whole neighbourhoods


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0 if not isinstance(v, (str, bool)) else v
    return sorted((tuple(clean(v[i]) for i in order) for v in values), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "part", "embeddings", "supplier"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    got = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, got.fetchall())

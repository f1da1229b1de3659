"""Every registered query runs; those with SQL agree with DuckDB on the small tables."""

import math

import duckdb
import pytest

from parlance.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows_of(names, rows):
    order = [names.index(c) for c in sorted(names)]
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name in catalog.ORACLE_SQL:
        with duckdb.connect() as c:
            for t in TABLES:
                c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
            cursor = c.execute(catalog.ORACLE_SQL[name])
            names = [d[0] for d in cursor.description]
            assert sorted(names) == sorted(df.columns)
            assert got == rows_of(names, cursor.fetchall())

"""Every registered query of the engine runs on the smallest tables and equals its SQL where it has one."""

import duckdb
import pytest

import __spark_entry__  # noqa: F401, registers the queries
from strandlake.plans import catalog_queries

DATA = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def sorted_rows(rows, names):
    """Rows as text with the columns by name; floats to nine digits, as sums may be taken in another order."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(names), sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog_queries.QUERIES))
def test_query(spark, tables, name):
    df = catalog_queries.QUERIES[name](spark, DATA)
    got = sorted_rows(df.collect(), df.columns)
    assert got[1], "no rows"
    if name in catalog_queries.SQL:
        found = tables.execute(catalog_queries.SQL[name])
        names = [c[0] for c in found.description]
        assert got == sorted_rows(found.fetchall(), names)


def test_strict_errors_with_long_contigs(spark, tmp_path):
    """Contigs longer than 10**9 bases: an end past its contig stays past it."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (l_orderkey + 9000000 * (l_orderkey % 2) AS l_orderkey) FROM '{DATA}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path if t == 'lineitem' else DATA}/{t}.parquet'")
    got = {tuple(r) for r in catalog_queries.QUERIES["strict_errors"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(catalog_queries.SQL["strict_errors"]).fetchall())

"""Every query of the catalogue against its SQL, on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from inkstrata.plans import catalogue, catalogue_drafts, catalogue_media, catalogue_scalars  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return str(v) if not math.isfinite(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    assert rows, "a query over whole tables returns rows"
    if name in catalogue.ORACLE:
        found = duck.execute(catalogue.ORACLE[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == cols
        want = sorted(str([plain(r[names.index(c)]) for c in cols]) for r in found.fetchall())
        assert rows == want


def test_safe_ratios_rounds_as_its_sql_does(spark, tmp_path):
    """Quotients within a rounding error of a half, beyond 2^53 at nine places, and zeros with a sign."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    pairs = [(0.08459310547, 0.0), (0.16344902057, 0.0), (0.12231577551, 0.0), (0.07399052239, 0.0), (1e15, 1.5e-9), (-0.0, 0.05), (-1e-12, 0.3), (float("inf"), 0.5), (1e300, 1e-8), (None, 0.05), (0.05, None), (0.03, 10.24)]
    tax, discount = zip(*pairs, strict=True)
    pq.write_table(pa.table({"l_orderkey": pa.array(range(len(pairs)), "int64"), "l_linenumber": pa.array([1] * len(pairs), "int32"), "l_tax": pa.array(tax, "double"), "l_discount": pa.array(discount, "double")}), tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet')")
    want = sorted(map(repr, con.execute(catalogue.ORACLE["safe_ratios"]).fetchall()))
    assert sorted(repr(tuple(r)) for r in catalogue.QUERIES["safe_ratios"](spark, str(tmp_path)).collect()) == want

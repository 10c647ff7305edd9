"""Every query of the annotation pipeline against its SQL, on the driver's smallest tables."""

import math

import duckdb
import pytest

from sonolith import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def _norm(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_matches_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    want = duck.sql(plans.ORACLE[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    got = sorted((tuple(_norm(r[c]) for c in names) for r in df.collect()), key=_key)
    assert got == sorted((tuple(_norm(r[i]) for i in at) for r in want.fetchall()), key=_key)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def test_fft_agrees_with_dft(spark):
    from pyspark.sql import functions as F

    fft = plans.QUERIES["arr_17_spectrogram_fft"](spark, DATA)
    dft = plans.QUERIES["arr_17_spectrogram_dft"](spark, DATA).withColumn("db2", 10 * F.log10("relative"))
    near = fft.join(dft, ["vec_id", "frame", "bin"]).filter("db > -30").select(F.max(F.abs(F.col("db") - F.col("db2")))).first()[0]
    assert near < 0.01


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(entry.queries())

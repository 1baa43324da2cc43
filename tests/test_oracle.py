"""Every registered spectral query with SQL gives the same rows as DuckDB."""

import duckdb
import pandas as pd
import pytest

from specspark.plans import registry

SF = "/root/testdata/sf0.001"


def canonical(df, columns):
    text = df[columns].map(lambda v: None if pd.isna(v) else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v).astype(str)
    return text.sort_values(columns).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("embeddings", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    pd.testing.assert_frame_equal(canonical(got, columns), canonical(want, columns))


def test_entry_has_rows(spark):
    assert registry.entry(spark, SF).count() == 2

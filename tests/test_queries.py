"""Registered queries against their SQL in an independent database."""

from numbers import Number

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from quillmark.plans import cohort_queries, registry, text_queries
from quillmark.sources.io import TABLES

LIGHT = [n for n, f in registry.QUERIES.items() if n in registry.ORACLE_SQL and f.__module__ in (cohort_queries.__name__, text_queries.__name__)]
STYLE = [registry.FLAGSHIP, "gaussian_nb_priors", "dispersion_identity", "trigram_vocabulary"]


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(v) else round(float(v), 6) if isinstance(v, Number) and not isinstance(v, bool) else str(v) for v in row) for row in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def database(sf_dir):
    made = duckdb.connect()
    for name in TABLES:
        made.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return made


@pytest.mark.parametrize("name", LIGHT + STYLE)
def test_rows_equal_the_sql(spark, sf_dir, database, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), database.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_every_query_has_a_known_name():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert registry.FLAGSHIP in registry.QUERIES

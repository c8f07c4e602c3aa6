"""Every registered query of the auditor against its DuckDB SQL, on the smallest tables."""

import duckdb
import pytest

from prosegauge.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return int(value) if value.is_integer() else round(value, 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = registry.queries()[name](spark, sf)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(want.columns, want.fetchall())


def test_full_audit_runs(spark, sf):
    got = {(r.corpus, r.rule) for r in registry.queries()["full_audit"](spark, sf).collect()}
    assert {("phrases", "legalese"), ("headings", "heading-skip"), ("links", "image-alt")} <= got

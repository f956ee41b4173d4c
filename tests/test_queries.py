"""Every registered query against its twin on the smallest tables."""

import math

import duckdb
import pytest

from quarrylight.plans.registry import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (float, int)) and not isinstance(v, bool) or type(v).__name__ == "Decimal":
        return f"{float(v):.6g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def test_all_have_twins():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DIR)
    cursor = db.execute(SQL[name])
    want_columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(want_columns)
    got, want = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(want_columns, cursor.fetchall())
    assert got == want


# Queries on master ids, whose numbers come from ranges.
RANGED = "master_ids action_list chart_active_users chart_by_day_part consumption dim_content fact_comment fact_recommendation kpi_monthly_lag master_ids_second_run master_members recommendation_conversion_rows alert_value chart_actions".split()


@pytest.mark.parametrize("name", RANGED)
def test_query_over_merged_ranges(spark, db, small_ranges, name):
    test_query(spark, db, name)

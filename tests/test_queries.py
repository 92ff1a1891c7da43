"""A cross-section of the registered queries against their SQL twins; the whole set is run by
tools/check_oracle.py."""

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = ["monthly_coordinates", "min_observed_parts", "date_parsing", "coordinate_repair", "merged_conflicts", "expanded_members",
         "monthly_means", "distinct_counts", "column_profile", "coordinate_summary", "refined_quantiles", "box_statistics",
         "partial_autocorrelation", "exact_split", "aitchison_distance", "variation_matrix", "inverse_balances", "points_in_outline",
         "utm_positions", "nearest_places", "variogram_bins", "month_memory", "month_slices"]


def close(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return abs(a - b) <= 1e-5 * max(1.0, abs(b))
    return str(a) == str(b) if not isinstance(a, (int, float)) else a == b


def key(row):
    return tuple((v is None, round(v, 3) if isinstance(v, float) else v if isinstance(v, (int, bool)) else str(v)) for v in row)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = entry.queries()[name](spark, sf)
    got = sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=key)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    at = [cols.index(c) for c in sorted(cols)]
    want = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=key)
    assert sorted(cols) == sorted(df.columns) and len(got) == len(want) > 0
    assert all(close(a, b) for x, y in zip(got, want) for a, b in zip(x, y))


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    df = entry.entry(spark)
    assert df.columns == ["year", "month", "variable", "value"] and df.count() > 0

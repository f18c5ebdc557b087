import __spark_entry__ as entry_point
import pytest

from stepforge.functions import stats
from stepforge.plans import catalog

SMALL = "/root/testdata/sf0.001"
FORMATS = [n for n, q in catalog.QUERIES.items() if q.__module__.endswith("formats")]


def test_entry_has_a_stable_schema(spark):
    assert set(entry_point.entry(spark).columns) == {"tool", "signal", "tier", "n"}
    assert set(catalog.QUERIES) <= set(entry_point.queries()) and set(catalog.ORACLES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", ["pair_result_for", "r5_redundant", "r4_polls_excluded", "r2b_consumption", "otel_spans", "fault_render", "reproduction_rates", *FORMATS])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "conversations", "orders", "lineitem", "nation", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SMALL)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(map(chr(34).__add__, (c + chr(34) for c in cols)))} FROM ({catalog.ORACLES[name]})").fetchall()
    flat = lambda rows: sorted(str([float(x) if isinstance(x, (int, float)) else x for x in r]) for r in rows)
    left, right = [[r[c] for c in cols] for r in got.collect()], want
    assert flat(left) == flat(right)


def test_bootstrap_query_against_plain_python(spark):
    rows = spark.read.parquet(f"{SMALL}/part.parquet").collect()
    by = {}
    for r in rows:
        by.setdefault(r["p_brand"], []).append(r["p_retailprice"])
    got = {r["p_brand"]: (r["low"], r["high"]) for r in catalog.QUERIES["bootstrap_interval"](spark, SMALL).collect()}
    assert got == {k: pytest.approx(stats.bootstrap_mean(sorted(v))) for k, v in by.items()}

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHEAP = ["pobs_by_flag", "clayton_logpdf_90", "frank_h", "joe_score", "tau_maps", "family_screen_top3", "clayton_by_segment", "rolling_var_cvar", "gas_filter_clayton", "vine3_rosenblatt", "var_cvar_fixed"]


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_its_sql(spark, small, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    want = c.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, small).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (want, got))
    assert a.astype(str).equals(b.astype(a.dtypes.to_dict()).astype(str))

"""The area queries against their oracles at sf0.01, where edges and corners meet by chance; none runs Python."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E

SF_DIR = "/root/testdata/sf0.01"
NAMES = sorted(n for n in E.oracle_sql() if n.endswith("_areas") or "near_edges" in n or n.startswith("spa7_s_contains_")
               or n.startswith(("jn10_batch_contains", "jn10_batch_relate", "til3_til4_clipped", "til7_area")))


@pytest.mark.parametrize("name", NAMES)
def test_area_query(spark, name):
    con = duckdb.connect()
    for t in ("customer", "supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    df = E.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "NestedLoop" not in plan
    cur = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]

    def key(row):
        return tuple(round(v, 3) if isinstance(v, float) else v for v in row)
    assert Counter(key([r[c] for c in cols]) for r in df.collect()) == Counter(map(key, cur.fetchall()))

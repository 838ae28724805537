"""The training-data queries against their SQL on a small table folder."""

import duckdb
import pytest

from corvane.llm.queries import QUERIES
from corvane.llm.sql import SQL

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in "files file_text candidate included_chunk documents eval_item mix_target".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = QUERIES[name](spark, D)
    want = con.execute(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in columns]

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    got = sorted((tuple(plain(v) for v in r) for r in df.select(columns).collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=repr)

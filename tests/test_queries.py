"""Every registered query against its oracle on the smallest tables."""

import math

import duckdb
import pytest

from orrery.plans import registry


def plain(rows):
    one = lambda x: "~" if x is None or isinstance(x, float) and math.isnan(x) else f"{float(x):.6g}" if isinstance(x, int | float) and not isinstance(x, bool) else str(x)
    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_oracle(spark, data, name):
    df = registry.queries()[name](spark, data)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in registry.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = plain(con.sql(f"SELECT {quoted} FROM ({registry.oracle_sql()[name]})").fetchall())
    got = plain(map(tuple, df.select(*columns).collect()))
    assert got == want
    assert got, "an empty result proves nothing"

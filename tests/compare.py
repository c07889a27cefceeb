"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import math
from collections import Counter
from decimal import Decimal


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())


def sql_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    columns = sorted(names)
    place = [names.index(c) for c in columns]
    return columns, Counter(tuple(plain(r[i]) for i in place) for r in result.fetchall())


def assert_same(df, con, sql):
    columns, got = rows_of(df)
    expected_columns, expected = sql_rows(con, sql)
    assert columns == expected_columns
    assert got - expected == Counter(), "rows only in Spark"
    assert expected - got == Counter(), "rows only in SQL"

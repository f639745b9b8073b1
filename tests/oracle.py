"""Compares a query's rows with those of its DuckDB SQL, whatever their order."""

import datetime
import math
from pathlib import Path

import duckdb


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return [plain(x) for x in value] if isinstance(value, list | tuple) else value


def assert_same(spark, sf_dir, query, sql):
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    want = sorted((tuple(plain(row[i]) for i in order) for row in result.fetchall()), key=repr)
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    assert columns == sorted(names)
    got = sorted((tuple(plain(v) for v in row) for row in df.select(*columns).collect()), key=repr)
    assert got == want

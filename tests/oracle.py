"""Compare a query's rows with those of its DuckDB SQL."""

import math

import duckdb

from docloom.session import TABLES

KINDS = {"bigint": {"BIGINT", "HUGEINT"}, "int": {"INTEGER", "BIGINT"}, "string": {"VARCHAR"}, "double": {"DOUBLE"}, "boolean": {"BOOLEAN"}}


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def assert_same(frame, sql, sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    columns = sorted(frame.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    types = {d[0]: str(d[1]).upper() for d in result.description}
    for column, kind in frame.dtypes:
        assert types[column] in KINDS[kind] | {"NUMBER"}, (column, kind, types[column])
    place = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in place) for r in result.fetchall()), key=repr)
    assert ours == theirs

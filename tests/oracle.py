"""Run registered queries against their SQL in DuckDB and report differences."""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder):
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    return sorted(([columns[at] for at in order], *[[plain(row[at]) for at in order] for row in rows])[1:], key=repr)


def difference(spark, connection, folder, query, sql):
    """None, or a description of how the results differ."""
    frame = query(spark, folder)
    ours = rows_of(frame.columns, [tuple(row) for row in frame.collect()])
    result = connection.sql(sql)
    theirs = rows_of(result.columns, result.fetchall())
    if sorted(frame.columns) != sorted(result.columns):
        return f"columns {sorted(frame.columns)} and {sorted(result.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(wrong)} of {len(ours)} rows differ, first {wrong[0]}" if wrong else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from retentia.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in oracles:
                found = difference(spark, connection, folder, query, oracles[name]) or "ok"
            else:
                found = f"{len(query(spark, folder).collect())} rows"
        except Exception as error:  # report and go on
            found = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:28s} {time.time() - start:6.2f}s  {found}", flush=True)

"""Compare a registered query with its expected result; also a command line tool."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TESTDATA = "/root/testdata"


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(frame, columns):
    # whole numbers with nulls come as floats from one side and as integers from the other
    frame = frame[columns].convert_dtypes(convert_string=False, convert_boolean=False).astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


def difference(df, con, sql: str) -> str | None:
    """None if the rows are the same whatever their order, else what differs."""
    got, want = df.toPandas(), con.execute(sql).df()
    columns = sorted(got.columns)
    if columns != sorted(want.columns):
        return f"columns {columns} != {sorted(want.columns)}"
    a, b = _rows(got, columns), _rows(want, columns)
    if a == b:
        return None
    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return f"{len(a)} rows != {len(b)} rows\n  {columns}\n  only query:  {only_a}\n  only oracle: {only_b}"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from fwlog.session import local_session

    sf_dir = f"{TESTDATA}/sf{sys.argv[1]}"
    spark = local_session("compare")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    names = sys.argv[2:] or list(entry.queries())
    for name in names:
        begin = time.time()
        try:
            result = difference(entry.queries()[name](spark, sf_dir), con, entry.oracle_sql()[name])
        except Exception as error:  # report and go on with the next query
            result = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if result is None else 'DIFF'} {time.time() - begin:6.1f}s {name} {result or ''}", flush=True)

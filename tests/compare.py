"""Run registered queries against their DuckDB SQL: ``python tests/compare.py SF_DIR [names]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or isinstance(value, str):
        return value
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> tuple[bool, str]:
    """Exact comparison of column names, row count and values; and what differs first."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = _sorted_rows(names, result.fetchall())
    ours = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} / {sorted(names)}"
    if len(ours) != len(theirs):
        return False, f"rows {len(ours)} / {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs)
           if a != b or [type(x) for x in a] != [type(x) for x in b]]
    return not bad, f"{len(ours)} rows" + (f", {len(bad)} differ: {bad[0]}" if bad else "")


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from lumisweep.session import build_session

    folder = sys.argv[1]
    spark = build_session(master="local[8]", shuffle_partitions=8)
    connection = connect(folder)
    sqls = oracle_sql()
    for key, build in queries().items():
        if sys.argv[2:] and key not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            frame = build(spark, folder)
            if key in sqls:
                ok, note = compare(frame, connection, sqls[key])
            else:
                ok, note = True, f"no SQL, {frame.count()} rows"
        except Exception as error:  # report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        print(f"{'ok  ' if ok else 'FAIL'} {key:24s} {time.time() - start:6.1f}s {note}", flush=True)

"""Compare queries with their oracles: ``python -m workload.check <sf_dir> [name ...]``."""

from __future__ import annotations

import sys
import time

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels
conversations""".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c] + 0.0  # no negative zero
    return frame.sort_values(list(frame.columns), ignore_index=True)


def difference(got, want) -> str | None:
    """None when equal, else the first thing that differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    got, want = canonical(got), canonical(want)
    for c in got.columns:
        a, b = got[c], want[c]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            at = (~same).idxmax()
            return f"{c}: {(~same).sum()} values differ, first {a[at]!r} / {b[at]!r}"
        if a.dtype != b.dtype and not (a.dtype.kind in "if" and b.dtype.kind in "if"):
            return f"{c}: type {a.dtype} / {b.dtype}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    from starloom.session import build_session
    from workload.oracles import ORACLES
    from workload.queries import QUERIES

    spark = build_session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in names or QUERIES:
        start = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
            spent = time.time() - start
            if name in ORACLES:
                start = time.time()
                problem = difference(got, con.execute(ORACLES[name]).fetchdf())
                note = f"(duckdb {time.time() - start:.1f}s)"
            else:
                problem, note = (None if len(got) else "no rows"), "rows only"
        except Exception as error:  # noqa: BLE001
            problem, spent, note, got = f"{type(error).__name__}: {str(error)[:600]}", time.time() - start, "", []
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {len(got)} rows {spent:.1f}s {note} {problem or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))

"""Run queries beside their SQL: python tests/oracle.py [--sf DIR] [NAME...]"""

from __future__ import annotations

import glob
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = Path(path).stem
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def canonical(rows: list, names: list[str]) -> list:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        if isinstance(v, (list, tuple)):
            return str([plain(x) for x in v])
        return str(v)

    return sorted([plain(r[i]) for i in order] for r in rows)


def compare(spark, con, f, sql: str, sf_dir: str) -> str:
    """Empty if the query and its SQL agree, else what differs."""
    df = f(spark, sf_dir)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = canonical(cursor.fetchall(), names)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got == want:
        return ""
    odd = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:2]
    return f"{len(got)} and {len(want)} rows; " + "; ".join(f"{str(a)[:400]} <> {str(b)[:400]}" for a, b in odd)


def main(args: list[str]) -> int:
    sf_dir = args[args.index("--sf") + 1] if "--sf" in args else "/root/testdata/sf0.01"
    names = [a for i, a in enumerate(args) if not a.startswith("--") and (i == 0 or args[i - 1] != "--sf")]
    import __spark_entry__ as e

    spark, con, bad = session(), duck(sf_dir), 0
    sql = e.oracle_sql()
    for name, f in e.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            said = compare(spark, con, f, sql[name], sf_dir) if name in sql else f"rows only: {f(spark, sf_dir).count()}"
        except Exception as x:  # noqa: BLE001
            said = f"{type(x).__name__}: {str(x)[:1500]}"
        bad += bool(said) and not said.startswith("rows only")
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

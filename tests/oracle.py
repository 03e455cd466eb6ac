"""Compares a registered query with its SQL on the same tables."""

import datetime
import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, int):
        return x
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in x.asDict().items()))
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    return float(x) if type(x).__name__ == "Decimal" else x


def difference(spark, query, sql, sf_dir):
    """None if the rows are equal, else what differs."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    if sorted(cols) != names:
        return f"columns {names} and {sorted(cols)}"
    rows = [dict(zip(cols, r)) for r in rel.fetchall()]
    want = sorted((tuple(plain(r[c]) for c in names) for r in rows), key=repr)
    if got == want:
        return None
    g, w = set(map(repr, got)), set(map(repr, want))
    return f"{len(got)} rows and {len(want)}; only ours: {sorted(g - w)[:3]}; only SQL's: {sorted(w - g)[:3]}"[:1500]


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    q, o = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[1:] or q:
        t = time.time()
        try:
            said = difference(spark, q[name], o[name], sf) if name in o else f"{q[name](spark, sf).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {str(e)[:1800]}"
        bad += bool(said and "no SQL" not in said)
        print(f"{name}: {said or 'equal'} ({time.time() - t:.1f} s)", flush=True)
    print("differ:", bad)

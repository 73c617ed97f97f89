"""Run registered queries beside their SQL in DuckDB: python -m tests.check [sf] [keys..]."""

import sys
import threading
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype).startswith(("str", "bool")):
            df[c] = df[c].map(lambda v: "None" if v is None or v is pd.NA or v != v else str(v))
        else:
            df[c] = df[c].map(lambda v: "None" if pd.isna(v) else repr(float(v)))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame):
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} <> {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} <> {len(want)}"
    a, b = canonical(got), canonical(want)
    bad = (a != b).any(axis=1)
    if bad.any():
        cols = [c for c in a.columns if (a[c] != b[c]).any()]
        return f"{int(bad.sum())} of {len(a)} rows differ in {cols}\n{a[bad].head(4)}\n{b[bad].head(4)}"
    return None


def main():
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    picks = sys.argv[2:] or list(queries)
    bad = 0
    for key in picks:
        t0 = time.time()
        try:
            got = queries[key](spark, sf_dir).toPandas()
            t1 = time.time()
            note = "rows-only"
            if key in oracle:
                alarm = threading.Timer(60, con.interrupt)
                alarm.start()
                want = con.execute(oracle[key]).df()
                alarm.cancel()
                note = compare(got, want) or "match"
        except Exception as e:  # report and go on
            t1 = time.time()
            note, got = f"ERROR {type(e).__name__}: {str(e)[:1500]}", []
        t2 = time.time()
        if note not in ("match", "rows-only"):
            bad += 1
        print(f"{key:32s} rows={len(got):7d} spark={t1 - t0:6.2f}s duck={t2 - t1:6.2f}s {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()

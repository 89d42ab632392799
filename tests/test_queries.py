import os
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from albumlake.operators import library  # noqa: E402

DATA = "/root/testdata/sf0.001"


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime") or df[c].map(lambda v: hasattr(v, "isoformat")).any():
            df = df.assign(**{c: pd.to_datetime(df[c]).astype("datetime64[us]").astype(str)})
    df = df.astype(object).where(df.notna(), None)
    return df.sort_values(list(df.columns), key=lambda s: s.map(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    want = ordered(con.execute(entry.oracle_sql()[name]).df())
    got = ordered(entry.queries()[name](spark, DATA).toPandas())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_memories_windows(spark):
    dates = ["2001-06-15", "2004-06-15", "2003-06-09", "2001-06-30", "2002-01-01", "1985-12-31", "2011-02-02"]
    df = spark.createDataFrame(list(enumerate(dates)), "file_id long, captured string").withColumn("captured", F.col("captured").cast("timestamp_ntz"))
    got = {tuple(r) for r in library.memories(df, "2002-06-15").collect()}  # in ISO week 24
    day = {(0, "Day", 2001, 1), (1, "Day", 2004, -2)}
    week = {(0, "Week", 2001, 1), (2, "Week", 2003, -1)}
    month = {(0, "Month", 2001, 1), (1, "Month", 2004, -2), (2, "Month", 2003, -1), (3, "Month", 2001, 1)}
    assert got == day | week | month | {(4, "Year", 2002, 0), (5, "Decade", 1980, 17), (6, "Decade", 2010, -13)}


def test_burst_gaps_over_midnight_spread_by_day(spark):
    times = [None, "2024-01-01 23:59:58", "2024-01-01 23:59:59", "2024-01-02 00:00:01", "2024-01-02 00:00:09", "2024-01-04 00:00:00", "2024-01-04 00:00:02"]
    rows = [(i, o, f"n{i}", t) for i, t in enumerate(times) for o in ("a", None)]
    df = spark.createDataFrame(rows, "file_id long, owner string, name string, captured string").withColumn("captured", F.col("captured").cast("timestamp_ntz"))
    made = library.burst_gaps(df, ["owner"], 2)
    assert {tuple(r) for r in made.collect()} == {(i, o, n) for i, n in enumerate([1, 2, 2, 2, 3, 4, 4]) for o in ("a", None)}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    over_photos = [x for x in plan.split("\n") if "Window" in x and "lag(captured" in x]
    assert over_photos and all("_day" in x for x in over_photos)

"""Queries over events with odd times, held against their SQL."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry

DAY = datetime.datetime(2024, 3, 31)
TIMES = [DAY - datetime.timedelta(microseconds=m) for m in (1, 499_999, 500_000, 500_001, 1_500_000)]
TIMES += [DAY, DAY + datetime.timedelta(hours=3), datetime.datetime(1969, 12, 31, 12), datetime.datetime(1968, 5, 1, 23, 59, 59, 700_000), None]


def against_sql(spark, folder, name, kind):
    rows = [(i * 5 + j, t, i % 3, ("view", "click", "error")[(i + j) % 3], float((i * 7 + j) % 4)) for i in range(6) for j, t in enumerate(TIMES)]
    rows.append((None, DAY, 1, "view", 3.0))
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    events = events.withColumn("ts", events.ts.cast(kind))
    events.coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(folder)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(con.execute(entry.oracle_sql()[name]).fetchall(), key=repr) and got


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_busy_shares_at_the_edges_of_days(spark, tmp_path, kind):
    against_sql(spark, tmp_path, "busy_shares", kind)


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_working_sets_at_the_edges_of_days(spark, tmp_path, kind):
    against_sql(spark, tmp_path, "working_sets", kind)

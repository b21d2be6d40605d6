import datetime as dt

from lodestone.streaming import windows

START = dt.datetime(2024, 1, 1)


def rows():
    return [(i, START + dt.timedelta(minutes=7 * i), i % 3, "ab"[i % 2], float(i), None) for i in range(60)]


def test_stream_equals_table(spark, tmp_path):
    df = spark.createDataFrame(rows(), windows.EVENTS)
    df.write.parquet(f"{tmp_path}/in")
    stream = windows.tumbling(windows.event_stream(spark, f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got, want = spark.table("windows").collect(), windows.tumbling(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and sum(r.n for r in got) == 60


def test_sessions(spark):
    df = spark.createDataFrame([(0, START, 1, "a", 1.0, None), (1, START + dt.timedelta(minutes=20), 1, "a", 1.0, None), (2, START + dt.timedelta(minutes=90), 1, "a", 1.0, None)], windows.EVENTS)
    assert sorted(r.n for r in windows.sessions(df).collect()) == [1, 2]

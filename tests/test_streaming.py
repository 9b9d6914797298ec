import datetime as dt

from lodegraph.streaming import events as E

SCHEMA = "ts timestamp, user string, event_type string, value double, failed boolean"


def write(spark, folder, batches):
    t0 = dt.datetime(2024, 1, 1)
    for n, rows in enumerate(batches):
        spark.createDataFrame([(t0 + dt.timedelta(seconds=s), u, k, v, f) for s, u, k, v, f in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/b{n}")


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_windows_sessions_and_breaker(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, [[(0, "a", "x", 1.0, True), (10, "a", "x", 2.0, True), (7200, "a", "y", 1.0, False)], [(60, "a", "x", 9.0, False), (9000, "a", "x", 1.0, False)], [(90000, "b", "x", 1.0, False)]])
    src = E.read_events(spark, folder + "/*", SCHEMA)
    counts = {(r.start.hour, r.event_type): (r.n, r.total) for r in run(E.windowed_counts(src, "ts", "event_type"), "w1")}
    assert counts[(0, "x")][0] in (2, 3) and counts[(2, "y")] == (1, 1.0)
    assert any(r.n == 2 or r.n == 3 for r in run(E.sessions(E.read_events(spark, folder + "/*", SCHEMA), "ts", "user"), "w2"))
    states = [r.state for r in sorted(run(E.circuit_breaker(E.read_events(spark, folder + "/*", SCHEMA, 10), "user", "ts", "failed", threshold=2), "w3"), key=lambda r: (r.key, r.ts))]
    assert states == ["CLOSED", "OPEN", "CLOSED", "CLOSED", "CLOSED", "CLOSED"]


def test_append_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, [[(0, "a", "x", 1.0, True)], [(1, "a", "x", 2.0, True)]])
    for _ in range(2):
        E.append_once(E.read_events(spark, folder + "/*", SCHEMA), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2

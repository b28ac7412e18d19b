"""Streams of frames give what a batch gives."""

from datetime import datetime

from reelscribe.streaming import frames


def run(df, mode, name):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    times = [0.0, 250.0, 200.0, 500.0, 500.0]
    rows = [(1, datetime(2024, 1, 1, 0, 0, i), t, 3) for i, t in enumerate(times)] + [(2, datetime(2024, 1, 1, 0, 2, 0), 0.0, 1)]
    schema = "recording_id long, ts timestamp, time_ms double, n_lines int"
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(schema).parquet(path)
    got = {r.recording_id: (r.n_frames, r.n_disordered, r.last_ms) for r in run(frames.monotonic_times(stream), "update", "times").collect()}
    assert got[1][0] == 5 and got[1][2] == 500.0 and got[1][1] >= 1 and got[2] == (1, 0, 0.0)
    counts = run(frames.windowed_counts(stream), "complete", "counts").collect()
    assert {(r.recording_id, r.n_frames, r.n_lines) for r in counts} == {(1, 5, 15), (2, 1, 1)}

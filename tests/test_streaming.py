"""Streams fed file by file: state goes on from batch to batch."""

from pyspark.sql import functions as F

from atrium.streaming import changes


def events(spark, folder, batches):
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "event_id long, sec long, user_id long, event_type string, value double")
        df.select("event_id", F.timestamp_seconds("sec").alias("ts"), "user_id", "event_type", "value").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return changes.source(spark, folder, "events")


BATCHES = [[(1, 10, 1, "a", 1.0), (2, 20, 1, "a", 2.0), (3, 30, 2, "b", 1.0)], [(4, 40, 1, "b", 1.0), (5, 50, 2, "b", 4.0)], [(6, 60, 1, "b", 1.0), (7, 70, 2, "a", 1.0), (8, 80, 3, "a", 1.0)]]


def test_changes_of_state_over_batches(spark, tmp_path):
    out = changes.drained(changes.state_changes(events(spark, str(tmp_path), BATCHES)), "changes")
    assert sorted((r.event_id, r.was, r.now, r.kind) for r in out.collect()) == [(1, None, "a", "connect"), (3, None, "b", "connect"), (4, "a", "b", "handover"), (7, "b", "a", "handover"), (8, None, "a", "connect")]


def test_a_key_whose_rows_come_in_several_frames(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        rows = [(n, n, n % 2, "ab"[n // 3 % 2], 1.0) for n in range(40)]
        out = changes.drained(changes.state_changes(events(spark, str(tmp_path), [rows])), "changes").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last, want = {}, []
    for n, _, user, kind, _ in rows:
        if last.get(user) != kind:
            want.append((n, last.get(user), kind))
        last[user] = kind
    assert sorted((r.event_id, r.was, r.now) for r in out) == want


def test_last_row_of_each_key_is_kept_current(spark, tmp_path):
    out = changes.kept_current(events(spark, str(tmp_path), BATCHES), ["user_id"], "event_id", str(tmp_path / "current"))
    assert sorted((r.user_id, r.event_id) for r in out.collect()) == [(1, 6), (2, 7), (3, 8)]


def test_commands_sent_again_are_taken_once(spark, tmp_path):
    stream = events(spark, str(tmp_path), [*BATCHES, BATCHES[0]]).withColumnRenamed("event_id", "seq")
    assert sorted(r.seq for r in changes.drained(changes.once_each(stream), "once").collect()) == list(range(1, 9))


def test_windows_close_when_the_watermark_passes(spark, tmp_path):
    late = [[(1, 0, 1, "a", 1.0), (2, 3000, 1, "a", 2.0)], [(3, 9000, 1, "a", 1.0)], [(6, 9100, 1, "a", 1.0)], [(7, 9200, 1, "a", 1.0)], [(4, 100, 1, "a", 5.0)], [(5, 20000, 1, "a", 1.0)]]
    out = changes.drained(changes.windowed_counts(events(spark, str(tmp_path), late)), "windows")
    assert sorted((r.w.start.timestamp(), r.n, r.total) for r in out.collect())[0] == (0.0, 2, 3.0)

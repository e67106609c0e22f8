import json
import time
from datetime import datetime

from constella.streaming import progress, runlog


def test_log_folds_and_resumes(spark, tmp_path):
    at = lambda: datetime(2026, 1, 2, 3, 4, 5)
    log, again, third = (runlog.RunLog(spark, f"file://{tmp_path}", "/r", now=at) for _ in range(3))
    assert [x.run_id for x in (log, again, third)] == ["2026-01-02--03-04-05", "2026-01-02--03-04-05-1", "2026-01-02--03-04-05-2"]
    for d, e in (("a", "completed"), ("b", "failed"), ("c", "started"), ("s", "skipped")):
        log.emit_all([{"event_type": "directory_discovered", "sample_dir": d, "attempt": 0}, {"event_type": f"directory_{e}", "sample_dir": d, "attempt": 1}])
    folder = tmp_path / log.run_id
    (folder / "events-000004.jsonl").unlink()
    (folder / ".events-000004.jsonl.crc").unlink()
    (folder / "events-000004.jsonl").write_text('\n{broken\n{"event_type": "directory_skipped", "sample_dir": "s", "attempt": 1, "run_id": "%s"}\n' % log.run_id)
    log.finish()
    events = runlog.read_events(spark, log.folder)
    states = runlog.fold(events)
    assert {r.sample_dir: (r.state, r.attempts) for r in states.collect()} == {"a": ("completed", 1), "b": ("failed", 1), "c": ("running", 1), "s": ("skipped", 1)}
    assert runlog.run_status(events).first().run_status == "completed"
    assert json.loads((folder / "summary.json").read_text())["counts"] == {"completed": 1, "failed": 1, "running": 1, "skipped": 1}
    doc = runlog.summary(events).first()
    assert doc.directory_states["b"] == "failed" and doc.counts["completed"] == 1 and doc.attempts["c"] == 1
    dirs = spark.createDataFrame([(d,) for d in "abcsn"], "sample_dir string")
    plan = {r.sample_dir: (r.action, r.attempt) for r in runlog.resume_plan(dirs, states).collect()}
    assert plan == {"a": ("skip", 1), "b": ("skip", 1), "c": ("process", 2), "s": ("skip", 1), "n": ("process", 1)}
    retried = {r.sample_dir: r.action for r in runlog.resume_plan(dirs, states, retry_failed=True).collect()}
    assert retried["b"] == "process"
    assert runlog.latest_run_id(spark, f"file://{tmp_path}") == third.run_id


def test_run_ids_sort_by_their_number():
    ids = ["2026-01-02--03-04-05-10", "2026-01-02--03-04-05-2", "2026-01-02--03-04-05"]
    assert sorted(ids, key=runlog.run_order) == ids[::-1]


def test_stream_equals_batch(spark, tmp_path):
    lines = [{"ord": k, "sample_dir": f"d{k % 3}", "event_type": t, "attempt": k % 4} for k, t in enumerate(["directory_started", "directory_failed", "run_started", "directory_completed", "directory_queued", "directory_skipped", "directory_started"])]
    kind = "ord long, sample_dir string, event_type string, attempt int"
    (tmp_path / "in").mkdir()
    for k in range(0, len(lines), 3):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, lines[k : k + 3])))
    batch = {tuple(r) for r in runlog.fold(spark.read.schema(kind).json(f"file://{tmp_path}/in")).collect()}
    seen = progress.attach(spark)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    query = runlog.fold_stream(stream).writeStream.format("memory").queryName("folded").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    for _ in range(100):
        if sum(seen.rows.values()) == len(lines):
            break
        time.sleep(0.1)
    assert sum(seen.rows.values()) == len(lines) and max(seen.batches.values()) >= 3 and not seen.errors
    spark.streams.removeListener(seen)
    assert {tuple(r) for r in spark.table("folded").collect()} == batch


def test_windowed_counts(spark):
    events = spark.sql("select * from values (timestamp'2026-01-01 00:10:00', 'a'), (timestamp'2026-01-01 00:50:00', 'a'), (timestamp'2026-01-01 01:00:00', 'b') as t(ts, event_type)")
    assert sorted((r.window_start.hour, r.event_type, r.n) for r in runlog.windowed_counts(events, "ts", "1 hour").collect()) == [(0, "a", 2), (1, "b", 1)]

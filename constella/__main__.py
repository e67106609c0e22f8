"""python -m constella ROOT: a resumable batch over the sample directories below ROOT.

With ``--decisions FILE`` the review decisions of a CSV (sample_dir, red_square, green_square, index) are applied to
the results of an earlier batch instead.
"""

from __future__ import annotations

import logging

from pyspark.sql import functions as F

from constella.functions import naming as N
from constella.plans import approval, batch
from constella.session import arguments, session
from constella.sources import images as sources, results, store
from constella.streaming import runlog

LOG = logging.getLogger("constella")


def main(argv: list[str] | None = None) -> int:
    args = arguments(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.WARNING)
    spark = session(master=args.master)
    out = store.qualified(spark, args.out or f"{args.root}/constella")
    if args.decisions:
        approval.apply(spark, out, approval.read_decisions(spark, args.decisions))
        return 0
    base = f"{out}/runs"
    resume = runlog.latest_run_id(spark, base) if args.resume_latest else args.resume
    states = runlog.fold(runlog.read_events(spark, f"{base}/{resume}")) if resume else None
    dirs = sources.sample_dirs(spark, args.root).withColumn("path", F.col("sample_dir"))
    planned = runlog.resume_plan(dirs.withColumn("sample_dir", N.directory_key("path", F.lit(args.root))), states, args.retry_failed)
    plan = planned.collect()  # one row per directory
    todo, skipped = [r for r in plan if r.action == "process"], [r for r in plan if r.action == "skip"]
    log = runlog.RunLog(spark, base, args.root, resume_from=resume)
    told = lambda kind, rows, **more: [{"event_type": f"directory_{kind}", "sample_dir": r.sample_dir, "attempt": r.attempt} | {k: f(r) for k, f in more.items()} for r in rows]
    try:
        log.emit_all([{"event_type": "directory_discovered", "sample_dir": r.sample_dir, "attempt": 0} for r in plan])
        log.emit_all(told("skipped", skipped, skip_reason=lambda r: r.skip_reason, resume_source_run_id=lambda _: resume) + told("started", todo))
        failed: dict[str, str] = {}
        if todo:
            chosen = spark.createDataFrame([(r.path,) for r in todo], "path string")
            batch.run_batch(spark, args.root, out, log.run_id, opening_mode=args.opening, directories=chosen, everything=args.process_only or args.always_process, match=not args.process_only, pictures=args.annotate)
            failed = _failed(spark, out, chosen)
        log.emit_all(told("completed", [r for r in todo if r.path not in failed]) + told("failed", [r for r in todo if r.path in failed], error_message=lambda r: failed[r.path]))
        if not args.process_only:
            results.write_master(spark, out)
    except BaseException:
        log.finish(aborted=True)
        raise
    log.finish()
    return int(bool(failed))


def _failed(spark, out: str, directories) -> dict[str, str]:
    """The directories of which no image could be processed, with an image's error; warnings and errors of all are logged."""
    done = batch.current(spark, out)
    if done is None:
        return {}
    rows = done.join(directories.withColumnRenamed("path", "sample_dir"), "sample_dir", "left_semi")
    if LOG.isEnabledFor(logging.DEBUG):
        for r in rows.filter("error is not null or warning is not null").select("path", "error", "warning").toLocalIterator():
            LOG.debug("%s: %s", r.path, r.error or r.warning)
    per = rows.groupBy("sample_dir").agg(F.count(F.when(F.col("error").isNull(), 1)).alias("good"), F.min("error").alias("error"))
    return {r.sample_dir: r.error for r in per.filter("good = 0").collect()}  # at most one row per directory


if __name__ == "__main__":
    raise SystemExit(main())

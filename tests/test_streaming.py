"""Progress as a stream with state, replayed out of order, repeated, and over restarts."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from clausewright import schemas
from clausewright.operators import reports as R
from clausewright.streaming import live

START = datetime(2024, 5, 1, 12, 0)


def rows_of(spark, events):
    names = [c.split()[0] for c in schemas.COMPARISONS.split(", ")]
    made = [{"comparison_id": c, "status": s, "progress": p, "current_stage": g, "created_at": START.isoformat(), "logged_at": (START + timedelta(seconds=t)).isoformat()} for c, s, p, g, t in events]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in made], schemas.COMPARISONS)


def test_progress_is_the_log(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("log", "out", "checkpoint"))
    rng = random.Random(2)
    stages = [("processing", 5.0, "extraction"), ("processing", 15.0, "parsing"), ("processing", 30.0, "alignment"), ("completed", 100.0, "completed")]
    events = [(f"C{k}", *stages[i], 10 * i + k) for k in range(9) for i in range(k % 4 + 1)]
    events += rng.sample(events, 8)
    rng.shuffle(events)
    for part in (events[:9], events[9:20], events[20:]):
        rows_of(spark, part).write.mode("append").parquet(source)
        live.follow(spark, source, out, checkpoint).awaitTermination()
    log = spark.read.schema(schemas.COMPARISONS).parquet(source)
    fields = ["comparison_id", "status", "progress", "current_stage"]
    want = {tuple(r) for r in R.latest_by(log, ["comparison_id"], [F.desc("logged_at"), F.desc("progress")]).select(*fields).collect()}
    state = live.current(spark, out)
    assert {tuple(r) for r in state.select(*fields).collect()} == want and len(want) == 9
    shown = R.with_progress(R.comparisons(log), state).select(*fields)
    assert {tuple(r) for r in shown.collect()} == want
    # another run moves time on: whoever still ran has failed, and who logs again runs again
    rows_of(spark, [("late", *stages[0], 9000)]).write.mode("append").parquet(source)
    live.follow(spark, source, out, checkpoint).awaitTermination()
    rows_of(spark, [("late", *stages[1], 9010), ("C1", *stages[2], 9020)]).write.mode("append").parquet(source)
    live.follow(spark, source, out, checkpoint).awaitTermination()
    got = {r.comparison_id: r.status for r in live.current(spark, out).collect()}
    assert got == {"late": "processing", "C1": "processing"} | {c: "completed" if s == "completed" else "failed" for c, s, _, _ in want if c != "C1"}

"""The event log across restarts, and runs against a plain fold."""

from __future__ import annotations

import random

from corpuskiln.streaming import run_log

SCHEMA = "run_id string, kind string, label string, event string, key string, detail string, seq long"


def plain_run(events):
    steps, status, ended, error = [], "RUNNING", None, ""
    for e in sorted(events, key=lambda e: e[6]):
        if e[3] == "START":
            steps.append([e[4], "RUNNING", e[6], None, ""])
        elif e[3] in ("END", "FAIL"):
            for s in reversed(steps):
                if s[0] == e[4] and s[1] == "RUNNING":
                    s[1], s[3], s[4] = ("SUCCESS", e[6], "") if e[3] == "END" else ("FAILED", e[6], (e[5] or "")[:1200])
                    break
        elif e[3] in ("DONE", "ABORT"):
            status, ended, error = ("SUCCESS", e[6], "") if e[3] == "DONE" else ("FAILED", e[6], (e[5] or "")[:1200])
    return status, ended, error, steps


def test_runs_equal_a_plain_fold(spark):
    rng = random.Random(1)
    runs = {f"r{i}": [(f"r{i}", f"k{i % 3}", f"l{i}", rng.choice(["START", "START", "END", "FAIL", "RUN", "DONE", "ABORT"]), rng.choice("abc"), rng.choice([None, "x", "y" * 1500]), 100 * i + n) for n in range(rng.randint(1, 20))] for i in range(60)}
    df = spark.createDataFrame([e for es in runs.values() for e in rng.sample(es, len(es))], SCHEMA)
    found = {r.run_id: r for r in run_log.runs(df).collect()}
    for run, events in runs.items():
        status, ended, error, steps = plain_run(events)
        r = found[run]
        assert (r.status, r.ended, r.error, r.kind, r.started) == (status, ended, error, events[0][1], events[0][6])
        assert [list(s) for s in r.steps] == steps
    last = run_log.compacted(run_log.runs(df), most=4)
    assert sorted(r.run_id for r in last.collect()) == sorted(f"r{i}" for k in range(3) for i in range(k, 60, 3) if i >= 48)


def test_a_restart_leaves_no_doubles_and_secrets_stay_out(spark, tmp_path):
    source, log, checkpoint = (str(tmp_path / n) for n in ("source", "log", "checkpoint"))
    event = lambda i, detail="": (f"r{i}", "k", "l", "RUN", None, detail, i)
    batches = [[event(1), event(2, '{"Token": "x"}'), event(3, "a token")], [event(4), event(5, '{"a": "{\\"password\\": 1}"}')]]

    def run():
        query = run_log.append_events(spark.readStream.schema(SCHEMA).json(source), log, checkpoint)
        query.awaitTermination()

    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(source)
        run()
    # Batches that had been written when the stream died are written again.
    run_log.write_batch(spark.createDataFrame(batches[1], SCHEMA), 1, log)
    run()
    assert sorted(r.run_id for r in run_log.read_events(spark, log).collect()) == ["r1", "r3", "r4"]
    assert sorted((r.run_id, r.reason) for r in run_log.read_events(spark, log, "refused").collect()) == [("r2", "SECRET_KEY"), ("r5", "SECRET_KEY")]
    assert run_log.compact(spark, log, 1, most=2).count() == 2 and run_log.compact(spark, log, 1, most=1).count() == 1

"""Admission over time against a plain version; keyed state across restarts, timers and repeated runs."""

from __future__ import annotations

import random
import time

import pytest

from tessitura.streaming import gate, jobs

UPLOAD, EVENT = "id long, fingerprint string, seq long", "job_id long, state string, seq long"


@pytest.mark.parametrize(("limit", "workers"), [(8, 1), (3, 2), (1, 1)])
def test_admissions_by_brute_force(spark, limit, workers):
    rng = random.Random(limit)
    rows = [(i, rng.choice(["a", "b", "b", "b"]), rng.randrange(60), rng.randrange(-2, 12)) for i in range(300)]
    more = [(900, None, 5, 5), (901, "a", None, 5), (902, "b", 7, None)]
    want = {i: (None, None, None) for i, *_ in more}
    for q in "ab":
        admitted, free = [], [-1] * workers
        for i, _, at, takes in sorted((r for r in rows if r[1] == q), key=lambda r: (r[2], r[0])):
            active = sum(e > at for e in admitted)
            if active >= limit:
                want[i] = (429, active, None)
                continue
            k = free.index(min(free))
            free[k] = max(free[k], at) + max(0, takes)
            admitted.append(free[k])
            want[i] = (202, active, free[k])
    frame = spark.createDataFrame([*rows, *more], "job_id long, queue string, at long, takes long").repartition(3)
    got = {r["job_id"]: (r["status"], r["active"], r["ends"]) for r in jobs.admissions(frame, limit=limit, workers=workers).collect()}
    assert got == want and {s for s, *_ in got.values()} == {None, 202, 429}
    assert jobs.admissions(frame.limit(0)).count() == 0


def test_jobs_restart_and_stale(spark, tmp_path):
    """The machine goes on from its checkpoint, equals the batch form, and ends jobs that hear nothing."""
    path, rng = str(tmp_path), random.Random(4)
    events = [(rng.randrange(6), rng.choice(["PENDING", "RUNNING", "SUCCEEDED", "FAILED"]), k) for k in range(60)] + [(50, "PENDING", 60), (51, "PENDING", 61), (51, "RUNNING", 62)]
    run = lambda stale=10**7: jobs.run_jobs(spark.readStream.schema(EVENT).parquet(f"{path}/in"), f"{path}/out", f"{path}/checkpoint", stale).awaitTermination()
    for part in (events[:25], events[25:]):
        spark.createDataFrame(part, EVENT).write.mode("append").parquet(f"{path}/in")
        run()
    table = lambda: {r["job_id"]: (r["state"], r["ignored"]) for r in jobs.job_table(spark, f"{path}/out").collect()}
    plain = {r["job_id"]: (r["state"], r["ignored"]) for r in gate.job_states(spark.createDataFrame(events, EVENT)).collect()}
    assert table() == plain and plain[51] == ("RUNNING", 0)
    run()
    assert table() == plain  # nothing new, nothing changed
    spark.createDataFrame([(51, "SUCCEEDED", 70), (60, "PENDING", 71), (50, jobs.RESTART, 72)], EVENT).write.mode("append").parquet(f"{path}/in")
    run(1)
    time.sleep(0.1)
    spark.createDataFrame([(61, "PENDING", 80)], EVENT).write.mode("append").parquet(f"{path}/in")
    run()
    found = {r["job_id"]: (r["state"], r["error"]) for r in jobs.job_table(spark, f"{path}/out").collect()}
    assert found[51] == ("SUCCEEDED", None) and found[50] == ("FAILED", "SERVER_RESTARTED") and found[60] == ("FAILED", jobs.STALE) and found[61] == ("PENDING", None)


def test_gate_keeps_its_state(spark, tmp_path):
    path = str(tmp_path)
    registry = spark.createDataFrame([(1, "a"), (2, "z")], "id long, fingerprint string")
    run = lambda: jobs.run_gate(spark.readStream.schema(UPLOAD).parquet(f"{path}/in"), f"{path}/log", f"{path}/checkpoint", registry).awaitTermination()
    first = [(10, "a", 1), (12, "b", 3), (11, "b", 2), (13, "c", 4)] + [(100 + k, "hot", 500 - k) for k in range(300)]
    second = [(20, "c", 5), (21, "d", 6), (22, "d", 7), (23, "z", 8), (24, "hot", 9), (25, None, 10), (26, None, 11)]
    for part in (first, second):
        spark.createDataFrame(part, UPLOAD).repartition(3).write.mode("append").parquet(f"{path}/in")
        run()
    read = lambda: {r["id"]: (r["status"], r["duplicate_of"]) for r in spark.read.parquet(f"{path}/log").collect()}
    want = {10: ("REJECTED", 1), 11: ("ACCEPTED", None), 12: ("REJECTED", 11), 13: ("ACCEPTED", None), 20: ("REJECTED", 13), 21: ("ACCEPTED", None), 22: ("REJECTED", 21), 23: ("REJECTED", 2), 24: ("REJECTED", 399), 25: ("ACCEPTED", None), 26: ("REJECTED", 25)}
    want |= {100 + k: ("REJECTED", 399) for k in range(299)} | {399: ("ACCEPTED", None)}
    assert read() == want
    run()
    assert read() == want


def test_gate_takes_many_fingerprints_a_call():
    """One call of the processor decides all fingerprints of its bucket, and asks the state for each of them once."""
    import pandas as pd

    held, asked = {("=z",): (2,)}, []
    made = jobs.Gate()
    made.first = type("State", (), {"getValue": lambda self, k: asked.append(k) or held.get(k), "updateValue": lambda self, k, v: held.__setitem__(k, v)})()
    rows = pd.DataFrame({"id": [13, 11, 12, 14, 15, 16, 17], "fingerprint": ["a", "b", "a", "z", None, None, ""], "seq": [3, 1, 2, 4, 5, 6, 7]})
    out = pd.concat(made.handleInputRows((5,), iter([rows[:3], rows[3:]]), None))
    assert {r.id: None if pd.isna(r.duplicate_of) else r.duplicate_of for r in out.itertuples()} == {11: None, 12: None, 13: 12, 14: 2, 15: None, 16: 15, 17: None}
    assert len(asked) == 5 and held[("=a",)] == (12,)

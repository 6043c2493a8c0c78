"""Jobs over time: admission to a bounded queue, and the job state machine and upload gate as keyed state with timers.

The stateful processors keep their state in Spark's own state store, by key: a batch touches the keys that it brings, and
a query that stops goes on from its checkpoint. Outputs are written by batch number, so a repeated batch replaces what it
wrote before.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .gate import NEXT

# Jobs that may wait or run at a time, and the codes of an admitted and a refused one.
ACTIVE, ADMITTED, REFUSED = 8, 202, 429


# --- STR-03: admission -----------------------------------------------------------------------------------


def admissions(arrivals: DataFrame, queue: str = "queue", at: str = "at", takes: str = "takes", job: str = "job_id", limit: int = ACTIVE, workers: int = 1) -> DataFrame:
    """Every arrival with its status, the active jobs that it met, and the time at which it ends (null if refused).

    A queue's jobs come by time, then by id. One that meets ``limit`` admitted ones that haven't ended is refused and takes
    no place; an admitted one begins when one of the queue's ``workers`` is free. Times are longs of any unit. A queue is a
    sequence, so its arrivals pass through one task as a sorted stream, of which it holds the ends of active jobs only.
    Arrivals without queue, time or duration have no status and take no place; a negative duration counts as none.
    """
    new = [T.StructField("status", T.IntegerType()), T.StructField("active", T.IntegerType()), T.StructField("ends", T.LongType())]
    schema = T.StructType([*arrivals.schema.fields, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ends, free = None, [], []
        for batch in batches:
            out = []
            for q, t, n in zip(*(batch.column(c).to_pylist() for c in (queue, at, takes)), strict=True):
                if q is None or t is None or n is None:
                    out.append((None, None, None))
                    continue
                if q != last:
                    last, ends, free = q, [], [t] * workers
                while ends and ends[0] <= t:
                    heapq.heappop(ends)
                active = len(ends)
                if active >= limit:
                    out.append((REFUSED, active, None))
                    continue
                end = max(t, free[0]) + max(0, n)
                heapq.heapreplace(free, end)
                heapq.heappush(ends, end)
                out.append((ADMITTED, active, end))
            made = [pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.fieldNames())

    return arrivals.repartition(F.col(queue)).sortWithinPartitions(queue, at, job).mapInArrow(run, schema)


# --- keyed state -------------------------------------------------------------------------------------------

_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def _typed_state(spark: SparkSession):
    """The state store that holds typed state and timers; the session's own setting afterwards."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def _keep(stream: DataFrame, path: str, checkpoint: str, mode: str, **trigger: bool):
    """Run the stream over all that has arrived; each batch is a folder of its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with _typed_state(stream.sparkSession):
        return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


STALE, RESTART = "STALE", "RESTART"


class JobMachine(StatefulProcessor):
    """STR-02: a job's state, and how many events didn't fit it. A job that isn't done and hears nothing for ``stale_ms``
    fails by a timer; a RESTART event fails one that isn't done, as the end of the process that ran it does."""

    def __init__(self, stale_ms: int):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state string, ignored long, timer long")

    def _row(self, key: tuple, state: str | None, ignored: int, why: str | None) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "state": [state], "ignored": [ignored], "error": [why]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, ignored, timer = self.job.get() if self.job.exists() else (None, 0, 0)
        why = None
        for s in pd.concat(list(rows)).sort_values("seq")["state"]:
            if s == RESTART:
                state, why = ("FAILED", "SERVER_RESTARTED") if state in ("PENDING", "RUNNING") else (state, why)
            elif s in NEXT[state]:
                state = s
            else:
                ignored += 1
        if timer:
            self.handle.deleteTimer(timer)
        timer = 0
        if state in ("PENDING", "RUNNING"):
            timer = timerValues.getCurrentProcessingTimeInMs() + self.stale_ms
            self.handle.registerTimer(timer)
        self.job.update((state, ignored, timer))
        yield self._row(key, state, ignored, why)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state, ignored, _ = self.job.get()
        if state in ("PENDING", "RUNNING"):
            self.job.update(("FAILED", ignored, 0))
            yield self._row(key, "FAILED", ignored, STALE)

    def close(self) -> None:
        pass


def run_jobs(events: DataFrame, out: str, checkpoint: str, stale_ms: int = 30 * 60 * 1000):
    """A stream of (job_id, state, seq) through the machine; ``out`` gets a row for every job that a batch changes. Events
    of a job come in order of seq within a batch, and batches as they arrive."""
    told = events.filter("job_id IS NOT NULL").groupBy("job_id").transformWithStateInPandas(JobMachine(stale_ms), "job_id long, state string, ignored long, error string", "Update", "ProcessingTime")
    # one batch: with timers of processing time ``availableNow`` would go on with empty batches
    return _keep(told, out, checkpoint, "update", once=True)


def job_table(spark: SparkSession, out: str) -> DataFrame:
    """The jobs as they stand: each one's row of its latest batch."""
    return spark.read.parquet(out).groupBy("job_id").agg(F.max_by(F.struct("state", "ignored", "error"), "batch").alias("l")).select("job_id", "l.*")


#: Keys of the gate's state. A call of the processor costs far more than a row, so fingerprints share one.
BUCKETS = 1024


class Gate(StatefulProcessor):
    """STR-04: the first upload of a fingerprint, by seq within a batch; all others, of this batch or a later one, are its
    copies. The state of a bucket maps its fingerprints to their first uploads and is asked for those that a batch brings."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getMapState("first", "fingerprint string", "id long")

    @staticmethod
    def _key(fingerprint: str | None) -> tuple[str]:
        return ("" if fingerprint is None else f"={fingerprint}",)  # a null is a fingerprint of its own

    def _known(self, fingerprint: str | None) -> int | None:
        held = self.first.getValue(self._key(fingerprint))
        return None if held is None else int(held[0])

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        for fingerprint, id_ in zip(initialState["fingerprint"].tolist(), initialState["id"].tolist(), strict=True):
            held = self._known(fingerprint)
            if held is None or id_ < held:
                self.first.updateValue(self._key(fingerprint), (int(id_),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = pd.concat([r[["id", "fingerprint", "seq"]] for r in rows]).sort_values(["seq", "id"])  # no more than these of a batch's copies
        first: dict[str | None, int] = {}
        of: list[int | None] = []
        for id_, fingerprint in zip(own["id"].tolist(), own["fingerprint"].tolist(), strict=True):
            if fingerprint not in first:
                known = self._known(fingerprint)
                first[fingerprint] = id_ if known is None else known
                if known is None:
                    self.first.updateValue(self._key(fingerprint), (int(id_),))
                    of.append(None)
                    continue
            of.append(first[fingerprint])
        status = ["ACCEPTED" if x is None else "REJECTED" for x in of]
        yield pd.DataFrame({"id": own["id"].to_numpy(), "fingerprint": own["fingerprint"].to_numpy(), "status": status, "duplicate_of": pd.array(of, dtype="Int64")})

    def close(self) -> None:
        pass


def run_gate(uploads: DataFrame, log: str, checkpoint: str, registry: DataFrame | None = None):
    """A stream of uploads (id, fingerprint, seq) against a registry (id, fingerprint) that accepted ones join. The
    registry is read once, as the state that the first batch begins with; after that a batch costs what it brings.
    ``log`` gets a row for every upload."""
    bucket = F.pmod(F.xxhash64("fingerprint"), F.lit(BUCKETS)).alias("bucket")
    known = registry.select(F.col("id").cast("long"), "fingerprint", bucket).groupBy("bucket") if registry is not None else None
    told = uploads.select("id", "fingerprint", "seq", bucket).groupBy("bucket").transformWithStateInPandas(Gate(), "id long, fingerprint string, status string, duplicate_of long", "Append", "None", known)
    return _keep(told, log, checkpoint, "append", availableNow=True)


def in_parts(rows: DataFrame, order: str, parts: int, path: str, run: Callable[[int], None]) -> None:
    """Let rows arrive in ``parts`` stretches of ``order``, and call ``run`` after each: every call goes on from the
    checkpoint of the one before."""
    cuts = rows.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)])).first()[0] or []
    at = sum((F.when(F.col(order) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    for part in range(parts):
        rows.filter(at == part).write.mode("append").parquet(path)
        run(part)

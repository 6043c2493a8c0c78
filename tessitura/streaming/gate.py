"""The upload gate and the job state machine over whole tables, event-time windows and resumable evaluation; ``jobs`` has
the gate and the machine as streams with keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gate_batch(batch: DataFrame, registry: DataFrame, key: str = "fingerprint", order: str = "seq") -> DataFrame:
    """STR-04: decide a batch as if its uploads came one after another: a copy of a registered or an earlier upload is
    rejected with the id it repeats. The first of each key is found by min(), so copies don't meet in a window."""
    known = registry.groupBy(key).agg(F.min_by("id", order).alias("_known"))
    first = batch.groupBy(key).agg(F.min_by("id", order).alias("_first"))
    d = batch.join(known, key, "left").join(first, key, "left")
    of = F.coalesce("_known", F.when(F.col("_first") != F.col("id"), F.col("_first")))
    return d.withColumns({"duplicate_of": of, "status": F.when(of.isNull(), "ACCEPTED").otherwise("REJECTED")}).drop("_known", "_first")


# The states of a job and what may follow each.
NEXT = {None: ["PENDING"], "PENDING": ["RUNNING", "FAILED"], "RUNNING": ["SUCCEEDED", "FAILED"], "SUCCEEDED": [], "FAILED": []}


def job_states(events: DataFrame) -> DataFrame:
    """STR-02: replay (job_id, state, seq) per job; transitions that aren't allowed are ignored and counted."""
    allowed = F.create_map(*[x for k, v in NEXT.items() for x in (F.lit(k or ""), F.array(*map(F.lit, v)).cast("array<string>"))])
    zero = F.struct(F.lit("").alias("state"), F.lit(0).cast("long").alias("ignored"))

    def step(held, x):
        ok = F.array_contains(F.element_at(allowed, held["state"]), x["state"])
        return F.struct(F.when(ok, x["state"]).otherwise(held["state"]).alias("state"), (held["ignored"] + F.when(ok, 0).otherwise(1)).alias("ignored"))

    log = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", "state"))).alias("log"))
    return log.select("job_id", F.aggregate("log", zero, step).alias("r")).select("job_id", F.nullif("r.state", F.lit("")).alias("state"), "r.ignored")


def restart(states: DataFrame) -> DataFrame:
    """After a restart, jobs that weren't done have failed."""
    return states.withColumn("state", F.when(F.col("state").isin("PENDING", "RUNNING"), "FAILED").otherwise(F.col("state")))


def event_windows(events: DataFrame, width: str = "10 minutes", slide: str = "5 minutes", late: str | None = None) -> DataFrame:
    """STR-01 over event time: sliding counts and means; with ``late`` a watermark for streams."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def resume(spark: SparkSession, source: str, schema, out: str, checkpoint: str, process) -> None:
    """STR-07: process what has arrived since the last run and stop; the checkpoint remembers what is done."""
    stream = spark.readStream.schema(schema).parquet(source)
    process(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

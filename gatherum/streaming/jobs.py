"""Event logs: the same operators on stored logs and on streams (Structured Streaming)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FINAL = ("done", "failed", "stopped")


def replay(log: DataFrame, job: str, seq: str, after: int) -> DataFrame:
    """Events of each job behind a sequence number, in order: what a client that comes back has missed."""
    return log.where(F.col(seq) > after).orderBy(job, seq)


def job_states(log: DataFrame, job: str, order: list[str], event: str) -> DataFrame:
    """(job, state, events): the last state of each job; nothing follows a final state."""
    final = log.where(F.col(event).isin(*FINAL)).groupBy(job).agg(F.min_by(event, F.struct(*order)).alias("_final"))
    last = log.groupBy(job).agg(F.max_by(event, F.struct(*order)).alias("_last"), F.count("*").alias("events"))
    return last.join(final, job, "left").select(job, F.coalesce("_final", "_last").alias("state"), "events")


def recent_jobs(log: DataFrame, job: str, ts: str, keep: int = 20) -> DataFrame:
    """The jobs with the latest events (ties by job)."""
    return log.groupBy(job).agg(F.max(ts).alias("last_ts")).orderBy(F.desc("last_ts"), job).limit(keep)


def admitted(log: DataFrame, job: str, ts: str) -> DataFrame:
    """Jobs in the order of their first event with the number of jobs that were active then."""
    spans = log.groupBy(job).agg(F.min(ts).alias("began"), F.max(ts).alias("ended"))
    marks = spans.select(job, F.col("began").alias("at"), F.lit(1).alias("d")).unionByName(spans.select(job, F.col("ended").alias("at"), F.lit(-1).alias("d")))
    by_day = marks.withColumn("day", F.to_date("at"))
    return by_day.groupBy("day").agg(F.count_if("d = 1").alias("began"), F.count_if("d = -1").alias("ended")).withColumn("active", F.sum(F.col("began") - F.col("ended")).over(Window.orderBy("day")))


def stage_seconds(log: DataFrame, job: str, stage: str, ts: str, order: str) -> DataFrame:
    """(stage, n, seconds): time from each event to the job's next one, summed by stage."""
    next_ts = F.lead(ts).over(Window.partitionBy(job).orderBy(ts, order))
    timed = log.withColumn("_s", F.unix_micros(next_ts) - F.unix_micros(ts))
    return timed.where("_s is not null").groupBy(stage).agg(F.count("*").alias("n"), (F.sum("_s") / 1_000_000).alias("seconds"))


def within_limits(log: DataFrame, text: str, job: str, longest: int, most: int, order: list[str]) -> DataFrame:
    """Adds ``refused``: too_long for long lines, flood for what a job sends beyond a number of events; else null."""
    place = F.row_number().over(Window.partitionBy(job).orderBy(*order))
    return log.withColumn("refused", F.when(F.length(text) > longest, "too_long").when(place > most, "flood"))


def tumbling(events: DataFrame, ts: str, size: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts by time window and keys; ``late`` sets a watermark (streams: later rows are dropped)."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """Sessions of each key that end after a gap: (key, session_start, session_end, n)."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def state_stream(events: DataFrame, job: str, event: str, seq: str) -> DataFrame:
    """The state machine on a stream: a row (job, state, events) after each batch that holds events of the job."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, n = state.get if state.exists else ("", 0)
        rows = pd.concat(list(batches)).sort_values(seq)
        for e in rows[event]:
            now = now if now in FINAL else e
        n += len(rows)
        state.update((now, n))
        yield pd.DataFrame({job: [key[0]], "state": [now], "events": [n]})

    kind = events.schema[job].dataType.simpleString()
    return events.groupBy(job).applyInPandasWithState(step, f"{job} {kind}, state string, events long", "state string, events long", "update", "NoTimeout")


def read_events(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of the Parquet event files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)

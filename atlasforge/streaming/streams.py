"""Stateful streams (M1, M3-M5): sliding-window rate limit, job states, progress rates.

The reference defines no watermark; the one of progress() is this engine's own choice and a parameter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..scratch import read_text, replace_text, scratch_path

WINDOW_SECONDS = 3600


def admit(times: list[float], hits: list[float], limit: int, window: float = WINDOW_SECONDS) -> tuple[list[bool], list[float]]:
    """M1 for one key: a hit is admitted when fewer than `limit` admitted hits lie within the window before it; rejected hits are not kept."""
    out = []
    for now in times:
        hits = [t for t in hits if t >= now - window]
        ok = len(hits) < limit
        if ok:
            hits.append(now)
        out.append(ok)
    return out, hits


def rate_limited(events: DataFrame, key: str, limit: int, window: float = WINDOW_SECONDS) -> DataFrame:
    """Events (key, event_id, seconds) with `admitted`; state is at most `limit` times for each key. Works on streams and is exact for input in time order across batches."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seconds, ids = (np.concatenate(x) for x in zip(*((b["seconds"].to_numpy(), b["event_id"].to_numpy()) for b in batches), strict=True))  # two numbers an event
        order = np.lexsort((ids, seconds))
        hits = list(state.get[0]) if state.exists else []
        ok, hits = admit(seconds[order].tolist(), hits, limit, window)
        state.update((hits,))
        yield pd.DataFrame({key: k[0], "event_id": ids[order], "admitted": ok})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id long, admitted boolean", "hits array<double>", "append", GroupStateTimeout.NoTimeout)


TERMINAL = ("completed", "failed", "cancelled")
LOG_LINES = 300
JOB = "job_id string, status string, log array<string>"


def advance(status: str, log: list[str], kind: str, text: str) -> str:
    """One event of a job: the new status; log gets the line that goes with it. Only output lines shorten the log to its last LOG_LINES."""
    if kind == "line":
        if text.strip():
            log.append(text)
            del log[:-LOG_LINES]
        return status
    if status in TERMINAL:
        return status
    if kind == "cancel":
        if status != "cancel_requested":
            log.append("Cancellation requested.")
        return "cancel_requested"
    cancelled = status == "cancel_requested"
    if kind == "start":
        log.append("Cancelled before process start." if cancelled else f"Starting: {text}")
        return "cancelled" if cancelled else "running"
    if cancelled:
        log.append("Process cancelled.")
        return "cancelled"
    log.append("Process completed successfully." if kind == "completed" else f"Process exited with status {text}.")
    return kind


class JobMachine(StatefulProcessor):
    """M5: a job's status and the last lines of its log, as value and list state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string")
        self.log = handle.getListState("log", "line string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        events = [e for b in rows for e in zip(b["seconds"], b["event_id"], b["kind"], b["line"].fillna(""), strict=True)]
        status = self.status.get()[0] if self.status.exists() else "queued"
        log = [line for (line,) in self.log.get()] if self.log.exists() else []
        for _, _, kind, text in sorted(events):
            status = advance(status, log, kind, text)
        self.status.update((status,))
        self.log.put([(line,) for line in log])
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "log": [log]})

    def close(self) -> None:
        pass


def job_states(events: DataFrame) -> DataFrame:
    """M5: state and log of each job from (job_id, event_id, seconds, kind, line); kinds: start, line, cancel, completed, failed.

    A job is queued until it starts; a terminal state stays; a cancelled one ends as cancelled whatever its process gives. Events of a
    batch count in the order of (seconds, event_id). Lists and values are kept in the RocksDB state store.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return events.groupBy("job_id").transformWithStateInPandas(JobMachine(), JOB, "Update", "None")


def progress(events: DataFrame, time: str = "ts", value: str = "value", width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """M4: amount and rate per second by tumbling window; on a stream, events later than `delay` are dropped by the watermark. A closed table gives the same windows, and all of them."""
    w = (events.withWatermark(time, delay) if events.isStreaming else events).groupBy(F.window(time, width).alias("w"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("amount")).select(F.col("w.start").alias("start"), "n", "amount", F.round(F.col("amount") / seconds, 3).alias("per_second"))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there (AvailableNow) into files, with its own checkpoint, and read the result. A batch that is tried again replaces its rows."""
    spark = stream.sparkSession
    out, log = scratch_path(spark, "stream"), scratch_path(spark, "stream-checkpoint")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode(mode).trigger(availableNow=True).start()
    else:
        write = lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", log).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


# ---------------------------------------------------------------- checkpoints


def commit_batch(batch: DataFrame, batch_id: int, path: str, counters: dict[str, Column], event: str = "progress_checkpoint") -> dict:
    """M3: one batch into the table at path: its rows, the progress record, then the pointer to the last batch, which is replaced in one step.

    A batch that is tried again writes its folder and record anew, and one that the pointer has passed is not counted twice. counters:
    name to aggregate; they are summed over batches.
    """
    spark = batch.sparkSession
    latest = json.loads(read_text(spark, f"{path}/latest.json") or "{}")
    if latest.get("batch", -1) >= batch_id:
        return latest
    batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
    written = spark.read.schema(batch.schema).parquet(f"{path}/rows/batch={batch_id}")
    own = written.agg(*[c.alias(k) for k, c in counters.items()]).first().asDict()
    total = {k: latest.get("counters", {}).get(k, 0) + (v or 0) for k, v in own.items()}
    record = {"batch": batch_id, "event": event, "phase": "running", "counters": total}
    replace_text(spark, f"{path}/progress/{batch_id:09d}.json", json.dumps(record))
    replace_text(spark, f"{path}/latest.json", json.dumps(record))
    return record


def checkpointed(stream: DataFrame, path: str, counters: dict[str, Column], interval_seconds: int | None = None) -> dict:
    """M3: run a stream into the table at path, a checkpoint a batch, and go on after the last one if it ran before; the last progress record.

    How often is the source's own limit on a batch (maxFilesPerTrigger, maxBytesPerTrigger), or a time between batches on a live stream.
    What failed is recorded in latest.json, with the counters of the batches that were committed.
    """
    spark = stream.sparkSession
    trigger = {"processingTime": f"{interval_seconds} seconds"} if interval_seconds else {"availableNow": True}
    write = lambda df, batch_id: commit_batch(df, batch_id, path, counters)
    try:
        stream.writeStream.foreachBatch(lambda df, batch_id: write(df, batch_id) and None).option("checkpointLocation", f"{path}/stream").trigger(**trigger).start().awaitTermination()
    except Exception as e:
        record = json.loads(read_text(spark, f"{path}/latest.json") or '{"batch": -1, "counters": {}}')
        replace_text(spark, f"{path}/latest.json", json.dumps(record | {"event": "failed", "phase": "failed", "error": str(e)[:500]}))
        raise
    record = json.loads(read_text(spark, f"{path}/latest.json") or '{"batch": -1, "counters": {}}')
    record = {k: v for k, v in record.items() if k != "error"} | {"event": "finished", "phase": "completed"}
    replace_text(spark, f"{path}/latest.json", json.dumps(record))
    return record


def committed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of the batches up to the pointer, with their batch; a batch that was not finished is not seen."""
    last = json.loads(read_text(spark, f"{path}/latest.json") or '{"batch": -1}')["batch"]
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).option("basePath", f"{path}/rows")
    return rows.parquet(*[f"{path}/rows/batch={b}" for b in range(last + 1)]) if last >= 0 else spark.createDataFrame([], StructType([*schema.fields, StructField("batch", LongType())]))

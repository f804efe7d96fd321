"""Index queues and batch runs (W4, W5, A21, A22, J24, M5-M7, R25, R26) over job state events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(events: DataFrame, key: str = "job_id") -> DataFrame:
    """The last status of each job, by time and then event id."""
    return events.groupBy(key, "dataset").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("at"), F.count("*").alias("n_events"))


def batch_plan(jobs: DataFrame, done: tuple[str, ...], per_dataset: int, most: int) -> DataFrame:
    """Jobs that are not done, at most per_dataset of each dataset and `most` in all, in id order.

    A job over its dataset's quota never uses the global one, so the first `most` of those within quota are the plan; the rest
    is marked with the reason. Ranks are only asked for below the quota, so tasks keep that many rows of a dataset before they
    send them on, and the other jobs are told by the last place within quota.
    """
    open_jobs = jobs.where(~F.col("status").isin(*done))
    rank = F.row_number().over(Window.partitionBy("dataset").orderBy("job_id"))
    within = open_jobs.select("job_id", "dataset").withColumn("place", rank).where(F.col("place") <= per_dataset)
    ends = within.groupBy("dataset").agg(F.max("job_id").alias("last"))  # a row for each dataset
    planned = within.orderBy("job_id").limit(most).select("job_id", F.lit(True).alias("planned"))
    out = jobs.join(ends, "dataset", "left").join(planned, "job_id", "left")
    reason = F.when(F.col("status").isin(*done), "done").when(F.col("planned"), "planned").when(F.col("job_id") > F.col("last"), "dataset_quota").otherwise("plan_full")
    return out.select("job_id", "dataset", "status", reason.alias("decision"))


def queue_totals(assets: DataFrame, states: tuple[str, ...] = ("indexed", "ready", "cached", "sidecar", "review", "failed")) -> DataFrame:
    """Assets, datasets and a counter for each queue state, over all rows (columns dataset, queue_status)."""
    per = assets.groupBy("dataset").agg(F.count("*").alias("n"), *[F.count_if(F.col("queue_status") == s).alias(s) for s in states])
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("assets"), F.count("*").alias("datasets"), *[F.coalesce(F.sum(s), F.lit(0)).alias(f"n_{s}") for s in states])


def queue_rows(assets: DataFrame, readiness: DataFrame, derivatives: DataFrame, events: DataFrame) -> DataFrame:
    """Queue assets with their readiness and derivative by path and the latest job of each; what has none is null."""
    last = events.groupBy("relative_path").agg(F.max_by("status", F.struct("ts", "event_id")).alias("job_status"))
    return assets.join(readiness, "relative_path", "left").join(derivatives, "relative_path", "left").join(last, "relative_path", "left")


def batch_summary(jobs: DataFrame, buckets: dict[str, str]) -> DataFrame:
    """Jobs in each bucket by dataset; an unknown status is pending."""
    bucket = F.lit("pending")
    for status, name in buckets.items():
        bucket = F.when(F.col("status") == status, name).otherwise(bucket)
    names = sorted({*buckets.values(), "pending"})
    rows = jobs.withColumn("bucket", bucket)
    return rows.groupBy("dataset").agg(*[F.count_if(F.col("bucket") == n).alias(f"n_{n}") for n in names])


def run_status(jobs: DataFrame, failed: str, active: tuple[str, ...]) -> DataFrame:
    """M6: a run is active while a job is, failed when one failed, else completed."""
    state = F.when(F.count_if(F.col("status").isin(*active)) > 0, "active").when(F.count_if(F.col("status") == failed) > 0, "failed").otherwise("completed")
    return jobs.groupBy("dataset").agg(state.alias("run_status"), F.count("*").alias("n_jobs"))


def capped_recent(events: DataFrame, key: str, n: int) -> DataFrame:
    """The n most recent events of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id")))
    return events.withColumn("recent", rank).where(F.col("recent") <= n)

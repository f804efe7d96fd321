"""Stream and file-format queries over the driver's tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch_path
from ..sources import bindings as B
from ..sources import planes, volumes
from ..streaming import streams


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream. A pattern names it, as a stream takes no single file by its plain path."""
    schema = B.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def rate_limited_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 5 admitted events of a user within any six hours."""
    events = event_stream(spark, sf_dir).select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("seconds"))
    return streams.drain(streams.rate_limited(events, "user_id", 5, 6 * 3600))


KINDS = {"purchase": "completed", "error": "failed", "signup": "start", "click": "line", "view": "cancel"}


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as one job's starts, lines, cancellations and ends; the last update of each job with its log."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("event_type"))
    line = F.when(F.col("event_id") % 50 == 0, " ").otherwise(F.concat(F.lit("line "), F.col("event_id").cast("string")))
    events = event_stream(spark, sf_dir).select(F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"), "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("seconds"), kind.alias("kind"), line.alias("line"))
    updates = streams.drain(streams.job_states(events), "update")
    last = updates.groupBy("job_id").agg(F.max_by(F.struct("status", "log"), "epoch").alias("s"))
    return last.select("job_id", "s.status", F.size("s.log").cast("bigint").alias("n_lines"), F.sha2(F.array_join("s.log", "\n"), 256).alias("log_sha256"))


def checkpointed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as eight files that come two a batch: rows and amounts by type from the committed batches, beside the counters of the last checkpoint."""
    files, out = scratch_path(spark, "event-files"), scratch_path(spark, "scan")
    table = B.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    table.repartitionByRange(8, "event_id").write.parquet(files)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(files)
    record = streams.checkpointed(stream, out, {"rows": F.count("*"), "errors": F.count_if(F.col("event_type") == "error")})
    rows = streams.committed(spark, out, table.schema)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("amount")).withColumns({f"all_{k}": F.lit(v).cast("bigint") for k, v in record["counters"].items()})


def hourly_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly amounts of the events as a stream, whose update mode gives the last hours too: the last state of each window."""
    events = event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    updates = streams.drain(streams.progress(events), "update")
    last = updates.groupBy("start").agg(F.max_by(F.struct("n", "amount", "per_second"), "epoch").alias("s"))
    return last.select("start", "s.n", F.round("s.amount", 3).alias("amount"))


def tiff_bytes(width: int, height: int, spacing: float) -> bytes:
    """A one-directory TIFF with a description that has a unit and a spacing, and 20 pixels to a unit."""
    about = f"ImageJ=1\nunit=nm\nspacing={spacing}\nslices=7\n".encode() + b"\0"
    entries = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, 16), (270, 2, len(about), 134), (282, 5, 1, 118), (283, 5, 1, 126), (296, 3, 1, 1), (339, 3, 1, 1)]
    body = struct.pack("<2sHIH", b"II", 42, 8, len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)
    return body.ljust(118, b"\0") + struct.pack("<4I", 1, 20, 1, 20) + about


def mrc_bytes(nx: int, ny: int, nz: int) -> bytes:
    head = struct.pack("<10i", nx, ny, nz, 6, 0, 0, 0, nx, ny, nz) + struct.pack("<3f", nx * 10.0, ny * 20.0, nz * 50.0)
    return head.ljust(1024, b"\0")


def volume_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header file for each document: TIFF, MRC, HDF5 signature or a broken TIFF, by doc_id."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, n in zip(b["doc_id"], b["n_chars"], strict=True):
                kind = i % 4
                data = [tiff_bytes(n + 1, i % 50 + 1, 20.0), mrc_bytes(n + 1, 3, 2), volumes.HDF5_MAGIC + b"\0" * 8, b"II*\0\xff\xff\xff\0"][kind]
                out.append((f"f/{i}" + (".tif", ".mrc", ".h5", ".tif")[kind], data))
            yield pd.DataFrame(out, columns=["relative_path", "content"])

    return B.table(spark, sf_dir, "documents").select("doc_id", "n_chars").mapInPandas(build, "relative_path string, content binary")


SLAB = 16


def volume_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as volumes of 64 planes of 8 x 8 values, the letters of a text's SHA-256: MRC and TIFF files of both byte orders, written, and read back by slabs."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("letters"))
    volumes_of = d.groupBy(F.floor(F.col("doc_id") / 64).alias("v")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "letters"))).alias("planes"))

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for v, rows in zip(b["v"], b["planes"], strict=True):
                cube = np.frombuffer("".join(r["letters"] for r in rows).encode(), np.uint8).reshape(-1, 8, 8)
                kind = v % 4
                if kind < 2:
                    data = planes.mrc_bytes(cube.astype("i1") if kind == 0 else cube.astype("u2"), "<>"[kind], extended=96 * kind)
                else:
                    data = planes.tiff_bytes(cube if kind == 2 else cube.astype("u2"), "<>"[kind - 2], 3, kind - 2)
                out.append((f"{v % 10}/{v}" + (".mrc" if kind < 2 else ".tif"), data))
            yield pd.DataFrame(out, columns=["relative_path", "content"])

    path = scratch_path(spark, "volumes")
    files = volumes_of.mapInPandas(build, "relative_path string, content binary")
    planes.write_files(files, path).write.format("noop").mode("overwrite").save()
    return planes.planes(spark, path, SLAB).withColumn("raw_sha256", F.sha2("raw", 256)).drop("raw")


QUERIES = {
    "rate_limited_events": rate_limited_events,
    "job_states": job_states,
    "hourly_progress": hourly_progress,
    "volume_planes": volume_planes,
    "checkpointed_scan": checkpointed_scan,
    "volume_headers": lambda s, d: volumes.headers(volume_files(s, d)).drop("format"),
}

ORACLES = {
    "volume_planes": """WITH d AS (SELECT doc_id // 64 AS v, doc_id % 64 AS z, row_number() OVER (PARTITION BY doc_id // 64 ORDER BY doc_id) - 1 AS plane, sha256(coalesce(text, '')) AS h FROM documents),
c AS (SELECT v, plane, string_agg(CASE v % 4 WHEN 0 THEN printf('%02x', ascii(h[i]) + 128) WHEN 2 THEN printf('%02x', 255 - ascii(h[i])) ELSE printf('%02x00', ascii(h[i])) END, '' ORDER BY i) AS raw FROM d, unnest(range(1, 65)) AS t(i) GROUP BY ALL)
SELECT v % 10 || '/' || v || CASE WHEN v % 4 < 2 THEN '.mrc' ELSE '.tif' END AS relative_path, plane, 8 AS height, 8 AS width, CASE WHEN v % 2 = 0 THEN '|u1' ELSE '<u2' END AS dtype,
CASE v % 4 WHEN 0 THEN 'integer_offset' WHEN 2 THEN 'unsigned_inversion' ELSE 'identity' END AS transform, sha256(unhex(raw)) AS raw_sha256 FROM c""",
    "hourly_progress": "SELECT date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 3) AS amount FROM events GROUP BY ALL",
    # the admitted hits of each user, followed one event at a time
    "rate_limited_events": """WITH RECURSIVE e AS (SELECT user_id, event_id, floor(epoch(ts)) AS t, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS i FROM events),
r AS (
  SELECT user_id, event_id, i, [t] AS hits, true AS admitted FROM e WHERE i = 1
  UNION ALL
  SELECT user_id, event_id, i, CASE WHEN len(live) < 5 THEN list_append(live, t) ELSE live END, len(live) < 5
  FROM (SELECT e.user_id, e.event_id, e.i, e.t, list_filter(r.hits, lambda h: h >= e.t - 21600) AS live FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
SELECT user_id, event_id, admitted FROM r""",
    "checkpointed_scan": "SELECT event_type, count(*) AS n, round(sum(value), 3) AS amount, (SELECT count(*) FROM events) AS all_rows, (SELECT count(*) FROM events WHERE event_type = 'error') AS all_errors FROM events GROUP BY event_type",
    # each job's events, followed one at a time: its state, and its log with what the event adds
    "job_states": """WITH RECURSIVE e AS (
  SELECT 'job-' || user_id AS job_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'start' WHEN 'click' THEN 'line' WHEN 'view' THEN 'cancel' END AS kind,
         CASE WHEN event_id % 50 = 0 THEN ' ' ELSE 'line ' || event_id END AS text, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
r AS (
  SELECT DISTINCT job_id, 'queued' AS status, CAST([] AS VARCHAR[]) AS log, 0::BIGINT AS i, n FROM e
  UNION ALL
  SELECT e.job_id, CASE WHEN kind = 'line' OR r.status IN ('completed', 'failed', 'cancelled') THEN r.status WHEN kind = 'cancel' THEN 'cancel_requested' WHEN r.status = 'cancel_requested' THEN 'cancelled' WHEN kind = 'start' THEN 'running' ELSE kind END,
    CASE WHEN kind = 'line' THEN CASE WHEN trim(text) = '' THEN log ELSE list_append(log, text)[-300:] END
         WHEN r.status IN ('completed', 'failed', 'cancelled') OR (kind = 'cancel' AND r.status = 'cancel_requested') THEN log
         WHEN kind = 'cancel' THEN list_append(log, 'Cancellation requested.')
         WHEN kind = 'start' THEN list_append(log, CASE WHEN r.status = 'cancel_requested' THEN 'Cancelled before process start.' ELSE 'Starting: ' || text END)
         WHEN r.status = 'cancel_requested' THEN list_append(log, 'Process cancelled.')
         ELSE list_append(log, CASE WHEN kind = 'completed' THEN 'Process completed successfully.' ELSE 'Process exited with status ' || text || '.' END) END, e.i, e.n
  FROM r JOIN e ON e.job_id = r.job_id AND e.i = r.i + 1)
SELECT job_id, status, len(log) AS n_lines, sha256(array_to_string(log, chr(10))) AS log_sha256 FROM r WHERE i = n""",
    "volume_headers": """SELECT 'f/' || doc_id || (['.tif', '.mrc', '.h5', '.tif'])[CAST(doc_id % 4 AS INT) + 1] AS relative_path, (['readable', 'readable', 'detected', 'unreadable'])[CAST(doc_id % 4 AS INT) + 1] AS status,
CASE WHEN doc_id % 4 < 2 THEN n_chars + 1 END AS x, CASE doc_id % 4 WHEN 0 THEN doc_id % 50 + 1 WHEN 1 THEN 3 END AS y, CASE doc_id % 4 WHEN 0 THEN 7 WHEN 1 THEN 2 END AS z, CASE WHEN doc_id % 4 < 2 THEN 'uint16' END AS dtype,
CASE doc_id % 4 WHEN 0 THEN 20.0 WHEN 1 THEN 1.0 END::DOUBLE AS voxel_x_nm, CASE doc_id % 4 WHEN 0 THEN 20.0 WHEN 1 THEN 2.0 END::DOUBLE AS voxel_y_nm, CASE doc_id % 4 WHEN 0 THEN 20.0 WHEN 1 THEN 5.0 END::DOUBLE AS voxel_z_nm FROM documents""",
}

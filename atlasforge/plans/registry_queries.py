"""Registry views and 3-D chunk queries over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import registry as R
from ..operators import volume as V
from ..sources import bindings as B
from . import estate_queries as Q


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a volume of uint8 (vector, 8, 8) in chunks of 16 planes and 4 columns: 1 where a value is at least 0.1."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for cz, rows in zip(b.cz, b.rows, strict=True):
                a = (np.array([r["embedding"] for r in rows], dtype=np.float32) >= np.float32(0.1)).astype(np.uint8).reshape(-1, 8, 8)
                z0 = int(rows[0]["vec_id"])
                for cx in (0, 1):
                    out.append((cz, 0, cx, z0, 0, cx * 4, z0 + len(a), 8, cx * 4 + 4, np.ascontiguousarray(a[:, :, cx * 4 : cx * 4 + 4]).tobytes()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in V.CHUNKS.split(", ")])

    e = B.table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 16).cast("int").alias("cz"))
    return e.agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("rows")).mapInPandas(pack, V.CHUNKS)


_CUBE = "WITH c AS (SELECT vec_id AS z, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(embedding[i] >= CAST(0.1 AS FLOAT) AS INT) AS v FROM embeddings, unnest(range(1, 65)) AS t(i)) "


def directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = B.inventory(spark, sf_dir)
    candidates = i.select(F.substring_index("relative_path", "/", 2).alias("relative_path")).distinct().unionByName(i.where("doc_id % 50 = 0").select("relative_path"))
    return R.directory_volumes(candidates, i).select("relative_path", "n_files", "bytes", F.array_join("blockers", ",").alias("blockers"))


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = Q.assets(spark, sf_dir)
    keys = a.where("walk_pos % 40 = 0").select(F.substring_index("relative_path", "/", -1).alias("match_key"))
    return R.matched(a, keys, "asset_id").select("asset_id")


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = R.assemble(Q.assets(spark, sf_dir), "reg")
    return a.select("asset_id", "relative_path", "checksum.present", "readiness.project_ready", F.size("review.gap_codes").alias("n_gaps"), F.length("search_text").alias("search_chars"))


QUERIES = {
    "volume_slice_z": lambda s, d: V.slice_plane(cube(s, d), "z", 33),
    "volume_slice_y": lambda s, d: V.slice_plane(cube(s, d), "y", 5),
    "volume_slice_x": lambda s, d: V.slice_plane(cube(s, d), "x", 6),
    "volume_stride": lambda s, d: V.stride(cube(s, d), 3),
    "volume_labels": lambda s, d: V.label_report(cube(s, d)),
    "volume_probe": lambda s, d: V.probe(cube(s, d), 21, 3, 6, (30.0, 20.0, 10.0)),
    "directory_volumes": directories,
    "matched_assets": wanted,
    "registry_assets": assembled,
    "section_counts": lambda s, d: Q.assets(s, d).agg(*[F.count_if(R.section(n)).alias(n) for n in ("all", "project_ready", "conversion_queue", "review")], *[F.count_if(R.queue_filter(n)).alias(f"queue_{n}") for n in ("ready", "review")]),
    "asset_counters": lambda s, d: R.long_counts(Q.assets(s, d), ["role", "metadata_status", "format", "can_view"]),
}

ORACLES = {
    "volume_slice_z": _CUBE + "SELECT y AS u, x AS v, v AS value FROM c WHERE z = 33",
    "volume_slice_y": _CUBE + "SELECT z AS u, x AS v, v AS value FROM c WHERE y = 5",
    "volume_slice_x": _CUBE + "SELECT z AS u, y AS v, v AS value FROM c WHERE x = 6",
    "volume_stride": _CUBE + "SELECT z // 3 AS z, y // 3 AS y, x // 3 AS x, v AS value FROM c WHERE z % 3 = 0 AND y % 3 = 0 AND x % 3 = 0",
    "volume_labels": _CUBE + "SELECT true AS sized, true AS binary, count(*) AS voxels, CAST(sum(v) AS BIGINT) AS foreground, min(z) FILTER (WHERE v = 1) AS z_min, min(y) FILTER (WHERE v = 1) AS y_min, min(x) FILTER (WHERE v = 1) AS x_min, max(z) FILTER (WHERE v = 1) AS z_max, max(y) FILTER (WHERE v = 1) AS y_max, max(x) FILTER (WHERE v = 1) AS x_max, sum(v) > 0 AND sum(v) < count(*) AS usable FROM c",
    "volume_probe": _CUBE + "SELECT v AS value, 0.63::DOUBLE AS z_um, 0.06::DOUBLE AS y_um, 0.06::DOUBLE AS x_um FROM c WHERE z = 21 AND y = 3 AND x = 6",
    "directory_volumes": f"""WITH {B.INVENTORY_SQL} SELECT split_part(relative_path, '/', 1) || '/' || split_part(relative_path, '/', 2) AS relative_path, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS bytes, 'missing_composite_checksum' AS blockers FROM inventory GROUP BY 1""",
    "matched_assets": Q.ASSETS_SQL + "SELECT asset_id FROM assets WHERE split_part(relative_path, '/', 3) IN (SELECT split_part(relative_path, '/', 3) FROM assets WHERE walk_pos % 40 = 0)",
    "registry_assets": Q.ASSETS_SQL + """, r AS (SELECT *, substr(sha256('reg' || chr(10) || relative_path), 1, 16) AS rid FROM assets)
SELECT rid AS asset_id, relative_path, digest IS NOT NULL AS present, project_ready, CAST(len(gaps) AS INT) AS n_gaps, CAST(length(rid || ' ' || relative_path || ' ' || format || ' ' || array_to_string(blockers, ' ')) AS INT) AS search_chars FROM r""",
    "section_counts": Q.ASSETS_SQL + """SELECT count(*) AS "all", count(*) FILTER (WHERE project_ready) AS project_ready, count(*) FILTER (WHERE NOT project_ready AND can_convert AND ready AND digest IS NOT NULL) AS conversion_queue,
count(*) FILTER (WHERE len(blockers) > 0 OR len(gaps) > 0 OR doc_id % 8 = 3 OR doc_id % 19 = 0) AS review,
count(*) FILTER (WHERE len(list_filter(blockers, lambda b: b <> 'blocked_permission')) = 0) AS queue_ready, count(*) FILTER (WHERE len(list_filter(blockers, lambda b: b <> 'blocked_permission')) > 0) AS queue_review FROM assets""",
    "asset_counters": Q.ASSETS_SQL + " UNION ALL ".join(f"SELECT '{n}' AS counter, coalesce(CAST({c} AS VARCHAR), 'unknown') AS name, count(*) AS n FROM assets GROUP BY ALL" for n, c in (("role", "role"), ("metadata_status", "ms"), ("format", "format"), ("can_view", "can_view"))),
}

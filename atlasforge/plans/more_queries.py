"""Queries of the remaining operators over the driver's tables, each with its DuckDB SQL: small relations are derived from documents, events, labels and nations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import estate as E
from ..operators import jobs
from ..operators import public_data as P
from ..operators import registry as R
from ..sources import bindings as B
from . import estate_queries as Q

def K() -> Column:  # noqa: N802
    return F.col("doc_id")


def SIZE() -> Column:  # noqa: N802
    return F.col("n_chars")


def documents(s: SparkSession, d: str) -> DataFrame:
    return B.table(s, d, "documents").select("doc_id", "lang", "source", "n_chars")


def events(s: SparkSession, d: str) -> DataFrame:
    return B.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def one_of(words: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (k % len(words) + 1).cast("int"))


def advisories(s: SparkSession, d: str) -> DataFrame:
    rows = B.table(s, d, "labels").join(documents(s, d), "doc_id")
    return rows.select(
        F.concat(F.lit("f-"), K().cast("string")).alias("finding_id"), one_of(("blocker", "info", "warning"), K()).alias("severity"), F.col("lang").alias("category"), F.col("source").alias("relative_path"),
        F.when(F.col("quality") == 1, "approved").otherwise("needs_review").alias("review_status"), (F.col("toxic") == 0).alias("public_candidate"),
    )


_ADVICE = """WITH a AS (SELECT 'f-' || doc_id AS finding_id, (['blocker', 'info', 'warning'])[CAST(doc_id % 3 AS INT) + 1] AS severity, lang AS category, source AS relative_path, quality = 1 AS approved, toxic = 0 AS public_candidate
FROM labels JOIN documents USING (doc_id)) """


def resolved(s: SparkSession, d: str) -> DataFrame:
    rows = documents(s, d).select(F.col("source").alias("slug"), K().alias("asset"), (SIZE() % 5).alias("fingerprint"), (SIZE() % 3).alias("other"))
    moved = F.when(F.col("asset") % 4 == 0, F.concat("slug", F.lit("-old"))).otherwise(F.col("slug"))
    return R.resolve_volumes(rows.drop("other"), rows.select(moved.alias("slug"), "asset", F.col("other").alias("fingerprint")))


def sidecar_pairs(s: SparkSession, d: str) -> DataFrame:
    i = B.inventory(s, d)
    named = F.when(K() % 7 == 3, (K() - 3).cast("string")).otherwise(F.concat(F.lit("x"), K().cast("string")))
    return R.sidecars(i.select("relative_path"), i.select(F.concat(F.lit("side/"), named, F.lit(".json")).alias("relative_path")))


def violations(s: SparkSession, d: str) -> DataFrame:
    m = events(s, d).select(F.col("event_id").alias("measurement_id"), (F.col("user_id") % 30).cast("int").alias("volume_id"), (F.col("event_id") % 120).alias("px"), (F.col("user_id") % 200).alias("py"), (F.col("event_id") % 7).alias("pz"))
    v = B.table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("volume_id"), F.lit(100).alias("x"), (F.col("n_nationkey") * 20).alias("y"), F.lit(6).alias("z"))
    return R.project_violations(m, v)


def allowed_labels(s: SparkSession, d: str) -> DataFrame:
    path = F.concat("source", F.when(K() % 5 == 0, "/../labels/").otherwise("/labels/"), K().cast("string"))
    rows = documents(s, d).select(path.alias("label_path"), F.when(SIZE() % 2 == 0, "passed").otherwise("failed").alias("validation"), (SIZE() % 3).alias("shape"), (K() % 3).alias("source_shape"))
    return R.labels_in_root(rows, ["src1", "src2/"]).select("label_path")


def stale(s: SparkSession, d: str) -> DataFrame:
    rows = documents(s, d).select(F.lit(2).alias("version"), F.col("source").alias("folder"), K().cast("string").alias("relative_path"), SIZE().alias("size_bytes"), (K() * 10).alias("modified_at"), "doc_id")
    index = rows.withColumn("relative_path", F.when(K() % 5 == 0, F.concat("relative_path", F.lit("-old"))).otherwise(F.col("relative_path"))).withColumn("size_bytes", F.when(K() % 7 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")))
    return R.needs_rebuild(index, rows).select("doc_id")


def codes(s: SparkSession, d: str) -> DataFrame:
    rows = events(s, d).select(
        "user_id", F.col("event_id").alias("code_id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "purchase", F.col("ts")).alias("consumed_at"),
        (F.col("ts") + F.expr("INTERVAL 10 DAYS")).alias("expires_at"), (F.col("event_id") % 8).alias("attempts"),
    )
    return R.valid_code(rows, F.lit("2024-02-05 00:00:00").cast("timestamp")).select("user_id", "code_id")


def byte_totals(s: SparkSession, d: str) -> DataFrame:
    return R.manifest_summary(documents(s, d).select(one_of(("included", "borderline", "excluded"), K()).alias("included_status"), SIZE().alias("lo"), (SIZE() * 2).alias("hi")))


def imported(s: SparkSession, d: str) -> DataFrame:
    rows = documents(s, d).select(F.concat("source", F.lit("/"), (K() % 100).cast("string")).alias("relative_path"), K().cast("string").alias("sha256"), F.col("lang").alias("format"), K().alias("pos"))
    return R.import_public(rows, rows)


def replaced(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d).select("event_id", "user_id", "value")
    new = e.select((F.col("event_id") + 1_000_000).alias("event_id"), F.when(F.col("user_id") < 5, F.col("user_id")).otherwise(F.col("user_id") + 1000).alias("user_id"), "value")
    return P.replace_scope(e, new.withColumn("event_id", F.when(F.col("user_id") >= 1000, -F.col("event_id")).otherwise(F.col("event_id"))), "user_id", "event_id", 100)


def kept_digests(s: SparkSession, d: str) -> DataFrame:
    rows = documents(s, d).select(K().cast("string").alias("relative_path"), F.lit("sha256").alias("algorithm"), SIZE().alias("size_bytes"), (K() % 9).alias("modified_at"), F.lit(1).alias("device_id"), K().alias("inode"))
    old = rows.withColumn("modified_at", F.when((F.col("inode") % 6 == 1) | (F.col("inode") % 4 == 0), -1).otherwise(F.col("modified_at"))).withColumn("digest", F.sha2("relative_path", 256))
    return E.unchanged(old, rows).select("relative_path", "digest")


def evidence(s: SparkSession, d: str) -> DataFrame:
    rows = documents(s, d).select(K().cast("string").alias("relative_path"), "doc_id", "n_chars")
    found_under = lambda n: F.when(K() % n == 0, F.col("relative_path")).otherwise(F.concat(F.lit("other/"), "relative_path")).alias("relative_path")
    found = P.with_evidence(rows.select("relative_path", "doc_id"), rows.select(found_under(3), F.col("n_chars").alias("remote_bytes")), rows.select(found_under(4), F.concat("relative_path", F.lit(".png")).alias("preview")))
    return found.drop("doc_id")


STATES = ("indexed", "ready", "cached", "sidecar", "review", "failed")


def totals(s: SparkSession, d: str) -> DataFrame:
    return jobs.queue_totals(documents(s, d).select(F.col("source").alias("dataset"), one_of(STATES, SIZE()).alias("queue_status")))


def queue(s: SparkSession, d: str) -> DataFrame:
    rows = documents(s, d).select(F.concat(F.lit("p"), K().cast("string")).alias("relative_path"), "doc_id", "n_chars")
    e = events(s, d).select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("relative_path"), F.col("event_type").alias("status"), "ts", "event_id")
    found_under = lambda n: F.when(K() % n == 0, F.col("relative_path")).otherwise(F.concat(F.lit("other/"), "relative_path")).alias("relative_path")
    return jobs.queue_rows(rows.select("relative_path"), rows.select(found_under(2), (F.col("n_chars") % 2 == 0).alias("ready")), rows.select(found_under(3), F.col("doc_id").alias("derivative")), e)


def broken_bundle(s: SparkSession, d: str) -> DataFrame:
    rows = documents(s, d).select(F.when(K() % 50 == 0, "other").otherwise("reg").alias("registry_id"), K().alias("asset_id"))
    return R.unresolved(rows, documents(s, d).select((K() * 2).alias("asset_id")), "reg")


def worksets(s: SparkSession, d: str) -> DataFrame:
    a = Q.assets(s, d)
    intents = F.array_compact(F.array(F.when(~F.col("project_ready"), "view"), F.when(~F.col("conversion_ready"), "convert")))
    return R.normalise_workset(a.withColumn("blocked_intents", intents)).select("asset_id", "review_required", F.array_join("blockers", ",").alias("blockers"))


def labels_text(s: SparkSession, d: str) -> DataFrame:
    c = B.catalog(s, d)
    xy, z = F.round("lateral_resolution_nm").cast("int"), F.round("axial_resolution_nm").cast("int")
    return c.select(
        "dataset_id", N.citation_label(F.col("source_study_id"), F.col("dataset_id"), F.col("year"), F.col("source")).alias("citation"), N.public_data_label(F.col("public_data_status")).alias("public_data"),
        N.voxel_size_label(xy, z, F.col("year") % 2 == 0).alias("voxel_size"), N.author_key(F.col("source_study_id")).alias("author"), N.publication_url(F.col("publication_pmid"), F.lit("#none")).alias("url"),
        N.public_status(F.col("year") % 3 != 0, F.concat(F.lit("The Full Dataset Provided in "), "source")).alias("status"),
    )


def scalars(s: SparkSession, d: str) -> DataFrame:
    path = F.concat("source", F.when(K() % 3 == 0, "/.cache/").otherwise("/data/"), K().cast("string"))
    rows = documents(s, d).select("doc_id", path.alias("path"), "source", "lang", K().alias("z"), SIZE().alias("y"), F.lit(3).alias("x"))
    return rows.select(
        "doc_id", N.is_hidden(F.col("path")).alias("hidden"), F.round(N.distance_um(F.col("z"), F.col("y"), F.col("x"), F.lit(8.0), F.lit(4.0), F.lit(30.0)), 6).alias("distance_um"),
        R.volume_fingerprint("source", "lang").alias("fingerprint"),
    )


def same_volumes(s: SparkSession, d: str) -> DataFrame:
    return R.signature(documents(s, d), ["n_chars", "doc_id", "lang"]).select("doc_id", "signature")


QUERIES = {
    "public_notices": lambda s, d: R.public_notices(advisories(s, d)).select("finding_id", "severity"),
    "advisory_page": lambda s, d: advisories(s, d).orderBy(*R.advisory_order()).select("finding_id", "severity", "category"),
    "conversion_order": lambda s, d: Q.assets(s, d).where("is_candidate").orderBy(*R.conversion_order()).select("relative_path", "review_required"),
    "resolved_volumes": resolved,
    "sidecar_pairs": sidecar_pairs,
    "project_violations": violations,
    "labels_in_root": allowed_labels,
    "stale_index": stale,
    "valid_codes": codes,
    "manifest_byte_totals": byte_totals,
    "imported_registry": imported,
    "replaced_scopes": replaced,
    "kept_digests": kept_digests,
    "asset_evidence": evidence,
    "queue_totals": totals,
    "queue_rows": queue,
    "broken_bundle": broken_bundle,
    "normalised_worksets": worksets,
    "smallest_asset": lambda s, d: P.extremes(documents(s, d).select(K().cast("string").alias("relative_path"), SIZE().alias("size_bytes"))),
    "manifest_order": lambda s, d: P.manifest_order(documents(s, d).select(F.col("lang").alias("status"), F.col("source").alias("study_id"), "doc_id"), "doc_id"),
    "plane_overlays": lambda s, d: R.on_plane(documents(s, d).select("doc_id", one_of(("x", "y", "z"), K()).alias("axis"), (SIZE() % 10).alias("slice_index")), "y", 4).select("doc_id"),
    "display_labels": labels_text,
    "scalar_fields": scalars,
    "row_signature": same_volumes,
}

_D = "FROM documents"

ORACLES = {
    "public_notices": _ADVICE + "SELECT finding_id, severity FROM a WHERE approved AND public_candidate",
    "advisory_page": _ADVICE + "SELECT finding_id, severity, category FROM a ORDER BY severity, category, relative_path, finding_id",
    "conversion_order": Q.ASSETS_SQL + "SELECT relative_path, doc_id % 8 = 3 AS review_required FROM assets WHERE is_candidate ORDER BY CAST(doc_id % 8 = 3 OR len(gaps) > 0 AS INT), relative_path",
    "resolved_volumes": f"SELECT source AS slug, doc_id AS asset, n_chars % 5 AS fingerprint, CASE WHEN doc_id % 4 = 0 THEN 'missing' WHEN n_chars % 3 = n_chars % 5 THEN 'resolved' ELSE 'changed' END AS resolution {_D}",
    "sidecar_pairs": f"WITH {B.INVENTORY_SQL} SELECT v.relative_path AS volume, 'side/' || v.doc_id || '.json' AS sidecar FROM inventory v JOIN inventory f ON f.doc_id = v.doc_id + 3 AND f.doc_id % 7 = 3",
    "project_violations": """WITH m AS (SELECT event_id, user_id % 30 AS v, event_id % 120 AS px, user_id % 200 AS py, event_id % 7 AS pz FROM events)
SELECT event_id AS measurement_id, unnest(CASE WHEN v >= 25 THEN ['unknown_volume'] ELSE list_filter([CASE WHEN px > 99 THEN 'x_out_of_bounds' END, CASE WHEN py > v * 20 - 1 THEN 'y_out_of_bounds' END, CASE WHEN pz > 5 THEN 'z_out_of_bounds' END], lambda c: c IS NOT NULL) END) AS violation FROM m""",
    "labels_in_root": f"SELECT source || '/labels/' || doc_id AS label_path {_D} WHERE doc_id % 5 <> 0 AND n_chars % 2 = 0 AND n_chars % 3 = doc_id % 3 AND source IN ('src1', 'src2')",
    "stale_index": f"SELECT doc_id {_D} WHERE doc_id % 5 = 0 OR doc_id % 7 = 0",
    "valid_codes": """SELECT user_id, event_id AS code_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
WHERE r = 1 AND event_type <> 'purchase' AND ts + INTERVAL 10 DAY > TIMESTAMP '2024-02-05' AND event_id % 8 < 5""",
    "manifest_byte_totals": f"""SELECT count(*) AS rows, count(*) FILTER (WHERE doc_id % 3 = 0) AS included, CAST(sum(n_chars) AS BIGINT) AS bytes_min, CAST(2 * sum(n_chars) AS BIGINT) AS bytes_max,
CAST(sum(n_chars) FILTER (WHERE doc_id % 3 = 0) AS BIGINT) AS included_min, CAST(2 * sum(n_chars) FILTER (WHERE doc_id % 3 = 0) AS BIGINT) AS included_max {_D}""",
    "imported_registry": f"""WITH r AS (SELECT source || '/' || (doc_id % 100) AS relative_path, CAST(doc_id AS VARCHAR) AS sha256, lang AS format, doc_id {_D})
SELECT relative_path, sha256, format, 'source' AS kind FROM r
UNION ALL SELECT relative_path, arg_min(sha256, doc_id), arg_min(format, doc_id), 'derivative' FROM r GROUP BY relative_path""",
    "replaced_scopes": """WITH n AS (SELECT CASE WHEN user_id < 5 THEN event_id + 1000000 ELSE -(event_id + 1000000) END AS event_id, CASE WHEN user_id < 5 THEN user_id ELSE user_id + 1000 END AS user_id, value FROM events)
SELECT * FROM (SELECT event_id, user_id, value FROM events WHERE user_id NOT IN (SELECT user_id FROM n) UNION ALL SELECT * FROM n) ORDER BY event_id DESC LIMIT 100""",
    "kept_digests": f"SELECT CAST(doc_id AS VARCHAR) AS relative_path, CASE WHEN doc_id % 4 <> 0 AND doc_id % 6 <> 1 THEN sha256(CAST(doc_id AS VARCHAR)) END AS digest {_D}",
    "asset_evidence": f"""SELECT CAST(doc_id AS VARCHAR) AS relative_path, CASE WHEN doc_id % 3 = 0 THEN n_chars END AS remote_bytes, doc_id % 3 = 0 AS has_remote,
CASE WHEN doc_id % 4 = 0 THEN doc_id || '.png' END AS preview, doc_id % 4 = 0 AS has_preview {_D}""",
    "queue_totals": "SELECT count(*) AS assets, count(DISTINCT source) AS datasets, " + ", ".join(f"count(*) FILTER (WHERE n_chars % 6 = {i}) AS n_{w}" for i, w in enumerate(STATES)) + f" {_D}",
    "queue_rows": """WITH j AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS job_status FROM events GROUP BY user_id)
SELECT 'p' || doc_id AS relative_path, CASE WHEN doc_id % 2 = 0 THEN n_chars % 2 = 0 END AS ready, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS derivative, job_status FROM documents LEFT JOIN j ON user_id = doc_id""",
    "broken_bundle": f"SELECT 'foreign_asset' AS problem, doc_id AS asset_id {_D} WHERE doc_id % 50 = 0 UNION ALL SELECT 'unknown_entry', doc_id * 2 {_D} WHERE doc_id * 2 NOT IN (SELECT doc_id {_D})",
    "normalised_worksets": Q.ASSETS_SQL + """SELECT asset_id, len(gaps) > 0 OR NOT project_ready OR NOT conversion_ready AS review_required,
array_to_string(list_sort(list_distinct(list_concat(blockers, list_filter([CASE WHEN NOT project_ready THEN 'blocked_intent:view' END, CASE WHEN NOT conversion_ready THEN 'blocked_intent:convert' END], lambda x: x IS NOT NULL)))), ',') AS blockers FROM assets""",
    "smallest_asset": f"SELECT arg_min(CAST(doc_id AS VARCHAR), (n_chars, CAST(doc_id AS VARCHAR))) AS smallest, min(n_chars) AS bytes {_D}",
    "manifest_order": f"SELECT lang AS status, source AS study_id, doc_id {_D} ORDER BY lang, source, doc_id",
    "plane_overlays": f"SELECT doc_id {_D} WHERE doc_id % 3 = 1 AND n_chars % 10 = 4",
    "display_labels": f"""WITH {B.CATALOG_SQL}, r AS (SELECT *, CAST(round(lateral_resolution_nm) AS INT) AS xy, CAST(round(axial_resolution_nm) AS INT) AS z FROM catalog)
SELECT dataset_id, split_part(source_study_id, ' ', 1) || ' et al., ' || year || ', ' || source AS citation, 'Data Publicly Available: ' || CASE public_data_status WHEN 'complete' THEN 'Complete' WHEN 'partial' THEN 'Partial' ELSE 'None indexed' END AS public_data,
CASE WHEN xy IS NULL THEN 'Unknown' WHEN z IS NULL THEN xy || ' nm voxel size (XY)' ELSE xy || ' x ' || z || ' nm voxel size (XY/Z, 3D)' || CASE WHEN year % 2 = 0 THEN ' isotropic' ELSE '' END END AS voxel_size,
lower(split_part(source_study_id, ' ', 1)) AS author, coalesce('https://pubmed.ncbi.nlm.nih.gov/' || publication_pmid || '/', '#none') AS url, CASE WHEN year % 3 <> 0 THEN 'complete' ELSE 'none' END AS status FROM r""",
    "scalar_fields": f"""SELECT doc_id, doc_id % 3 = 0 AS hidden, round(sqrt(pow(doc_id * 8.0, 2) + pow(n_chars * 4.0, 2) + pow(90.0, 2)) / 1000, 6) AS distance_um, source || '::' || lang || '::' || doc_id || 'x' || n_chars || 'x3' AS fingerprint {_D}""",
    "row_signature": """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || '}') AS signature FROM documents""",
}

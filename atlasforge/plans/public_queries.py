"""Public-data rule queries over documents as assets and pages as locators, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import manifests as M
from ..operators import public_data as P
from ..operators import registry as R
from ..operators import runs
from ..operators.runs import Stage
from ..scratch import scratch_path
from ..sources import bindings as B


def inventory(documents: DataFrame) -> DataFrame:
    """Documents as image assets with header, scale and preview evidence."""
    k, n = F.col("doc_id"), F.col("n_chars")
    fmt = F.element_at(F.array(*[F.lit(x) for x in ("MRC", "TIFF", "CSV", "TIFF")]), (k % 4 + 1).cast("int"))
    return documents.select(
        "doc_id", F.concat("source", F.lit("/plane_"), (k % 50).cast("string"), F.lit("_x.tif")).alias("relative_path"), n.alias("size_bytes"), F.sha2("text", 256).alias("sha256"), fmt.alias("format"),
        (n % 5).alias("nx"), F.lit(3).cast("bigint").alias("mx"), (n % 5).alias("cell_x"), F.when(k % 13 == 0, "short_read").alias("tiff_error"), F.when(k % 6 == 1, n % 400).alias("trakem2_z_nm"),
        F.when(k % 17 == 0, "dim").alias("preview_warning"), F.when(k % 3 == 0, "citation_details").otherwise("header").alias("scale_source"), F.when(n % 7 != 0, F.lit(10)).alias("x"), F.lit(10).alias("y"),
        F.when(k % 8 != 5, F.lit(1)).alias("z"), F.when(n % 4 != 0, F.lit(5.0)).alias("scale_nm"), F.when(n % 9 != 0, F.lit("p.png")).alias("preview"), (k % 5 != 0).alias("can_convert"), (k % 29 == 0).alias("indexed"), (k % 2 == 0).alias("cached"),
    )


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.conversion(P.asset_states(P.split_warnings(inventory(B.table(spark, sf_dir, "documents")).withColumn("warnings", P.warnings()))))


ASSETS_SQL = """WITH d AS (
  SELECT doc_id, source || '/plane_' || (doc_id % 50) || '_x.tif' AS relative_path, n_chars AS size_bytes, (['MRC', 'TIFF', 'CSV', 'TIFF'])[CAST(doc_id % 4 AS INT) + 1] AS format, n_chars % 5 = 3 AS same,
    doc_id % 13 = 0 AS terr, CASE WHEN doc_id % 6 = 1 THEN n_chars % 400 END AS zz, doc_id % 17 = 0 AS pw, doc_id % 3 = 0 AS trusted, n_chars % 7 <> 0 AND doc_id % 8 <> 5 AS sized, doc_id % 8 <> 5 AS has_z, n_chars % 7 <> 0 AS has_x,
    n_chars % 4 <> 0 AS scaled, n_chars % 9 <> 0 AS shown, doc_id % 5 <> 0 AS can_convert, doc_id % 29 = 0 AS indexed, doc_id % 2 = 0 AS cached FROM documents),
w AS (SELECT *, list_filter([CASE WHEN format = 'MRC' AND same AND NOT trusted THEN 'mrc_header_physical_scale_likely_default' END, CASE WHEN pw AND format <> 'CSV' THEN 'preview_warning:dim' END, CASE WHEN terr THEN 'tiff_parse_warning:short_read' END,
    CASE WHEN format <> 'CSV' AND zz <> 0 AND (zz < 30 OR zz > 250) THEN 'trakem2_z_spacing_suspicious:' || zz || 'nm' END], lambda x: x IS NOT NULL) AS blockers,
    CASE WHEN format = 'MRC' AND same AND trusted THEN ['mrc_header_physical_scale_likely_default'] ELSE CAST([] AS VARCHAR[]) END AS notes FROM d),
s AS (SELECT *, CASE WHEN format = 'CSV' THEN 'not_applicable' WHEN sized AND scaled AND shown AND len(blockers) = 0 THEN 'validated' ELSE 'needs_review' END AS state,
    CASE WHEN format = 'CSV' THEN CAST([] AS VARCHAR[]) ELSE list_sort(list_concat(blockers, list_filter([CASE WHEN NOT sized THEN 'missing_volume_dimensions' END, CASE WHEN NOT scaled THEN 'missing_physical_voxel_size' END, CASE WHEN NOT shown THEN 'missing_preview' END], lambda x: x IS NOT NULL))) END AS cb FROM w),
assets AS (SELECT *, CASE WHEN state = 'not_applicable' THEN 'not_a_volume' WHEN len(cb) > 0 THEN 'blocked' WHEN len(notes) > 0 THEN 'ready_with_review_notes' ELSE 'ready_for_conversion_trial' END AS readiness FROM s)
"""


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assets with the dataset they belong to."""
    return _described(assets(spark, sf_dir), B.table(spark, sf_dir, "documents"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A validation report: one warning for each document, of eight kinds."""
    k, n = F.col("doc_id"), F.col("n_chars").cast("string")
    d = described(spark, sf_dir).join(B.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    path = F.when(k % 5 == 0, F.lit("set")).otherwise(F.col("relative_path"))
    kinds = (
        F.concat(path, F.lit(": API reports 10 images but local file has "), n, F.lit(" slices.")), F.concat(path, F.lit(": Figshare expected 10 bytes but local file has "), n, F.lit(" bytes.")),
        F.concat(path, F.lit(": Figshare MD5 mismatch.")), F.concat(path, F.lit(": MRC MAP marker missing or unexpected.")), F.concat(path, F.lit(": treat API count as collection-level metadata.")),
        F.concat(path, F.lit(": MRC header physical scale is likely default")), F.concat(path, F.lit(": no physical voxel size found")), F.concat(path, F.lit(": Figshare MD5 mismatch. Again")),
    )
    return d.select("dataset_source", "entry_id", "dataset_slug", F.get(F.array(*kinds), (k % 8).cast("int")).alias("warning"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.findings(described(spark, sf_dir), report(spark, sf_dir))


def _described(rows: DataFrame, documents: DataFrame) -> DataFrame:
    k = F.col("doc_id")
    about = documents.select("doc_id", F.concat("source", F.lit(" Archive")).alias("dataset_source"), F.when(k % 3 != 0, F.concat(F.lit("E_"), (k % 3).cast("string"))).alias("entry_id"), F.concat(F.lit("set "), "lang").alias("dataset_slug"))
    return rows.join(about, "doc_id")


RUN = (
    Stage("inventory", ("documents",), lambda f: inventory(f["documents"])),
    Stage("warnings", ("inventory",), lambda f: P.split_warnings(f["inventory"].withColumn("warnings", P.warnings()))),
    Stage("states", ("warnings",), lambda f: P.asset_states(f["warnings"])),
    Stage("readiness", ("states",), lambda f: P.conversion(f["states"])),
    Stage("advisories", ("readiness", "documents"), lambda f: P.asset_findings(_described(f["readiness"], f["documents"]))),
    Stage("index", ("readiness", "advisories"), lambda f: f["readiness"].join(f["advisories"].groupBy(F.col("asset_relative_path").alias("relative_path")).agg(F.count("*").alias("n_findings")), "relative_path", "left")),
)


def public_data_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory, warnings, states, readiness, advisories and index as one chain; run twice, so that the second run keeps all, and read from what is published."""
    root = scratch_path(spark, "public-data-run")
    sources = {"documents": f"{sf_dir}/documents.parquet"}
    runs.run_chain(spark, root, RUN, sources)
    again = runs.run_chain(spark, root, RUN, sources)
    index = runs.published(spark, root)["index"]
    return index.select("doc_id", "state", "readiness", F.coalesce("n_findings", F.lit(0)).alias("n_findings")).withColumn("n_kept", F.lit(list(again.values()).count("kept")))


def imagesets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    rows = B.table(spark, sf_dir, "documents").select(
        F.when(k % 11 != 0, F.concat(F.lit("set-"), F.floor(k / 2).cast("string"))).alias("api_name"), F.when(k % 7 != 0, F.col("n_chars") % 3).alias("depth"), F.lit(2).cast("bigint").alias("expected"), k.alias("pos"), F.concat("source", F.lit("/"), k.cast("string")).alias("relative_path")
    )
    return P.imageset_warnings(rows)


def locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = B.table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://www.ebi.ac.uk/empiar/EMPIAR-"), "page_id")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://zenodo.org/records/"), "page_id", F.lit("?x=1"))).otherwise(F.col("url")).alias("u"))
    return p.select("page_id", P.repository_identity(F.col("u")).alias("r")).select("page_id", "r.repository", "r.accession")


def latest_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: labels with every tenth one replaced by a new row."""
    old = B.table(spark, sf_dir, "labels")
    return P.upsert(old, old.where("doc_id % 10 = 0").withColumn("quality", F.lit(9)), ["doc_id"])


def packaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as data list entries of custom, private and public origin under few slugs, with the labels table's findings and the inventory's label stores."""
    t = B.table(spark, sf_dir, "documents")
    slug, k = F.concat("source", F.lit("-"), "lang"), F.col("doc_id")
    d = t.select(slug.alias("slug"), "doc_id", (F.col("n_chars") % 3).alias("n_derivatives"), F.element_at(F.array(*[F.lit(x) for x in ("custom", "private", "public")]), (k % 3 + 1).cast("int")).alias("origin"))
    found = B.table(spark, sf_dir, "labels").join(t.select("doc_id", slug.alias("dataset_slug")), "doc_id").where("quality = 0").select("dataset_slug", F.concat(F.lit("f"), k.cast("string")).alias("finding_id"), F.when(F.col("toxic") == 1, "blocker").otherwise("review").alias("severity"))
    out = P.packaged(d, "doc_id", found, t.where("doc_id % 4 = 0").select(slug.alias("slug"), F.concat(F.lit("l/"), (k % 8).cast("string")).alias("label_path")))
    return out.select("slug", "doc_id", "n_derivatives", "origin", F.size("findings").alias("n_findings"), F.array_join(F.transform("findings", lambda f: F.concat(f["finding_id"], F.lit(":"), f["severity"])), ",").alias("findings"), F.array_join("labels", ",").alias("labels"))


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assets as public sources, and derivatives of some of them, a few of which share an output."""
    k = F.col("doc_id")
    a = assets(spark, sf_dir)
    group = F.when(F.col("readiness") == "not_a_volume", "sidecar").when(F.col("readiness") == "blocked", "blocked").otherwise("ready")
    sources = a.select(
        F.lit("set").alias("dataset_slug"), F.concat("relative_path", k.cast("string")).alias("relative_path"), group.alias("asset_group"), F.when(k % 10 != 0, F.col("readiness")).alias("readiness"), (F.col("state") != "not_applicable").alias("conversion_target"), F.when(k % 6 != 0, F.col("sha256")).otherwise("").alias("sha256"),
        "size_bytes", "format", "x", F.when(k % 8 != 5, F.col("y")).alias("y"), "z", F.col("conversion_blockers").alias("blockers"), "review_notes",
    )
    made = a.where("doc_id % 3 = 0").select(
        F.lit("set").alias("dataset_slug"), k.alias("pos"), F.concat("relative_path", k.cast("string")).alias("source_relative_path"), F.concat(F.lit("out/"), F.floor(k / 6).cast("string")).alias("output_path"), (F.col("size_bytes") * 2).alias("byte_size"),
        F.when(k % 4 != 0, "passed").otherwise("failed").alias("validation"), F.when(k % 5 != 0, F.col("sha256")).alias("checksum"), F.when(k % 7 != 0, F.array(F.lit(1), F.lit(2), F.lit(3))).alias("shape"),
    )
    out = R.public_registry(sources, made)
    return _lists(out.withColumn("gaps", F.transform("gaps", lambda g: F.concat(g["gap_code"], F.lit("="), g["severity"]))), "gaps", "blocked_states", "review_notes")


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as inventory rows with some of the scales known, by the rules of both sources."""
    k, n = F.col("doc_id"), F.col("n_chars")
    scale = lambda m, at, v: F.when(k % m == at, F.struct(F.lit(v).alias("x"), F.lit(v).alias("y"), F.lit(2 * v).alias("z")))
    rows = B.table(spark, sf_dir, "documents").select(
        F.col("source").alias("entry_id"), F.concat("source", F.lit("/"), k.cast("string")).alias("relative_path"), F.lit("MRC").alias("format"), n.alias("size_bytes"), F.when(k % 2 == 0, "s").alias("sha256"), (n % 3).alias("mrc_nx"), (n % 4).alias("mrc_ny"), F.lit(None).cast("bigint").alias("mrc_nz"),
        F.lit(7).cast("bigint").alias("tiff_width"), F.when(k % 3 != 0, n).alias("tiff_height"), F.lit(9).cast("bigint").alias("tiff_slices"), scale(7, 0, 1.0).alias("asset_scale"), scale(5, 0, 2.0).alias("citation_scale"), scale(3, 0, 3.0).alias("curated_scale"),
        F.when(k % 2 == 0, F.struct(F.lit(4.0).alias("x"), F.lit(4.0).alias("y"), F.when(k % 4 == 0, 8.0).alias("z"))).alias("tiff_scale"), scale(11, 0, 6.0).alias("mrc_scale"),
        F.when(k % 3 == 1, F.struct(F.lit(5.0).alias("x"), F.lit(5.0).alias("y"), F.lit(10.0).alias("z"), F.when(k % 2 == 0, "trakem2_calibration_times_layer_thickness").otherwise("").alias("z_source"))).alias("trakem2"),
    )
    both = [M.normalised_assets(rows, x).withColumn("api", F.lit(x)) for x in ("empiar", "figshare")]
    p, h, d = (lambda c, n=n: F.col(f"{n}.{c}") for n in ("physical_voxel_size_nm", "header_voxel_size_nm", "dimensions"))
    return both[0].unionByName(both[1]).select("api", "relative_path", "sha256", d("x").alias("nx"), d("y").alias("ny"), d("z").alias("nz"), p("x").alias("x"), p("z").alias("z"), p("source").alias("scale_source"), h("z").alias("header_z"), h("source").alias("header_source"))


def scaffolded(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = B.table(spark, sf_dir, "part"), F.col("p_size")
    raw = p.select(
        F.col("p_partkey").alias("id"), F.when(n % 7 == 0, "0").when(n % 7 == 1, "").alias("dataset_id"), F.col("p_name").alias("title"), F.when(n % 2 == 0, "p").alias("publication_title"), (n % 3 * 1000).alias("year"),
        F.lit("s").alias("source"), F.when(n % 6 != 0, "paper").otherwise("").alias("source_type"), F.lit("0").alias("species"), F.when(n > 9, F.col("p_brand")).alias("cell_type"), F.col("p_type").alias("modality"),
        F.when(n % 4 != 0, F.split("p_type", " ")).otherwise(F.array().cast("array<string>")).alias("organelles"), F.when(n % 5 != 0, n % 5 / 10 - 0.1).alias("metadata_completeness_score"), F.when(n % 9 == 0, F.array(F.lit("volume"))).alias("metric_families"),
    )
    return P.scaffold(raw).select("dataset_id", "paper_title", "year", "source_type", "modality_family", F.size("organelles").alias("n_organelles"), F.round("metadata_completeness_score", 3).alias("score"), "whole_cell_boundary_confirmed", "warning")


def _lists(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.array_join(c, ","))
    return df


QUERIES = {
    "asset_states": lambda s, d: _lists(assets(s, d).select("doc_id", "state", "blockers", "review_notes"), "blockers", "review_notes"),
    "conversion_readiness": lambda s, d: _lists(assets(s, d).select("doc_id", "readiness", "conversion_blockers"), "conversion_blockers"),
    "conversion_totals": lambda s, d: P.conversion_totals(assets(s, d)),
    "queue_status": lambda s, d: P.queue_status(assets(s, d)).select("doc_id", "gate", "queue_status"),
    "advisory_findings": lambda s, d: findings(s, d).withColumns({"n_evidence": F.size("evidence"), "first_field": F.col("evidence")[0]["field"], "first_value": F.col("evidence")[0]["value"]}).drop("evidence", "entry_id", "summary", "impact", "recommended_action"),
    "longest_assets": lambda s, d: P.longest_groups(described(s, d).withColumn("z", F.when(F.col("z").isNotNull(), F.col("doc_id") % 40)), "dataset_source"),
    "advisory_summary": lambda s, d: P.advisory_summary(findings(s, d)),
    "imageset_counts": imagesets,
    "tiff_series": lambda s, d: P.tiff_series(assets(s, d).dropDuplicates(["relative_path"]).withColumn("format", F.lit("TIFF")).withColumn("x", F.lit(10)).withColumn("z", F.lit(1)).withColumn("size_bytes", F.lit(1).cast("bigint"))),
    "repository_identity": locators,
    "label_upsert": latest_labels,
    "packaged_slugs": packaged,
    "public_data_run": public_data_run,
    "public_registry": registered,
    "normalised_manifest": normalised,
    "scaffold": scaffolded,
}

_FIND = ASSETS_SQL + """, about AS (SELECT assets.*, n_chars, d.source || ' Archive' AS dataset_source, CASE WHEN doc_id % 3 <> 0 THEN 'E_' || (doc_id % 3) END AS entry_id, 'set ' || lang AS dataset_slug FROM assets JOIN documents d USING (doc_id)),
said AS (SELECT *, unnest(list_distinct(list_concat(blockers, notes, list_filter([CASE WHEN format <> 'CSV' AND NOT sized THEN 'missing_volume_dimensions' END, CASE WHEN format <> 'CSV' AND NOT scaled THEN 'missing_physical_voxel_size' END], lambda x: x IS NOT NULL)))) AS said FROM about),
own AS (SELECT dataset_source, entry_id, dataset_slug, relative_path AS asset, said AS told, split_part(said, ':', 1) AS code, CASE WHEN has_x THEN '"x":10,' ELSE '' END || '"y":10' || CASE WHEN has_z THEN ',"z":1' ELSE '' END AS xyz, CASE WHEN scaled THEN '{"nm":5.0}' ELSE '{}' END AS nm FROM said WHERE NOT starts_with(said, 'preview_warning')),
texts AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'set' ELSE relative_path END AS asset FROM about),
rep AS (SELECT dataset_source, entry_id, dataset_slug, CASE WHEN doc_id % 8 = 4 THEN '' ELSE asset END AS asset,
  (['image_count_mismatch', 'figshare_size_mismatch', 'figshare_md5_mismatch', 'mrc_map_marker_unexpected', 'collection_level_image_count'])[CAST(doc_id % 8 AS INT) + 1] AS code,
  asset || ([': API reports 10 images but local file has ' || n_chars || ' slices.', ': Figshare expected 10 bytes but local file has ' || n_chars || ' bytes.', ': Figshare MD5 mismatch.', ': MRC MAP marker missing or unexpected.', ': treat API count as collection-level metadata.'])[CAST(doc_id % 8 AS INT) + 1] AS told
  FROM texts WHERE doc_id % 8 < 5),
rules(code, category, severity, n_evidence, first_field) AS (VALUES
  ('mrc_header_physical_scale_likely_default', 'physical_scale', 'review', 3, 'validated_volume.warnings'), ('trakem2_z_spacing_suspicious', 'physical_scale', 'warning', 3, 'validated_volume.warnings'),
  ('missing_physical_voxel_size', 'physical_scale', 'warning', 2, 'validated_volume.physical_voxel_size_nm'), ('missing_volume_dimensions', 'volume_geometry', 'warning', 2, 'validated_volume.dimensions'),
  ('tiff_parse_warning', 'file_readability', 'warning', 1, 'validated_volume.warnings'), ('collection_level_image_count', 'repository_metadata', 'info', 1, 'warnings'),
  ('image_count_mismatch', 'repository_metadata', 'warning', 1, 'warnings'), ('figshare_size_mismatch', 'file_integrity', 'critical', 1, 'warnings'),
  ('figshare_md5_mismatch', 'file_integrity', 'critical', 1, 'warnings'), ('mrc_map_marker_unexpected', 'file_format', 'warning', 1, 'warnings')),
every AS (SELECT * FROM (SELECT dataset_source, entry_id, dataset_slug, asset, code, told, xyz, nm FROM own UNION ALL SELECT *, NULL, NULL FROM rep) JOIN rules USING (code)),
g AS (SELECT dataset_source, dataset_slug, asset AS asset_relative_path, code, category, severity, n_evidence::INT AS n_evidence, first_field, true AS public_notice_candidate, 'needs_human_review' AS review_status,
  CASE first_field WHEN 'validated_volume.dimensions' THEN '{' || xyz || '}' WHEN 'validated_volume.physical_voxel_size_nm' THEN nm ELSE told END AS first_value,
  array_to_string(list_transform([dataset_source, coalesce(entry_id, dataset_slug), category, CASE WHEN asset = '' THEN 'dataset' ELSE asset END, code], lambda p: substr(regexp_replace(regexp_replace(lower(p), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80)), '-') AS finding_id FROM every)
"""

ORACLES = {
    "asset_states": ASSETS_SQL + "SELECT doc_id, state, array_to_string(blockers, ',') AS blockers, array_to_string(notes, ',') AS review_notes FROM assets",
    "conversion_readiness": ASSETS_SQL + "SELECT doc_id, readiness, array_to_string(cb, ',') AS conversion_blockers FROM assets",
    "conversion_totals": ASSETS_SQL + "SELECT CASE readiness WHEN 'not_a_volume' THEN 'sidecar' WHEN 'blocked' THEN 'blocked' ELSE 'ready' END AS kind, count(*) AS n, round(sum(size_bytes) / 1073741824.0, 3) AS gib FROM assets GROUP BY 1",
    "queue_status": ASSETS_SQL + """, g AS (SELECT *, CASE WHEN NOT can_convert THEN 'permission_denied' WHEN readiness = 'not_a_volume' THEN 'not_a_volume' WHEN len(cb) > 0 THEN 'blocked' ELSE 'ready' END AS gate FROM assets)
SELECT doc_id, gate, CASE WHEN indexed THEN 'indexed' WHEN gate = 'ready' THEN 'ready' WHEN cached THEN 'cached' WHEN gate = 'not_a_volume' THEN 'sidecar' ELSE 'review' END AS queue_status FROM g""",
    "advisory_findings": _FIND + "SELECT * FROM g",
    "public_data_run": _FIND + "SELECT doc_id, state, readiness, coalesce(n, 0) AS n_findings, 6 AS n_kept FROM about LEFT JOIN (SELECT asset, count(*) AS n FROM own GROUP BY asset) ON asset = relative_path",
    "longest_assets": _FIND + "SELECT dataset_source, arg_min(relative_path, (-(doc_id % 40), relative_path)) FILTER (WHERE has_z) AS longest, max(doc_id % 40) FILTER (WHERE has_z) AS depth FROM about GROUP BY dataset_source",
    "advisory_summary": _FIND + "SELECT 'severity' AS by, severity AS name, count(*) AS n FROM g GROUP BY severity UNION ALL SELECT 'category', category, count(*) FROM g GROUP BY category UNION ALL SELECT 'review_status', review_status, count(*) FROM g GROUP BY review_status",
    "imageset_counts": """WITH r AS (SELECT 'set-' || (doc_id // 2) AS api_name, doc_id, CASE WHEN doc_id % 7 <> 0 THEN n_chars % 3 END AS depth, source || '/' || doc_id AS p FROM documents WHERE doc_id % 11 <> 0),
g AS (SELECT api_name, sum(depth) AS total, count(depth) AS known, count(*) AS n, arg_min(p, doc_id) AS p FROM r GROUP BY api_name)
SELECT api_name, CASE WHEN n > 1 THEN api_name || ': API reports 2 images for an imageset spanning ' || n || ' local files with ' || total || ' total slices; treat API count as collection-level metadata.' ELSE p || ': API reports 2 images but local file has ' || total || ' slices.' END AS warning FROM g WHERE known > 0 AND total <> 2""",
    "tiff_series": """WITH p AS (SELECT DISTINCT source, doc_id % 50 AS i FROM documents)
SELECT source || '/plane_' || min(i) || '-' || max(i) || '_x.tiff-series' AS source_path, count(*) AS planes, count(*) AS bytes, source || '/plane_' || min(i) || '_x.tif' AS first_asset, source || '/plane_' || max(i) || '_x.tif' AS last_asset FROM p GROUP BY source HAVING count(*) >= 2""",
    "repository_identity": """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'EMPIAR' WHEN 1 THEN 'Zenodo' ELSE lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) END AS repository, CASE WHEN page_id % 3 < 2 THEN CAST(page_id AS VARCHAR) END AS accession FROM pages""",
    "label_upsert": "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 9 ELSE quality END AS quality, toxic FROM labels",
    "packaged_slugs": """WITH d AS (SELECT source || '-' || lang AS slug, doc_id, n_chars % 3 AS n_derivatives, (['custom', 'private', 'public'])[CAST(doc_id % 3 AS INT) + 1] AS origin FROM documents),
f AS (SELECT slug, count(*) AS n, string_agg('f' || doc_id || CASE WHEN toxic = 1 THEN ':blocker' ELSE ':review' END, ',' ORDER BY 'f' || doc_id) AS t FROM labels JOIN d USING (doc_id) WHERE quality = 0 GROUP BY slug),
l AS (SELECT slug, array_to_string(list_sort(list(DISTINCT 'l/' || (doc_id % 8))), ',') AS t FROM d WHERE doc_id % 4 = 0 GROUP BY slug),
q AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY slug ORDER BY doc_id DESC) = 1)
SELECT q.*, CAST(coalesce(f.n, 0) AS INT) AS n_findings, coalesce(f.t, '') AS findings, coalesce(l.t, '') AS labels FROM q LEFT JOIN f USING (slug) LEFT JOIN l USING (slug) WHERE n_derivatives > 0""",
    "public_registry": ASSETS_SQL + """, src AS (SELECT a.*, d.text, 'set/data/' || relative_path || doc_id AS p, CASE WHEN doc_id % 10 = 0 THEN CASE WHEN readiness = 'not_a_volume' THEN 'not_applicable' ELSE 'unknown' END ELSE readiness END AS st FROM assets a JOIN documents d USING (doc_id)),
o AS (SELECT 'out/' || (doc_id // 6) AS p, size_bytes * 2 AS b, doc_id % 4 <> 0 AS ok, CASE WHEN doc_id % 5 <> 0 THEN sha256(text) END AS sum, doc_id % 7 <> 0 AS shaped FROM src WHERE doc_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY doc_id // 6 ORDER BY doc_id) = 1)
SELECT 'source' AS kind, p AS relative_path, 'file' AS path_type, CASE WHEN format <> 'CSV' THEN 'raw_volume_candidate' ELSE 'metadata_sidecar' END AS role, size_bytes, CASE WHEN doc_id % 6 <> 0 THEN sha256(text) END AS digest,
  CASE WHEN starts_with(st, 'ready_') THEN 'validated' ELSE st END AS asset_status, 'checksummed' AS fixity_status, CASE WHEN starts_with(st, 'ready_') THEN 'validated' ELSE st END AS triage_status, CASE WHEN st = 'blocked' THEN 'blocked_review' ELSE '' END AS blocked_states,
  'public_data_manifest' || CASE WHEN doc_id % 3 = 0 THEN ',streamable_derivative_available' ELSE '' END AS review_notes, starts_with(st, 'ready_') AS can_convert, false AS can_view, CASE WHEN has_x OR has_z THEN 'readable' ELSE 'not_extracted' END AS metadata_status, format,
  array_to_string(list_concat(list_transform(cb, lambda x: x || '=blocker'), list_transform(notes, lambda x: x || '=review')), ',') AS gaps, format <> 'CSV' AS is_candidate, st = 'blocked' AS review_required, 'published' AS publication_status, 'public' AS rights_status FROM src
UNION ALL SELECT 'derivative', p, 'directory_volume', 'raw_volume_candidate', b, sum, CASE WHEN ok AND sum IS NOT NULL THEN 'project_ready' ELSE 'derived_review' END, CASE WHEN sum IS NOT NULL THEN 'composite_checksummed' ELSE 'component_checksums_pending' END, 'converted',
  concat_ws(',', CASE WHEN NOT ok THEN 'blocked_validation' END, CASE WHEN sum IS NULL THEN 'missing_composite_checksum' END), 'public_data_derivative_manifest', false, ok AND sum IS NOT NULL, CASE WHEN shaped THEN 'readable' ELSE 'not_extracted' END, 'Zarr', '', true, NOT (ok AND sum IS NOT NULL), 'published', 'public' FROM o""",
    "normalised_manifest": """WITH r AS (SELECT *, source || '/' || doc_id AS p, doc_id % 4 = 0 AS tiff FROM documents),
c AS (SELECT 'empiar' AS api, *, CASE WHEN doc_id % 7 = 0 THEN 1.0 WHEN doc_id % 5 = 0 THEN 2.0 WHEN doc_id % 3 = 0 THEN 3.0 WHEN tiff THEN 4.0 END::DOUBLE AS x, CASE WHEN doc_id % 7 = 0 THEN 'asset_api_details' WHEN doc_id % 5 = 0 THEN 'citation_details' WHEN doc_id % 3 = 0 THEN 'curated_public_data_assets_resolution' WHEN tiff THEN 'tiff_imagej_metadata' ELSE '' END AS src FROM r
  UNION ALL SELECT 'figshare', *, CASE WHEN tiff THEN 4.0 WHEN doc_id % 3 = 1 THEN 5.0 END, CASE WHEN tiff THEN 'tiff_imagej_metadata' WHEN doc_id % 3 = 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'trakem2_calibration_times_layer_thickness' ELSE 'trakem2_calibration' END ELSE '' END FROM r)
SELECT api, p AS relative_path, CASE WHEN doc_id % 2 = 0 THEN 's' ELSE '' END AS sha256, CASE WHEN n_chars % 3 = 0 THEN 7 ELSE n_chars % 3 END AS nx, CASE WHEN n_chars % 4 <> 0 THEN n_chars % 4 WHEN doc_id % 3 <> 0 THEN nullif(n_chars, 0) END AS ny, 9 AS nz, x, 2 * x AS z, src AS scale_source,
CASE WHEN doc_id % 11 = 0 THEN 12.0::DOUBLE END AS header_z, CASE WHEN doc_id % 11 = 0 THEN 'mrc_header' ELSE '' END AS header_source FROM c""",
    # the required fields in order, from the list of the record's definition
    "scaffold": """WITH r AS (
  SELECT CASE WHEN p_size % 7 = 0 THEN '0' ELSE CAST(p_partkey AS VARCHAR) END AS dataset_id, CASE WHEN p_size % 2 = 0 THEN 'p' END AS paper_title, p_size % 3 * 1000 AS year, CASE WHEN p_size % 6 <> 0 THEN 'paper' ELSE '' END AS source_type,
         'other' AS modality_family, CAST(CASE WHEN p_size % 4 <> 0 THEN len(string_split(p_type, ' ')) ELSE 0 END AS INT) AS n_organelles, round(CASE WHEN p_size % 5 <> 0 THEN p_size % 5 / 10 - 0.1 ELSE 0 END, 3) AS score, 'unclear' AS whole_cell_boundary_confirmed, p_size FROM part),
m AS (SELECT *, list_filter([CASE WHEN p_size <= 9 THEN 'cell_type' END, CASE WHEN score = 0 THEN 'metadata_completeness_score' END, CASE WHEN p_size % 9 <> 0 THEN 'metric_families' END, 'organelle_pairs', CASE WHEN n_organelles = 0 THEN 'organelles' END,
  CASE WHEN paper_title IS NULL THEN 'paper_title' END, CASE WHEN source_type = '' THEN 'source_type' END, CASE WHEN year = 0 THEN 'year' END], lambda x: x IS NOT NULL) AS ms FROM r)
SELECT * EXCLUDE (p_size, ms), dataset_id || ': Missing required fields: ' || array_to_string(ms, ', ') AS warning FROM m""",
}

"""Worksets, pilot reports, asset states, project files, labels, manifests and exports over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import manifests
from ..operators import registry as R
from ..operators import worksets as W
from ..scratch import scratch_path
from ..sinks import writers
from ..sources import bindings as B
from ..sources import readers, volumes
from . import estate_queries as Q
from . import public_queries as U

INTENTS = ("convert", "measure", "publish", "review", "teleport")


def assets(s: SparkSession, d: str) -> DataFrame:
    k = F.col("walk_pos")
    return Q.assets(s, d).withColumns({
        "rights_status": F.when(k % 4 == 0, "cleared").when(k % 4 == 1, "").when(k % 4 == 2, "restricted"), "triage_status": F.when(k % 3 == 0, "kept"), "publication_status": F.when(k % 5 == 0, "published"), "can_publish": k % 7 == 0,
        "actions": F.array_compact(F.array(F.when(F.size("gaps") > 0, "Fill gaps"), F.when(k % 2 == 0, "Check rights"), F.when(k % 10 == 0, ""), F.concat(F.lit("Step "), (k % 20).cast("string")))),
    })


def records(s: SparkSession, d: str) -> DataFrame:
    return W.promote(assets(s, d), F.col("walk_pos") % 9 != 4, INTENTS)


def state_manifest(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    a = U.assets(s, d).withColumn("relative_path", F.concat("relative_path", k.cast("string"))).withColumns({"source": F.lit("EMPIAR"), "header_scale_nm": F.when(k % 2 == 0, F.lit(2.5))})
    remote = a.where("doc_id % 3 <> 0").select("relative_path", F.concat(F.lit("https://example.org/"), k.cast("string")).alias("url"), k.alias("pos"))
    previews = a.where("preview is not null").select("relative_path", F.concat(F.lit("p/"), k.cast("string")).alias("preview"), k.alias("pos"))
    m = W.asset_state_manifest(a, remote, previews, "/pilot/")
    return m.select("relative_path", "source_asset.url", "source_asset.repository_path", "mirrored_asset.local_path", "mirrored_asset.size_bytes", F.col("validated_volume.state").alias("volume_state"), "validated_volume.preview_path", "validated_volume.header_voxel_size_nm", F.col("streamable_derivative.state").alias("derivative_state"))


def project_files(s: SparkSession, d: str) -> DataFrame:
    """Sources as projects, documents as their volumes, notes, measurements, regions and jobs, some of which break rules."""
    t = B.table(s, d, "documents").select("doc_id", "n_chars", F.col("source").alias("project_id"), F.col("lang").alias("dataset_slug"))
    k, n = F.col("doc_id"), F.col("n_chars")
    text = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    when = lambda m, at, good, bad: F.when(k % m == at, bad).otherwise(good)
    stamp, bad = F.lit("2024-01-02T03:04:05Z"), F.lit("soon")
    v = t.where("doc_id % 2 = 0").select(
        "project_id", k.alias("id"), "dataset_slug", text("a", F.floor(k / when(20, 0, F.lit(1), F.lit(100)))).alias("asset_path"), F.lit("EMPIAR").alias("source"), when(30, 0, F.lit("e1"), F.lit(" ")).alias("entry_id"), F.lit("TIFF").alias("format"), F.lit("|u1").alias("dtype"),
        (n % 50).alias("z"), F.lit(40).alias("y"), F.lit(30).alias("x"), when(22, 0, n, F.lit(-1)).alias("source_size_bytes"), text("f", k).alias("fingerprint"),
    )
    point = lambda *c: F.struct(*[x.cast("long").alias(a) for a, x in zip("xyz", c, strict=True)])
    place = {"asset_path": text("a", when(7, 0, k - k % 2, F.lit(-5))), "axis": when(9, 0, F.lit("z"), F.lit("w")), "slice": n % 60, "created_at": when(8, 0, stamp, bad)}
    m = t.select("project_id", k.alias("id"), "dataset_slug", "n_chars", "doc_id").withColumns(place | {"label": when(6, 0, F.lit("M1"), F.lit("")), "start": point(n % 31, n % 40, n % 20), "end": when(4, 0, point(k * 0, k * 0, k * 0), F.lit(None)), "distance_um": when(5, 0, n / 10, F.lit(-1.0))})
    r = t.select("project_id", k.alias("id"), "dataset_slug", "n_chars", "doc_id").withColumns(place | {"label": F.lit("R"), "category": when(6, 1, F.lit("c"), F.lit(None)), "kind": when(5, 0, when(2, 0, F.lit("point"), F.lit("box")), F.lit("line")), "start": point(n % 29, n % 41, n * 0), "end": when(4, 0, point(n % 31, n * 0, n * 0), F.lit(None))})
    notes = t.select("project_id", when(3, 0, text("n", k), F.lit("")).alias("id"), when(4, 0, F.lit("view"), F.lit("all")).alias("scope"), stamp.alias("created_at"), when(5, 0, stamp, F.lit(None)).alias("updated_at"))
    j = t.select("project_id", k.alias("id"), "dataset_slug", "doc_id").withColumns({"asset_path": place["asset_path"], "title": F.lit("t"), "summary": when(6, 0, F.lit("s"), F.lit("")), "kind": when(4, 0, F.lit("histogram"), F.lit("other")), "status": when(3, 0, F.lit("completed"), F.lit("running")), "created_at": stamp})
    first = F.min_by(F.struct("dataset_slug", "asset_path", "fingerprint"), "id")
    p = v.groupBy("project_id").agg(first.alias("f"), F.count("*").alias("n"), F.sort_array(F.collect_set("fingerprint")).alias("prints"))
    i = F.regexp_extract("project_id", "(\\d+)", 1).cast("int")
    p = p.select(
        "project_id", F.when(i % 5 == 0, "").otherwise("P").alias("name"), stamp.alias("created_at"), F.when(i % 4 == 0, bad).otherwise(stamp).alias("updated_at"), F.when(i % 3 == 0, "none").otherwise(F.col("f.dataset_slug")).alias("active_slug"), F.col("f.asset_path").alias("active_path"),
        F.when(i % 2 == 0, "x").otherwise(F.col("f.fingerprint")).alias("active_fingerprint"), F.when(i % 6 == 0, F.lit(0)).otherwise(F.col("n")).alias("volume_count"), F.when(i % 7 == 0, F.concat(F.slice("prints", 2, 10_000_000), F.array(F.lit("zz")))).otherwise(F.col("prints")).alias("volume_fingerprints"),
    )
    return W.project_violations(p, v, notes, m, r, j).groupBy("project_id", "item", "violation").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def labels(s: SparkSession, d: str) -> DataFrame:
    t = B.table(s, d, "documents").select("doc_id", "n_chars", "source")
    k = F.col("doc_id")
    out = F.concat(F.lit("/data/"), "source", F.when(k % 3 == 0, "/./").otherwise("/"), k.cast("string"))
    sources = t.select(F.concat("source", F.lit("/"), k.cast("string"), F.when(k % 11 == 0, "#segmentation=a").otherwise("")).alias("relative_path"), out.alias("output_path"), F.array(F.lit(2), F.col("n_chars") % 3).alias("shape"))
    path = F.concat(F.lit("/data/"), "source", F.lit("/"), k.cast("string"))
    manifests = t.select(F.concat(path, F.lit(".segmentations.json")).alias("manifest_path"), F.when(k % 7 == 0, "other").otherwise(R.LABEL_SCHEMA).alias("schema"), F.when(k % 13 == 0, 2).otherwise(1).alias("schema_version"), F.when(k % 17 == 0, "/else").otherwise(path).alias("source_output_path"))
    inside = F.concat(path, F.when(k % 5 == 0, ".segmentations/../x").when(k % 5 == 1, ".segmentations/a..b/l").otherwise(".segmentations/y/../l"))
    entries = t.select(F.concat(path, F.lit(".segmentations.json")).alias("manifest_path"), F.when(k % 19 == 0, "").otherwise("s1").alias("segmentation_id"), F.when(k % 4 == 0, "failed").otherwise("passed").alias("validation"), inside.alias("output_path"), F.array(F.lit(2), k % 3).alias("shape"))
    return R.label_derivatives(sources, manifests, entries)


def texts(s: SparkSession, d: str) -> DataFrame:
    k, n = F.col("doc_id"), F.col("n_chars").cast("string")
    words = F.when(k % 4 == 0, F.concat(n, F.lit(" nm3  Isotropic"))).when(k % 4 == 1, F.concat(n, F.lit(".5 × 4nm x 3 nm^3"))).when(k % 4 == 2, F.concat(n, F.lit("nmisotropic"))).otherwise(F.concat(n, F.lit(" nm"))) 
    rows = B.table(s, d, "documents").select("doc_id", "n_chars", N.scale_from_text(words).alias("v"))
    return rows.select("doc_id", "v.x", "v.y", "v.z", N.mode_octal(F.lit(0o100000) + k % 4096).alias("mode"), N.iso_time(F.lit(1_700_000_000) + k * 1000 + F.when(k % 2 == 0, 0.25).otherwise(0)).alias("modified_at"))


def calibrations(s: SparkSession, d: str) -> DataFrame:
    """TrakEM2 texts made from the documents: cubes and flat voxels, thick layers, units, and texts without a calibration."""
    k, n = F.col("doc_id"), F.col("n_chars").cast("string")
    depth = F.when(k % 2 == 0, n).otherwise("7")
    unit = F.when(k % 3 == 0, "nm").when(k % 3 == 1, "micron").otherwise("furlong")
    element = F.concat(F.lit('<t2_calibration\n pixelWidth="'), n, F.lit('" pixelHeight="'), n, F.lit('" pixelDepth="'), depth, F.lit('" unit="'), unit, F.lit('"\n/>'))
    layer = F.when(k % 5 != 0, F.concat(F.lit(' <t2_layer oid="4" thickness="'), F.when(k % 7 == 0, "0.5").otherwise("12.0"), F.lit('" z="0"> <t2_layer oid="5" thickness="99">'))).otherwise("")
    rows = B.table(s, d, "documents").select("doc_id", volumes.trakem2_calibration(F.when(k % 11 == 0, "<t2_layer_set/>").otherwise(F.concat(element, layer))).alias("c"))
    return rows.select("doc_id", "c.x", "c.z", "c.raw_z", "c.layer_thickness", "c.z_source", "c.unit")


def curated(s: SparkSession, d: str) -> DataFrame:
    """Parts as curated rows that name accessions, looked up for the suppliers' entries."""
    rows = B.table(s, d, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("see empiar-"), F.col("p_partkey").cast("string"), F.lit(" and XEMPIAR"), (F.col("p_partkey") + 7).cast("string"), F.lit(".")).alias("text"))
    entries = B.table(s, d, "supplier").select("s_suppkey", F.concat(F.lit("EMPIAR-"), (F.col("s_suppkey") * 3).cast("string")).alias("entry_id"))
    return readers.curated_lookup(entries, rows, "entry_id", "pos").select("s_suppkey", "curated.pos", "curated.text")


def json_rows(s: SparkSession, d: str) -> DataFrame:
    """Events written as JSON lines and read back with their schema."""
    path = scratch_path(s, "json")
    t = B.table(s, d, "events").select("event_id", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), F.array("event_type", F.lit('a "b" é')).alias("words"))
    writers.write_json(t, path)
    return _joined(readers.jsonl(s, path, t.schema), "words")


def measured(s: SparkSession, d: str) -> DataFrame:
    t = B.table(s, d, "lineitem")
    n = F.col("l_linenumber")
    return writers.measurement_rows(t.select(F.concat(F.lit("M"), F.col("l_orderkey").cast("string"), F.lit("."), n.cast("string")).alias("label"), n.alias("x1"), (n + 1).alias("y1"), F.lit(0).alias("z1"), (n * 2).alias("x2"), F.lit(5).alias("y2"), n.alias("z2"), (F.col("l_extendedprice") / 7).alias("distance_um")))


def documents_of(s: SparkSession, d: str) -> DataFrame:
    c = B.catalog(s, d).select("dataset_id", "title", "year", "organelles")
    return c.select("dataset_id", writers.handoff_document(["dataset_id", "title", "year", "organelles"]).alias("document"))


def located(s: SparkSession, d: str) -> DataFrame:
    """Orders as datasets of customers (studies), of which only some are known as studies or have public assets."""
    study = lambda k: F.concat(F.lit("Study #"), F.col(k).cast("string"))
    datasets = B.table(s, d, "orders").select(study("o_custkey").alias("study_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("cell_type"))
    studies = B.table(s, d, "customer").where("c_custkey % 3 <> 0").select(study("c_custkey").alias("study_id"), F.when(F.col("c_custkey") % 2 == 0, "borderline").otherwise("included").alias("included_status"), F.col("c_mktsegment").alias("journal_published"))
    public = B.table(s, d, "customer").where("c_custkey % 5 = 0").select(study("c_custkey").alias("study_id"), F.lit("https://zenodo.org/record/1").alias("public_locator_urls"), F.lit("Zenodo").alias("repository_types"))
    return manifests.locator_manifest(datasets, studies, public)


def _joined(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.array_join(c, ","))
    return df


QUERIES = {
    "workset_promotion": lambda s, d: _joined(records(s, d).select("asset_id", "blocked_operations", "can_enter"), "blocked_operations"),
    "workset_summary": lambda s, d: W.workset_summary(records(s, d)),
    "workset_findings": lambda s, d: W.workset_findings(records(s, d), INTENTS),
    "workset_review_queue": lambda s, d: W.workset_review_queue(records(s, d)).select("asset_id"),
    "pilot_summary": lambda s, d: W.pilot_summary(assets(s, d)),
    "pilot_findings": lambda s, d: W.pilot_findings(assets(s, d)),
    "pilot_next_steps": lambda s, d: W.pilot_next_steps(assets(s, d), "candidate"),
    "asset_state_manifest": state_manifest,
    "project_rules": project_files,
    "label_derivatives": labels,
    "path_and_scale_texts": texts,
    "trakem2_scales": calibrations,
    "curated_lookup": curated,
    "json_roundtrip": json_rows,
    "measurement_rows": measured,
    "handoff_documents": documents_of,
    "locator_manifest": located,
}

_A = Q.ASSETS_SQL + """, w AS (SELECT *, CASE walk_pos % 4 WHEN 0 THEN 'cleared' WHEN 2 THEN 'restricted' ELSE 'unknown' END AS rights, CASE WHEN walk_pos % 3 = 0 THEN 'kept' ELSE 'unknown' END AS triage, CASE WHEN walk_pos % 5 = 0 THEN 'published' ELSE 'unknown' END AS pub,
  CASE WHEN extension = '' THEN '[none]' ELSE extension END AS ext, walk_pos % 19 = 0 AS copy FROM assets)
"""
_R = _A + """, r AS (SELECT *, list_filter([CASE WHEN NOT can_convert THEN 'convert' END, CASE WHEN NOT can_view THEN 'measure' END, CASE WHEN walk_pos % 7 <> 0 THEN 'publish' END, 'teleport'], lambda x: x IS NOT NULL) AS blocked FROM w WHERE walk_pos % 9 <> 4 ORDER BY walk_pos, relative_path LIMIT 10000)
"""


def _counters(table: str, **counters: str) -> str:
    return " UNION ALL ".join(f"SELECT 'counter' AS kind, '{k}' AS name, CAST({c} AS BIGINT) AS n FROM {table}" for k, c in counters.items())


def _tallies(table: str, **columns: str) -> str:
    return "".join(f" UNION ALL SELECT '{k}', {c}, count(*) FROM {table} GROUP BY 2" for k, c in columns.items())


def _lists(table: str, **columns: str) -> str:
    return "".join(f" UNION ALL SELECT '{k}', v, count(*) FROM (SELECT unnest({c}) AS v FROM {table}) GROUP BY 2" for k, c in columns.items())


_READY = {"metadata_ready_count": "count(*) FILTER (WHERE ready)", "conversion_ready_count": "count(*) FILTER (WHERE conversion_ready)", "project_ready_count": "count(*) FILTER (WHERE project_ready)"}
_FIRST = {"selected_asset_count": "count(*)", "selected_bytes_total": "sum(size_bytes)", "checksum_record_count": "count(digest)"}

_PROJECT = """WITH t AS (SELECT doc_id AS k, n_chars AS n, source AS p, lang AS slug FROM documents),
v AS (SELECT k, p, slug, 'a' || (CASE WHEN k % 20 = 0 THEN k // 100 ELSE k END) AS path, n % 50 AS z, 'f' || k AS print FROM t WHERE k % 2 = 0),
shape AS (SELECT p, slug, path, min(z) AS z, 40 AS y, 30 AS x FROM v GROUP BY ALL),
place AS (SELECT t.*, 'a' || (CASE WHEN k % 7 = 0 THEN -5 ELSE k - k % 2 END) AS path FROM t),
j AS (SELECT place.*, shape.z, shape.y, shape.x, n % 60 AS cut, k % 9 <> 0 AS on_z FROM place LEFT JOIN shape USING (p, slug, path)),
prj AS (SELECT p, CAST(regexp_extract(p, '(\\d+)', 1) AS INT) AS i, count(*) AS n, min(k) AS k FROM v GROUP BY p),
act AS (SELECT prj.*, v.slug, v.path FROM prj JOIN v USING (p, k)),
fp AS (SELECT act.*, (SELECT min(print) FROM v WHERE v.p = act.p AND v.slug = act.slug AND v.path = act.path) AS active, 'f' || k AS given FROM act),
x AS (
  SELECT p, 'volume' AS item, k::VARCHAR AS id, unnest(list_filter([CASE WHEN k % 30 = 0 THEN 'entry_id_missing' END, CASE WHEN z < 1 THEN 'z_invalid' END, CASE WHEN k % 22 = 0 THEN 'source_size_bytes_invalid' END], lambda c: c IS NOT NULL)) AS violation FROM v
  UNION ALL SELECT p, 'volume', min(k)::VARCHAR, 'duplicate_volume' FROM v GROUP BY p, slug, path HAVING count(*) > 1
  UNION ALL SELECT p, 'note', CASE WHEN k % 3 = 0 THEN '' ELSE 'n' || k END, unnest(list_filter([CASE WHEN k % 3 = 0 THEN 'id_missing' END, CASE WHEN k % 4 = 0 THEN 'scope_unknown' END, CASE WHEN k % 5 = 0 THEN 'updated_at_invalid' END], lambda c: c IS NOT NULL)) FROM t
  UNION ALL SELECT p, 'measurement', k::VARCHAR, unnest(list_filter([CASE WHEN k % 6 = 0 THEN 'label_missing' END, CASE WHEN z IS NULL THEN 'unknown_volume' END, CASE WHEN NOT on_z THEN 'axis_unknown' END, CASE WHEN on_z AND cut > z - 1 THEN 'slice_out_of_bounds' END,
      CASE WHEN n % 31 > x - 1 THEN 'start_x_out_of_bounds' END, CASE WHEN n % 40 > y - 1 THEN 'start_y_out_of_bounds' END, CASE WHEN n % 20 > z - 1 THEN 'start_z_out_of_bounds' END,
      CASE WHEN z IS NOT NULL AND k % 4 = 0 THEN 'end_x_out_of_bounds' END, CASE WHEN z IS NOT NULL AND k % 4 = 0 THEN 'end_y_out_of_bounds' END, CASE WHEN k % 4 = 0 AND z IS NOT NULL OR z < 1 THEN 'end_z_out_of_bounds' END,
      CASE WHEN k % 5 = 0 THEN 'distance_um_invalid' END, CASE WHEN k % 8 = 0 THEN 'created_at_invalid' END], lambda c: c IS NOT NULL)) FROM j
  UNION ALL SELECT p, 'roi', k::VARCHAR, unnest(list_filter([CASE WHEN k % 6 = 1 THEN 'category_missing' END, CASE WHEN z IS NULL THEN 'unknown_volume' END, CASE WHEN k % 5 = 0 THEN 'kind_unknown' END, CASE WHEN NOT on_z THEN 'axis_unknown' END, CASE WHEN on_z AND cut > z - 1 THEN 'slice_out_of_bounds' END,
      CASE WHEN n % 29 > x - 1 THEN 'start_x_out_of_bounds' END, CASE WHEN n % 41 > y - 1 THEN 'start_y_out_of_bounds' END, CASE WHEN 0 > z - 1 THEN 'start_z_out_of_bounds' END,
      CASE WHEN z IS NOT NULL AND k % 4 = 0 AND k % 5 <> 0 AND k % 2 = 0 THEN 'end_x_out_of_bounds' WHEN k % 4 <> 0 AND n % 31 > x - 1 THEN 'end_x_out_of_bounds' END,
      CASE WHEN z IS NOT NULL AND k % 4 = 0 AND k % 5 <> 0 AND k % 2 = 0 THEN 'end_y_out_of_bounds' END, CASE WHEN z IS NOT NULL AND k % 4 = 0 AND k % 5 <> 0 AND k % 2 = 0 THEN 'end_z_out_of_bounds' WHEN k % 4 <> 0 AND 0 > z - 1 THEN 'end_z_out_of_bounds' END,
      CASE WHEN k % 8 = 0 THEN 'created_at_invalid' END], lambda c: c IS NOT NULL)) FROM j
  UNION ALL SELECT p, 'job', k::VARCHAR, unnest(list_filter([CASE WHEN k % 6 = 0 THEN 'summary_missing' END, CASE WHEN z IS NULL THEN 'unknown_volume' END, CASE WHEN k % 4 = 0 THEN 'kind_unknown' END, CASE WHEN k % 3 = 0 THEN 'status_not_completed' END], lambda c: c IS NOT NULL)) FROM j
  UNION ALL SELECT p, 'project', p, unnest(list_filter([CASE WHEN i % 5 = 0 THEN 'name_missing' END, CASE WHEN i % 4 = 0 THEN 'updated_at_invalid' END, CASE WHEN i % 3 = 0 THEN 'active_volume_unknown' END, CASE WHEN i % 3 <> 0 AND (i % 2 = 0 OR active <> given) THEN 'active_fingerprint_differs' END,
      CASE WHEN i % 6 = 0 THEN 'volume_count_differs' END, CASE WHEN i % 7 = 0 THEN 'fingerprint_unknown' END, CASE WHEN i % 7 = 0 THEN 'fingerprint_unlisted' END], lambda c: c IS NOT NULL)) FROM fp)
SELECT p AS project_id, item, violation, count(*) AS n, min(id) AS first_id FROM x GROUP BY ALL"""

ORACLES = {
    "trakem2_scales": """WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1000.0 END::DOUBLE AS u, n_chars AS w, CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE 7 END AS h, CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN doc_id % 7 = 0 THEN 0.5 ELSE 12.0 END END::DOUBLE AS th,
  doc_id % 11 <> 0 AND doc_id % 3 <> 2 AS ok FROM documents), m AS (SELECT *, coalesce(th > 1, false) AND abs(h - w) <= 0.05 * greatest(h, w) AS layers FROM t)
SELECT doc_id, CASE WHEN ok THEN w * u END AS x, CASE WHEN ok THEN CASE WHEN layers THEN h * u * th ELSE h * u END END AS z, CASE WHEN ok THEN h * u END AS raw_z, CASE WHEN ok THEN th END AS layer_thickness,
CASE WHEN ok THEN CASE WHEN layers THEN 'trakem2_calibration_times_layer_thickness' ELSE 'trakem2_calibration' END END AS z_source, CASE WHEN ok THEN CASE doc_id % 3 WHEN 0 THEN 'nm' ELSE 'micron' END END AS unit FROM m""",
    "curated_lookup": """WITH c AS (SELECT p_partkey AS pos, 'see empiar-' || p_partkey || ' and XEMPIAR' || (p_partkey + 7) || '.' AS text FROM part)
SELECT s_suppkey, min(pos) AS pos, arg_min(text, pos) AS text FROM supplier LEFT JOIN c ON contains(upper(text), 'EMPIAR-' || (s_suppkey * 3)) OR contains(upper(text), 'EMPIAR' || (s_suppkey * 3)) GROUP BY s_suppkey""",
    "json_roundtrip": """SELECT event_id, event_type, CASE WHEN event_id % 3 <> 0 THEN value END AS value, event_type || ',a "b" é' AS words FROM events""",
    "measurement_rows": "SELECT 'M' || l_orderkey || '.' || l_linenumber AS label, l_linenumber + 1 AS x1, l_linenumber + 2 AS y1, 1 AS z1, l_linenumber * 2 + 1 AS x2, 6 AS y2, l_linenumber + 1 AS z2, printf('%.6f', l_extendedprice / 7) AS distance_um FROM lineitem",
    "handoff_documents": f"""WITH {B.CATALOG_SQL} SELECT dataset_id, '{{"schema":"catalog-handoff","schema_version":1,"dataset_id":"' || dataset_id || '","title":"' || title || '","year":' || year || ',"organelles":[' || coalesce(array_to_string(list_transform(organelles, lambda x: '"' || x || '"'), ','), '') || ']}}' AS document FROM catalog""",
    "locator_manifest": """SELECT 'study-' || o_custkey || '-' || printf('%03d', o_orderkey) AS dataset_locator_id, 'Study #' || o_custkey AS study_id, CASE WHEN o_custkey % 3 <> 0 AND o_custkey % 2 = 0 THEN 'borderline' ELSE 'included' END AS included_status, o_orderpriority AS cell_type,
CASE WHEN o_custkey % 3 <> 0 THEN c_mktsegment ELSE '' END AS journal_published, CASE WHEN o_custkey % 5 = 0 THEN 'https://zenodo.org/record/1' ELSE '' END AS public_locator_urls, CASE WHEN o_custkey % 5 = 0 THEN 'Zenodo' ELSE '' END AS public_repository_types FROM orders JOIN customer ON c_custkey = o_custkey""",
    "workset_promotion": _R + "SELECT asset_id, array_to_string(blocked, ',') AS blocked_operations, len(blocked) = 0 AS can_enter FROM r",
    "workset_summary": _R + _counters("r", **_FIRST, **_READY, dataset_mode_ready_count="count(*) FILTER (WHERE len(blocked) = 0)") + _tallies("r", rights_status="rights", triage_status="triage", publication_status="pub", format="format") + _lists("r", blocker="blockers", blocked_operation="blocked"),
    "workset_findings": _R + """, c AS (SELECT count(*) AS n, count(digest) AS s, count(*) FILTER (WHERE rights = 'unknown') AS u, sum(len(blocked)) AS b FROM r)
SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INT) AS place, severity, code, summary FROM (
  SELECT 1 AS o, 'review' AS severity, 'missing_fixity' AS code, (n - s) || ' selected assets lack checksum records.' AS summary FROM c WHERE s < n
  UNION ALL SELECT 2, 'blocker', 'rights_unknown', u || ' selected assets still have unknown rights status.' FROM c WHERE u > 0
  UNION ALL SELECT 3, 'blocker', 'intended_operations_blocked', CAST(b AS BIGINT) || ' requested asset operations are blocked for convert, measure, publish, review, teleport.' FROM c WHERE b > 0)""",
    "workset_review_queue": _R + "SELECT asset_id FROM r WHERE len(blocked) > 0 OR len(blockers) > 0 OR rights = 'unknown'",
    "pilot_summary": _A + _counters("w", **_FIRST, volume_candidate_count="count(*) FILTER (WHERE is_candidate)", duplicate_asset_count="count(*) FILTER (WHERE copy)", **_READY, review_required_count="count(*) FILTER (WHERE walk_pos % 8 = 3)")
    + _tallies("w", role="role", format="format", extension="ext", rights_status="rights", publication_status="pub", triage_status="triage") + _lists("w", blocker="blockers", metadata_gap="gaps")
    + " UNION ALL SELECT * FROM (SELECT 'action', a, count(*) AS n FROM (SELECT CASE WHEN len(gaps) > 0 THEN 'Fill gaps' END AS a FROM w UNION ALL SELECT CASE WHEN walk_pos % 2 = 0 THEN 'Check rights' END FROM w UNION ALL SELECT 'Step ' || (walk_pos % 20) FROM w) WHERE a IS NOT NULL GROUP BY a ORDER BY n DESC, a LIMIT 12)",
    "pilot_findings": _A + """, c AS (SELECT count(*) AS n, count(digest) AS s, count(*) FILTER (WHERE rights = 'unknown') AS u, sum(len(gaps)) AS g, count(*) FILTER (WHERE project_ready) AS p, count(*) FILTER (WHERE copy) AS d FROM w)
SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INT) AS place, severity, code, summary FROM (
  SELECT 1 AS o, 'blocker' AS severity, 'rights_unknown' AS code, u || ' selected assets still have unknown rights status.' AS summary FROM c WHERE u > 0
  UNION ALL SELECT 2, 'review', 'missing_fixity', (n - s) || ' selected assets do not have direct checksum records.' FROM c WHERE s < n
  UNION ALL SELECT 3, 'review', 'metadata_gaps', CAST(g AS BIGINT) || ' metadata gaps remain across the selected pilot subset.' FROM c WHERE g > 0
  UNION ALL SELECT 4, 'blocker', 'no_project_ready_assets', 'No selected assets are currently project-ready.' FROM c WHERE p = 0
  UNION ALL SELECT 5, 'review', 'duplicate_checksums', d || ' selected assets duplicate another checksum.' FROM c WHERE d > 0)""",
    "pilot_next_steps": _A + """, c AS (SELECT count(*) AS n, count(digest) AS s, sum(len(gaps)) AS g, count(*) FILTER (WHERE project_ready) AS p FROM w)
SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INT) AS place, step FROM (
  SELECT 1 AS o, 'Confirm data owner, allowed operations, publication/triage status, and reviewer for this pilot subset.' AS step FROM c
  UNION ALL SELECT 2, 'Run or resume SHA-256 fixity for selected assets that lack direct checksum records.' FROM c WHERE s < n
  UNION ALL SELECT 3, 'Resolve metadata gaps before conversion or measurement, starting with blocker-severity gaps.' FROM c WHERE g > 0
  UNION ALL SELECT 4, CASE WHEN p = 0 THEN 'Curate rights/status and select at least one asset that can be converted and viewed.' ELSE 'Open the project-ready assets and create a local project package.' END FROM c
  UNION ALL SELECT 5, 'Write one candidate scientific question and the minimum measurement/ROI/job evidence needed.' FROM c)""",
    "asset_state_manifest": U.ASSETS_SQL + """SELECT relative_path || doc_id AS relative_path, CASE WHEN doc_id % 3 <> 0 THEN 'https://example.org/' || doc_id ELSE '' END AS url, relative_path || doc_id AS repository_path, '/pilot/data/' || relative_path || doc_id AS local_path, size_bytes, state AS volume_state,
CASE WHEN shown THEN 'p/' || doc_id ELSE '' END AS preview_path, CASE WHEN doc_id % 2 = 0 THEN 2.5::DOUBLE END AS header_voxel_size_nm, 'not_started' AS derivative_state FROM assets""",
    "project_rules": _PROJECT,
    "label_derivatives": """SELECT source || '/' || doc_id || '#segmentation=s1' AS source_relative_path, 'data/' || source || '/' || doc_id AS source_path, 'data/' || source || '/' || doc_id || '.segmentations/' || CASE WHEN doc_id % 5 = 1 THEN 'a..b/l' ELSE 'l' END AS output_path
FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0 AND doc_id % 19 <> 0 AND doc_id % 4 <> 0 AND doc_id % 5 <> 0 AND n_chars % 3 = doc_id % 3""",
    "path_and_scale_texts": """SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN n_chars + 0.5 WHEN 3 THEN NULL ELSE n_chars END::DOUBLE AS x, CASE doc_id % 4 WHEN 1 THEN 4 WHEN 3 THEN NULL ELSE n_chars END::DOUBLE AS y, CASE doc_id % 4 WHEN 1 THEN 3 WHEN 3 THEN NULL ELSE n_chars END::DOUBLE AS z,
'0o' || coalesce(nullif(ltrim(concat(doc_id % 4096 // 512, doc_id % 512 // 64, doc_id % 64 // 8, doc_id % 8), '0'), ''), '0') AS mode, strftime(make_timestamp((1700000000 + doc_id * 1000) * 1000000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN doc_id % 2 = 0 THEN '.250000' ELSE '' END || 'Z' AS modified_at FROM documents""",
}

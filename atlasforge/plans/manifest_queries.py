"""Manifest and scan-rule queries over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import manifests as M
from ..sources import bindings as B


def roles(s, d):
    i = B.inventory(s, d)
    path = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("x/Masks/"), "relative_path")).otherwise(F.col("relative_path"))
    return i.select("doc_id", M.likely_role(path, F.col("doc_id") % 33 == 0).alias("role"))


def scales(s, d):
    k = F.col("doc_id")
    scale = lambda cond, v: F.when(cond, F.struct(F.lit(v).alias("x"), F.lit(v).alias("y"), F.lit(v * 2).alias("z")))
    chosen = M.scale_precedence({"asset": scale(k % 7 == 0, 1.0), "citation": scale(k % 3 == 0, 2.0), "curated": scale(k % 2 == 0, 3.0), "tiff": scale(k % 5 == 0, 4.0)})
    return B.table(s, d, "documents").select("doc_id", chosen.alias("c")).select("doc_id", "c.x", "c.z", "c.source")


def public_assets(s, d):
    p = B.table(s, d, "part").select(F.concat(F.lit("Study "), "p_partkey").alias("study_id"), F.concat(F.lit("see https://zenodo.org/record/"), "p_partkey", F.lit(").")).alias("link"), F.concat(F.lit("10.6019/EMPIAR-"), "p_partkey").alias("notes"), F.concat("p_size", F.lit(" GB")).alias("size"), F.lit("2").alias("files"), F.lit("included").alias("status"))
    return M.public_manifest(p)


def _validated(s, d):
    """Documents as files of their sources, with one entry that has none."""
    k, n = F.col("doc_id"), F.col("n_chars")
    f = B.table(s, d, "documents").select(
        F.col("source").alias("entry_id"), k.alias("pos"), F.concat("source", F.lit("/"), k.cast("string")).alias("relative_path"), F.when(k % 5 == 4, "CSV").when(k % 2 == 0, "MRC").otherwise("TIFF").alias("format"), n.alias("size_bytes"),
        F.when(k % 3 == 0, "MAP ").alias("map_marker"), (n % 3).alias("nx"), F.lit(1).cast("bigint").alias("mx"), F.lit("1").alias("cell_x"), F.when(k % 5 == 0, "bad").alias("tiff_error"), F.when(n % 2 == 0, 1.0).alias("scale_nm"),
        F.when(k % 11 != 0, F.concat(F.lit("set-"), F.floor(k / 40).cast("string"))).alias("api_name"), F.when(k % 7 != 0, n % 3).alias("depth"), F.lit(2).cast("bigint").alias("expected"), F.when(k % 4 != 0, n + F.when(k % 12 == 1, 1).otherwise(0)).alias("expected_size"),
        F.when(k % 3 == 0, "").otherwise("aa").alias("computed_md5"), F.when(k % 6 == 0, "bb").alias("supplied_md5"), F.when(k % 2 == 0, "aa").alias("local_md5"), F.when(k % 9 == 0, n % 400).alias("trakem2_z_nm"),
    )
    p = f.select("entry_id", "pos", "relative_path", F.col("format").alias("kind"), F.when(F.col("pos") % 13 == 0, "dim").otherwise("").alias("warning"), F.when(F.col("pos") % 4 == 0, "p.png").alias("preview"))
    e = f.select("entry_id").distinct().withColumn("dataset_size", F.lit("1 GB")).unionByName(s.range(1).select(F.lit("empty").alias("entry_id"), F.lit("2 TB").alias("dataset_size")))
    return f, p, e


def validation(s, d):
    f, p, e = _validated(s, d)
    a, b = (M.validation_warnings(f, p, e, x).withColumn("source", F.lit(x)) for x in ("empiar", "figshare"))
    return a.unionByName(b)


def totals(s, d):
    return M.validation_totals(*_validated(s, d)).withColumn("formats", F.array_join("formats", ","))


def preflights(s, d):
    k = F.col("c_custkey")
    c = B.table(s, d, "customer").select(k.alias("scan_id"), (k % 11 != 0).alias("root_exists"), (k % 7 != 0).alias("root_is_folder"), (k % 5 != 0).alias("root_readable"), (k % 13 == 0).alias("output_inside"), (k % 17 != 0).alias("output_writable"), (k % 4 * 1024**3).alias("free_bytes"), (k % 2 == 0).alias("same_device"), (k % 3 == 0).alias("checksums"), (k % 19 != 0).alias("same_identity"), (k % 6).alias("known_checksums"))
    return M.preflight(c).select("scan_id", F.array_join("blockers", ",").alias("blockers"), F.array_join("warnings", ",").alias("warnings"), "may_run")


QUERIES = {
    "likely_role": roles,
    "scale_precedence": scales,
    "public_manifest": public_assets,
    "validation_report": validation,
    "validation_totals": totals,
    "scan_preflight": preflights,
    "roi_centers": lambda s, d: B.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", M.roi_center(F.col("l_linenumber"), F.col("l_quantity").cast("bigint"), F.lit(20)).alias("center"), M.scale_bar(F.col("l_extendedprice")).alias("step"), F.round(M.log_axis(F.col("l_discount")), 6).alias("log_discount")),
    "path_hashes": lambda s, d: B.table(s, d, "nation").select("n_nationkey", M.fnv1a(F.concat("n_name", F.lit("é/"))).alias("hash")),
}

_STEPS = ", ".join(str(x) for x in M.SCALE_STEPS)

_FILES = "WITH f AS (SELECT source AS e, doc_id AS k, n_chars AS n, source || '/' || doc_id AS p, CASE WHEN doc_id % 5 = 4 THEN 'CSV' WHEN doc_id % 2 = 0 THEN 'MRC' ELSE 'TIFF' END AS fmt FROM documents)\n"

ORACLES = {
    "likely_role": f"""WITH {B.INVENTORY_SQL} SELECT doc_id, CASE WHEN doc_id % 33 = 0 THEN 'symlink' WHEN doc_id % 10 = 0 THEN 'derived_or_analysis_output' WHEN doc_id % 7 IN (0, 1, 2) THEN 'raw_volume_candidate' WHEN doc_id % 7 = 3 THEN 'metadata_sidecar' WHEN doc_id % 7 = 4 THEN 'tabular_metadata_or_measurements' WHEN doc_id % 7 = 5 THEN 'unknown' ELSE 'no_extension' END AS role FROM inventory""",
    "scale_precedence": """WITH c AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1.0 WHEN doc_id % 3 = 0 THEN 2.0 WHEN doc_id % 2 = 0 THEN 3.0 WHEN doc_id % 5 = 0 THEN 4.0 END::DOUBLE AS x, CASE WHEN doc_id % 7 = 0 THEN 'asset' WHEN doc_id % 3 = 0 THEN 'citation' WHEN doc_id % 2 = 0 THEN 'curated' WHEN doc_id % 5 = 0 THEN 'tiff' END AS source FROM documents) SELECT doc_id, x, 2 * x AS z, source FROM c""",
    "public_manifest": """SELECT 'Study ' || p_partkey AS study_id, 'study-' || p_partkey AS study_slug, 'included' AS included_status, 'https://zenodo.org/record/' || p_partkey || '; https://www.ebi.ac.uk/empiar/EMPIAR-' || p_partkey || '/' AS public_locator_urls, 'Zenodo; EMPIAR' AS repository_types,
p_size || ' GB' AS total_size_raw, CAST(p_size AS BIGINT) * 1000000000 AS total_size_bytes_min, CAST(p_size AS BIGINT) * 1000000000 AS total_size_bytes_max, '' AS size_parse_note FROM part""",
    "validation_report": _FILES + """, said AS (
  SELECT 'empiar' AS source, e AS entry_id, 1 AS section, k AS pos, list_filter([CASE WHEN fmt = 'MRC' AND k % 3 <> 0 THEN 'MRC MAP marker missing or unexpected.' END, CASE WHEN fmt = 'MRC' AND n % 3 = 1 THEN 'MRC cell dimensions mirror voxel counts; header physical scale is likely default, not authoritative.' END,
      CASE WHEN k % 5 = 0 THEN 'TIFF parse warning: bad' END, CASE WHEN fmt <> 'CSV' AND n % 2 <> 0 THEN 'no physical voxel size found in curated text, API metadata, TIFF metadata, or MRC header.' END], lambda x: x IS NOT NULL) AS w, p FROM f
  UNION ALL SELECT 'figshare', e, 1, k, list_filter([CASE WHEN k % 4 <> 0 AND k % 12 = 1 THEN 'Figshare expected ' || (n + 1) || ' bytes but local file has ' || n || ' bytes.' END, CASE WHEN k % 6 = 0 THEN 'Figshare MD5 mismatch.' END, CASE WHEN k % 5 = 0 THEN 'TIFF parse warning: bad' END,
      CASE WHEN k % 9 = 0 AND n % 400 <> 0 AND (n % 400 < 30 OR n % 400 > 250) THEN 'trakem2_z_spacing_suspicious:' || (n % 400) || 'nm' END, CASE WHEN fmt <> 'CSV' AND n % 2 <> 0 THEN 'no physical voxel size found in Figshare, TIFF, or paired TrakEM2 metadata.' END], lambda x: x IS NOT NULL), p FROM f),
sets AS (SELECT e, 'set-' || (k // 40) AS name, min(k) AS pos, arg_min(p, k) AS p, count(*) AS files, sum(CASE WHEN k % 7 <> 0 THEN n % 3 END) AS total, count(*) FILTER (WHERE k % 7 <> 0) AS known FROM f WHERE k % 11 <> 0 GROUP BY ALL)
SELECT source, entry_id, section, pos, CAST(i - 1 AS INT) AS rank, p || ': ' || w[i] AS warning FROM said, unnest(range(1, len(w) + 1)) AS t(i)
UNION ALL SELECT 'empiar', e, 2, pos, 0, CASE WHEN files > 1 THEN name || ': API reports 2 images for an imageset spanning ' || files || ' local files with ' || total || ' total slices; treat API count as collection-level metadata.' ELSE p || ': API reports 2 images but local file has ' || total || ' slices.' END FROM sets WHERE known > 0 AND total <> 2
UNION ALL SELECT source, e, 3, k, 0, p || ': preview warning: dim' FROM f, (SELECT unnest(['empiar', 'figshare']) AS source) WHERE k % 13 = 0 AND fmt <> 'CSV'
UNION ALL SELECT 'empiar', 'empty', 0, 0, 0, 'No local data files found.' UNION ALL SELECT 'empiar', 'empty', 0, 0, 1, 'Entry reports dataset_size=2 TB but no local bytes were inventoried.' UNION ALL SELECT 'figshare', 'empty', 0, 0, 0, 'No local data files found.'""",
    "validation_totals": _FILES + """SELECT e AS entry_id, count(*) AS file_count, array_to_string(list_sort(list(DISTINCT fmt)), ',') AS formats, CAST(sum(n) AS BIGINT) AS total_bytes, round(sum(n) / 1073741824.0, 3) AS total_gib, count(*) FILTER (WHERE k % 4 = 0) AS preview_count FROM f GROUP BY e
UNION ALL SELECT 'empty', 0, '', 0, 0, 0""",
    "scan_preflight": """WITH c AS (SELECT c_custkey AS k FROM customer), b AS (SELECT k, list_filter([CASE WHEN k % 11 = 0 THEN 'root_missing' WHEN k % 7 = 0 THEN 'root_not_a_folder' WHEN k % 5 = 0 THEN 'root_unreadable' END, CASE WHEN k % 13 = 0 THEN 'output_inside_root' END, CASE WHEN k % 17 = 0 THEN 'output_not_writable' END, CASE WHEN k % 4 = 0 THEN 'less_than_1_gib_free' END, CASE WHEN k % 19 = 0 THEN 'state_of_another_scan' END], lambda x: x IS NOT NULL) AS b,
list_filter([CASE WHEN k % 6 = 0 THEN 'shared_device' END, CASE WHEN k % 6 = 0 THEN 'no_prior_checksums' END], lambda x: x IS NOT NULL) AS w FROM c) SELECT k AS scan_id, array_to_string(b, ',') AS blockers, array_to_string(w, ',') AS warnings, len(b) = 0 AS may_run FROM b""",
    "roi_centers": f"""SELECT l_orderkey, l_linenumber, CAST(greatest(0, least(floor((l_linenumber + CAST(l_quantity AS BIGINT)) / 2 + 0.5), 19)) AS BIGINT) AS center, (SELECT s FROM (SELECT unnest([{_STEPS}]) AS s) ORDER BY abs(ln(l_extendedprice / s)), s LIMIT 1) AS step, CASE WHEN l_discount > 0 THEN round(log10(l_discount), 6) END AS log_discount FROM lineitem""",
    "path_hashes": """WITH RECURSIVE n AS (SELECT n_nationkey, encode(n_name || 'é/') AS b FROM nation), w AS (SELECT n_nationkey, 0 AS i, 14695981039346656037::UHUGEINT AS h FROM n UNION ALL
SELECT w.n_nationkey, i + 1, xor(h, ('0x' || hex(b[i + 1 : i + 1]))::INT::UHUGEINT) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT FROM w JOIN n USING (n_nationkey) WHERE i < octet_length(b))
SELECT w.n_nationkey, lpad(lower(hex(h::UBIGINT)), 16, '0') AS hash FROM w JOIN n USING (n_nationkey) WHERE i = octet_length(b)""",
}

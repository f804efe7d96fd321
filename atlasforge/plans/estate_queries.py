"""Archive, matching, job and volume queries over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import estate as E
from ..operators import filters, jobs, matching, search
from ..operators import volume as V
from ..scratch import scratch_path, written
from ..sinks import writers
from ..sources import bindings as B

# ---------------------------------------------------------------- bindings


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory files with synthetic metadata, gaps, states and readiness."""
    i = B.inventory(spark, sf_dir)
    k, n = F.col("doc_id"), F.col("size_bytes")
    ext = N.extension(F.col("relative_path"))
    rows = i.select(
        F.concat(F.lit("asset-"), k.cast("string")).alias("asset_id"),
        "relative_path",
        "walk_pos",
        "size_bytes",
        ext.alias("extension"),
        F.when(ext.isin(".tif", ".mrc", ".ome.tif", ".zarray"), "raw_volume_candidate").when(ext.isin(".json"), "sidecar").otherwise("table").alias("role"),
        F.when(k % 9 != 0, F.col("digest")).alias("digest"),
        F.when(k % 5 == 0, None).when(k % 5 == 1, "error").when(k % 5 == 2, "detected").otherwise("readable").alias("metadata_status"),
        F.when(k % 3 == 0, "HDF5").otherwise("TIFF").alias("format"),
        F.when(n % 4 != 0, n).alias("x"),
        F.when(n % 4 != 0, n + 1).alias("y"),
        F.when(n % 3 != 0, F.lit(10)).alias("z"),
        F.when(n % 7 != 0, "uint8").alias("dtype"),
        F.when(n % 2 == 0, F.lit(5.0)).alias("voxel_nm"),
        F.lit("unknown").alias("rights_status"),
        (k % 4 == 0).alias("can_view"),
        (k % 6 == 0).alias("can_convert"),
    )
    rows = rows.withColumn("is_candidate", F.col("role") == "raw_volume_candidate").withColumn("gaps", E.gaps()).withColumn("states", E.blocked_states())
    rows = rows.withColumn("states", F.when(F.col("can_view"), F.array_remove("states", "blocked_permission")).otherwise(F.col("states")))
    rows = rows.withColumn("review_required", F.col("walk_pos") % 8 == 3).withColumn("duplicate_of", F.when(F.col("walk_pos") % 19 == 0, F.lit("first/copy.tif")))
    rows = rows.withColumn("notes", F.array(F.lit("scanner_seeded_status"))).withColumn("search_text", F.lower(F.concat_ws(" ", "asset_id", "relative_path", "format")))
    return E.readiness(rows)


ASSETS_SQL = f"""WITH {B.INVENTORY_SQL},
a0 AS (
  SELECT 'asset-' || doc_id AS asset_id, doc_id, relative_path, walk_pos, size_bytes, (['.tif', '.ome.tif', '.mrc', '.json', '.csv', '.zarray', ''])[CAST(doc_id % 7 AS INT) + 1] AS extension,
         CASE WHEN doc_id % 7 IN (0, 1, 2, 5) THEN 'raw_volume_candidate' WHEN doc_id % 7 = 3 THEN 'sidecar' ELSE 'table' END AS role, CASE WHEN doc_id % 9 <> 0 THEN digest END AS digest,
         CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'error' WHEN 2 THEN 'detected' ELSE 'readable' END AS ms, CASE WHEN doc_id % 3 = 0 THEN 'HDF5' ELSE 'TIFF' END AS format,
         size_bytes % 4 = 0 OR size_bytes = 0 AS no_xy, size_bytes % 3 = 0 AS no_z, size_bytes % 7 = 0 AS no_dtype, size_bytes % 2 <> 0 AS no_voxel, doc_id % 4 = 0 AS can_view, doc_id % 6 = 0 AS can_convert
  FROM inventory),
a1 AS (
  SELECT *, role = 'raw_volume_candidate' AS is_candidate,
    CASE WHEN role <> 'raw_volume_candidate' THEN CAST([] AS VARCHAR[]) WHEN ms IS NULL THEN ['no_metadata_extractor']
    ELSE list_filter([CASE WHEN ms = 'detected' AND format = 'HDF5' THEN 'hdf5_internal_metadata_pending' WHEN ms <> 'readable' THEN 'metadata_status_' || ms END,
      CASE WHEN no_xy THEN 'missing_dimensions' END, CASE WHEN no_z THEN 'missing_z_dimension' END, CASE WHEN no_dtype THEN 'missing_dtype' END, CASE WHEN no_voxel THEN 'missing_voxel_size' END], lambda x: x IS NOT NULL) END AS gaps,
    coalesce(ms = 'readable', false) AND NOT no_xy AND NOT no_z AND NOT no_dtype AND NOT no_voxel AS ready
  FROM a0),
a2 AS (
  SELECT *, list_sort(list_filter([CASE WHEN list_has_any(gaps, ['missing_dimensions', 'missing_dtype', 'no_metadata_extractor']) THEN 'blocked_missing_metadata' END, CASE WHEN NOT can_view THEN 'blocked_permission' END,
      CASE WHEN list_has_any(gaps, ['metadata_status_error', 'metadata_status_unreadable']) THEN 'blocked_unreadable' END, CASE WHEN list_contains(gaps, 'missing_voxel_size') THEN 'blocked_unknown_voxel_size' END], lambda x: x IS NOT NULL)) AS states
  FROM a1),
a3 AS (
  SELECT *, list_sort(list_distinct(list_concat(states, gaps, list_filter([CASE WHEN digest IS NULL THEN 'missing_checksum' END, CASE WHEN is_candidate AND NOT ready THEN 'blocked_missing_metadata' END,
      CASE WHEN NOT can_view THEN 'blocked_permission' END], lambda x: x IS NOT NULL)))) AS blockers FROM a2),
assets AS (SELECT *, can_view AND digest IS NOT NULL AND ready AND len(blockers) = 0 AS project_ready, can_convert AND digest IS NOT NULL AND ready AND len(blockers) = 0 AS conversion_ready FROM a3)
"""


def _sides(s, d):
    i = B.inventory(s, d)
    only = lambda side, n: F.when(F.col("doc_id") % n == 0, F.concat(F.lit(f"{side}-only/"), "relative_path")).otherwise(F.col("relative_path"))
    source = i.withColumn("relative_path", only("source", 7))
    target = i.withColumn("relative_path", only("target", 11)).withColumn("size_bytes", F.when(F.col("doc_id") % 13 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes"))).withColumn("digest", F.when(F.col("doc_id") % 17 != 0, F.col("digest")))
    return source, target


_SIDES_SQL = f"""WITH {B.INVENTORY_SQL}, s AS (SELECT * REPLACE (CASE WHEN doc_id % 7 = 0 THEN 'source-only/' || relative_path ELSE relative_path END AS relative_path) FROM inventory),
t AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'target-only/' || relative_path ELSE relative_path END AS relative_path, CASE WHEN doc_id % 13 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, CASE WHEN doc_id % 17 <> 0 THEN digest END AS digest FROM inventory),
j AS (SELECT coalesce(s.relative_path, t.relative_path) AS relative_path, s.relative_path IS NOT NULL AS in_s, t.relative_path IS NOT NULL AS in_t, s.size_bytes AS s_size, t.size_bytes AS t_size, s.digest AS s_digest, t.digest AS t_digest FROM s FULL JOIN t ON s.relative_path = t.relative_path),
issues AS (SELECT relative_path, unnest(list_filter([CASE WHEN NOT in_s THEN 'unexpected_in_target' END, CASE WHEN NOT in_t THEN 'missing_in_target' END, CASE WHEN in_s AND in_t AND s_size <> t_size THEN 'size_mismatch' END,
  CASE WHEN in_s AND in_t AND s_digest IS NULL THEN 'missing_source_checksum' END, CASE WHEN in_s AND in_t AND t_digest IS NULL THEN 'missing_target_checksum' END, CASE WHEN in_s AND in_t AND s_digest <> t_digest THEN 'checksum_mismatch' END], lambda x: x IS NOT NULL)) AS issue_type, s_size, t_size FROM j)
"""


def copy_issues(s, d):
    return E.copy_verification(*_sides(s, d), require_checksums=True).select("relative_path", "issue_type", "s_size", "t_size")


def copy_summary(s, d):
    source, target = _sides(s, d)
    return E.copy_summary(source, target, E.copy_verification(source, target, require_checksums=True))


def overlay_rows(s, d):
    """Labels as curated rows: half by asset id, half by path; some match nothing."""
    i = B.inventory(s, d).select("doc_id", "relative_path")
    labels = B.table(s, d, "labels").join(i, "doc_id", "left")
    return labels.select(
        F.col("doc_id").alias("pos"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("asset-"), (F.col("doc_id") + F.when(F.col("doc_id") % 10 == 0, 10_000_000).otherwise(0)).cast("string"))).alias("asset_id"),
        F.when(F.col("doc_id") % 2 == 1, F.col("relative_path")).alias("relative_path"),
        F.when(F.col("quality") == 1, "cleared").alias("rights_status"),
        F.when(F.col("toxic") == 1, F.array(F.lit("blocked_rights"))).when(F.col("quality") == 1, F.array().cast("array<string>")).alias("states"),
        F.when(F.col("quality") == 0, F.array(F.lit("curated"))).alias("notes"),
        F.when(F.col("quality") == 1, True).alias("can_view"),
        F.lit(None).cast("boolean").alias("can_convert"),
    )


def overlaid(s, d):
    a = E.readiness(E.overlay(assets(s, d).drop("blockers", "ready", "project_ready", "conversion_ready"), overlay_rows(s, d)))
    return a.select("asset_id", "overlaid", "rights_status", F.array_join("states", ",").alias("states"), F.array_join("notes", ",").alias("notes"), "can_view", "project_ready", F.array_join("blockers", ",").alias("blockers"))


_OVERLAY_SQL = (
    ASSETS_SQL
    + """, o AS (SELECT l.doc_id, CASE WHEN l.doc_id % 2 = 0 THEN 'asset-' || (l.doc_id + CASE WHEN l.doc_id % 10 = 0 THEN 10000000 ELSE 0 END) END AS oid, CASE WHEN l.doc_id % 2 = 1 THEN i.relative_path END AS opath, quality, toxic FROM labels l LEFT JOIN inventory i USING (doc_id)),
m AS (SELECT assets.*, o.doc_id IS NOT NULL AS overlaid, quality, toxic FROM assets LEFT JOIN o ON assets.asset_id = o.oid OR (o.oid IS NULL AND assets.relative_path = o.opath)),
p AS (SELECT asset_id, overlaid, CASE WHEN quality = 1 THEN 'cleared' ELSE 'unknown' END AS rights_status, CASE WHEN toxic = 1 THEN ['blocked_rights'] WHEN quality = 1 THEN CAST([] AS VARCHAR[]) ELSE states END AS st,
  CASE WHEN quality = 0 THEN 'scanner_seeded_status,curated' ELSE 'scanner_seeded_status' END AS notes, can_view OR coalesce(quality = 1, false) AS cv, gaps, digest, ready, is_candidate FROM m),
b AS (SELECT *, list_sort(list_distinct(list_concat(st, gaps, list_filter([CASE WHEN digest IS NULL THEN 'missing_checksum' END, CASE WHEN is_candidate AND NOT ready THEN 'blocked_missing_metadata' END, CASE WHEN NOT cv THEN 'blocked_permission' END], lambda x: x IS NOT NULL)))) AS bl FROM p)
SELECT asset_id, overlaid, rights_status, array_to_string(st, ',') AS states, notes, cv AS can_view, cv AND digest IS NOT NULL AND ready AND len(bl) = 0 AS project_ready, array_to_string(bl, ',') AS blockers FROM b"""
)


def prefixes(s, d):
    path = F.col("relative_path")
    found = B.inventory(s, d).select(F.explode(F.array(F.substring_index(path, "/", 1), F.substring_index(path, "/", 2))).alias("prefix")).distinct()
    return found.unionByName(s.range(1).select(F.lit("nowhere").alias("prefix")))


def scored(s, d):
    """Assets against derivatives: identity, checksum and path suffix."""
    i = B.inventory(s, d)
    left = i.withColumn("name", F.substring_index("relative_path", "/", -1))
    even = F.col("doc_id") % 2 == 0  # the others match nothing
    right = i.select(
        (F.col("doc_id") + 5_000_000).alias("derived_id"), F.when(F.col("doc_id") % 4 == 0, F.col("doc_id")).alias("origin"), F.when(even, F.col("digest")).alias("digest"),
        F.when(even, F.col("relative_path")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".none"))).alias("d_path"),
    )
    arms = [(400, F.col("doc_id").cast("string"), F.col("origin").cast("string")), (300, F.col("digest"), F.col("digest")), (100, F.col("name"), F.substring_index("d_path", "/", -1))]
    return matching.scored_best_match(left, right, "doc_id", "derived_id", arms)


def registry_matches(s, d):
    """Inventory files as registry assets, and one derivative of each that knows some of identity, checksum, local and relative paths."""
    i = B.inventory(s, d)
    k, path = F.col("doc_id"), F.col("relative_path")
    a = i.select(
        F.concat(F.lit("asset-"), k.cast("string")).alias("asset_id"), F.concat(F.lit("reg"), (k % 2).cast("string")).alias("registry_id"), F.when(k % 4 == 0, "file:///data//arch/").when(k % 4 == 1, "\\\\srv\\data").alias("root"),
        F.concat(F.when(k % 3 == 0, "/").otherwise(""), path, F.when(k % 5 == 0, "/").otherwise("")).alias("relative_path"), F.concat(F.lit(" "), F.upper("digest")).alias("digest"), F.when(k % 6 != 0, F.col("size_bytes")).alias("size_bytes"),
        (k % 7 != 0).alias("project_ready"), F.when(k % 11 != 0, True).alias("can_view"),
    )
    d_ = i.select(
        (k + 5_000_000).alias("derivative_id"), F.when(k % 4 == 0, F.concat(F.lit("asset-"), (k - k % 8).cast("string"))).alias("asset_id"), F.when(k % 3 == 0, F.concat(F.lit("reg"), (k % 5 % 2).cast("string"))).alias("registry_id"),
        F.when(k % 3 == 0, F.col("digest")).otherwise("short").alias("source_sha256"), F.when(k % 9 == 0, F.col("size_bytes") + 1).when(k % 9 != 3, F.col("size_bytes")).alias("source_size_bytes"),
        F.when(k % 6 == 1, F.concat(F.lit("file:///data/arch/"), path)).when(k % 6 == 2, F.concat(F.lit("//srv/data//"), path)).alias("source_local_path"), F.when(k % 10 == 4, F.concat(F.lit("/else\\where/"), path)).when(k % 10 == 2, F.concat(F.lit("/data/arch/"), path)).alias("output_path"),
        F.when(k % 11 == 5, F.concat(F.lit("/"), path)).alias("source_relative_path"),
    )
    return matching.registry_match(a, d_)


def handoffs(s, d):
    """Documents as hand-offs, and as loaded datasets whose slugs and entries are written in other ways."""
    t = B.table(s, d, "documents").select("doc_id", "n_chars")
    k = F.col("doc_id")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    h = t.select(
        k.alias("handoff_id"), F.when(k % 5 != 0, text("Set-", k)).alias("dataset_id"), F.when(k % 3 == 0, text("study ", F.floor(k / 4))).otherwise("").alias("source_study_id"),
        F.when(k % 2 == 0, F.array(text("EMPIAR-", k), text("empiar ", k), text("x", k + 1), F.lit(""))).alias("accessions"),
    )
    loaded = t.select(F.when(k % 4 == 0, text("set_", k)).when(k % 4 == 1, text("Study", F.floor(k / 4))).otherwise(text("other", k)).alias("slug"), F.when(k % 4 == 2, text("EMPIAR", k)).when(k % 4 == 3, text("X-", k)).otherwise(text("study", F.floor(k / 8))).alias("entry_id"), (F.col("n_chars") % 3).alias("n_derivatives"))
    return matching.handoff_match(h, loaded)


def imagesets(s, d):
    """Files of an entry, and image sets that name some of them by stem, by end or by folder; one entry has a single set."""
    i, k = B.inventory(s, d), F.col("doc_id")
    rows = i.withColumn("entry_id", F.when(k % 13 == 0, "solo").otherwise(F.substring_index("relative_path", "/", 1)))
    about = i.select(
        F.substring_index("relative_path", "/", 1).alias("entry_id"), k.alias("pos"), F.when(k % 5 == 0, k.cast("string")).when(k % 5 == 1, F.concat(F.lit("/"), k.cast("string"), F.lit(".ome"))).when(k % 5 == 2, (k % 100 + 100).cast("string")).when(k % 5 == 3, "").alias("name"),
        F.when(k % 29 == 7, F.concat(F.lit("/"), F.substring_index("relative_path", "/", 2), F.lit("/"))).alias("directory"),
    ).unionByName(s.range(1).select(F.lit("solo").alias("entry_id"), F.lit(0).cast("bigint").alias("pos"), F.lit("none").alias("name"), F.lit("").alias("directory")))
    return matching.imageset_match(rows.select("entry_id", "relative_path"), about).select("entry_id", "relative_path", "pos", "imageset")


def scanned(s, d):
    k = F.col("walk_pos")
    rows = assets(s, d).withColumns({"path_type": F.when(k % 23 == 0, "symlink").otherwise("file"), "modified_at": k * 1000})
    return E.scan_summary(rows, rows.where("walk_pos % 31 = 0").select(F.when(k % 2 == 0, "stat").otherwise("read").alias("operation")))


def registered(s, d):
    k = F.col("walk_pos")
    rows = assets(s, d).withColumns({"path_type": F.when(F.col("extension") == ".zarray", "directory_volume").otherwise("file"), "asset_status": F.when(k % 6 == 0, None).when(k % 6 == 1, "").otherwise("seen")})
    return E.registry_summary(rows)


def third_page(s, d):
    """Two pages are read for their last rows, and the one after them is the result."""
    rows, order, last = B.inventory(s, d).select("size_bytes", "relative_path"), ("size_bytes", "relative_path"), None
    for _ in range(2):
        found = E.page_after(rows, order, last, 40).collect()  # 40 rows
        last = tuple(found[-1]) if found else last
    return E.page_after(rows, order, last, 40)


def _jobs(s, d):
    return jobs.latest(B.job_events(s, d))


BUCKETS = {"purchase": "completed", "error": "failed", "signup": "active", "click": "blocked"}


def histogram(s, d):
    return V.histogram(B.voxels(s, d), -1.0, 1.0, 64)


def sampled_histogram(s, d):
    """16-bit values of the embeddings in chunks of 400 rows; a whole chunk has 25,600 voxels, of which every second counts."""
    scaled = F.least(F.greatest(F.floor((F.col("value") + 1) / 2 * 65535), F.lit(0)), F.lit(65535))
    return V.chunk_histogram(V.to_chunks(B.voxels(s, d).withColumn("value", scaled), 400, 64, "<u2"), "<u2")


def stored_grid(s, d):
    """The grid of the embeddings' rows, with the length of the chunk that is stored for each place."""
    rows = B.table(s, d, "embeddings").agg((F.max("vec_id") + 1).alias("n")).first()["n"] or 0
    stored = V.to_chunks(B.voxels(s, d), 32, 64).select(F.concat_ws(".", "cz", "cy", "cx").alias("name"), F.length("raw").cast("bigint").alias("length"))
    return V.chunk_grid(s, (max(1, rows), 1, 64), (32, 1, 64)).join(stored, "name", "left")


def resumed_chunks(s, d):
    """Half of the chunks are written, then all are asked for; the journal names each once, and nothing is missing."""
    path, journal = scratch_path(s, "chunk-files"), scratch_path(s, "chunk-journal")
    rows = B.table(s, d, "embeddings").agg((F.max("vec_id") + 1).alias("n")).first()["n"] or 0
    chunks = written(V.to_chunks(B.voxels(s, d), 32, 64), "chunks")
    grid = V.chunk_grid(s, (max(1, rows), 1, 64), (32, 1, 64))
    writers.resume_chunks(chunks, grid.where("cz % 2 = 0"), path, journal, 4)
    missing = writers.resume_chunks(chunks, grid, path, journal, 4).count()
    times = s.read.schema(writers.JOURNAL).parquet(journal).groupBy("name", "length").agg(F.count("*").alias("times"))
    return times.withColumn("missing", F.lit(missing).cast("bigint"))


def token_search(s, d):
    """Documents in which two prefixes begin tokens, from a table of the documents' tokens."""
    path = scratch_path(s, "tokens")
    search.write_token_table(B.table(s, d, "documents"), "doc_id", "text", path)
    return search.search_tokens(s, path, "an+TH").withColumnRenamed("id", "doc_id")


def labelled(s, d):
    return B.voxels(s, d).withColumn("label01", V.threshold(F.col("value"), "ge", 0.1)).withColumn("truth", ((F.col("label") + F.col("position")) % 3 == 0).cast("int"))


def normalized_text(s, d):
    """X1-X14 over part names and pages."""
    p = B.table(s, d, "part")
    note = F.concat("p_name", F.lit(" ; Contact sites, surface area,"), "p_type", F.lit(",volume"))
    return p.select(
        "p_partkey",
        N.clean(F.concat(F.lit("  "), "p_name", F.lit("  x "))).alias("cleaned"),
        N.slug(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"),
        F.array_join(N.split_terms(note), "|").alias("terms"),
        F.array_join(N.metric_families(note), "|").alias("metrics"),
        N.comparator_class(F.concat(F.lit("cell cycle "), "p_type")).alias("comparator"),
        N.modality_family("p_name").alias("family"),
        F.coalesce(N.first_int(F.concat(F.lit("about 1,"), F.lpad("p_size", 3, "0"), F.lit(" cells"))), F.lit(0)).alias("first_int"),
        F.round(N.mean_numeric(F.concat("p_size", F.lit(" x 2.5 nm"))), 6).alias("mean_number"),
        N.sample_size_bucket(F.col("p_size")).alias("bucket"),
        N.species(F.concat("p_name", F.lit(", adult")), F.lit("mouse")).alias("species"),
    )


def size_ranges(s, d):
    p = B.table(s, d, "part").select("p_partkey", "p_size")
    raw = (
        F.when(F.col("p_partkey") % 4 == 0, F.col("p_size").cast("string"))
        .when(F.col("p_partkey") % 4 == 1, F.concat("p_size", F.lit("-"), F.col("p_size") + 5, F.lit(" MB each")))
        .when(F.col("p_partkey") % 4 == 2, F.concat("p_size", F.lit(" GB and 1,500 KB")))
        .otherwise("unknown")
    )
    return p.withColumn("r", N.size_range(raw, F.lit("3 files"))).select("p_partkey", "r.lo", "r.hi", "r.note")


def links(s, d):
    """Links of the pages, without query, parent and root links, and their hosts."""
    p = B.table(s, d, "pages")
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    kept = F.filter(found, lambda u: ~F.startswith(u, F.lit("?")) & ~F.startswith(u, F.lit("..")) & (u != "/") & (u != ""))
    return p.select("page_id", F.size(kept).alias("n_links"), F.sha2(F.array_join(kept, "\n"), 256).alias("links_sha256"), N.repository_type(F.col("url")).alias("repository"))


QUERIES = {
    "duplicates": lambda s, d: E.duplicates(B.inventory(s, d)),
    "copy_verification": copy_issues,
    "copy_verification_summary": copy_summary,
    "stale_purge": lambda s, d: E.stale(B.inventory(s, d), B.inventory(s, d).where("doc_id % 5 <> 0")).select("relative_path", "digest"),
    "latest_record": lambda s, d: E.keep_last(B.table(s, d, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", "role", "text"),
    "metadata_gaps": lambda s, d: assets(s, d).select("asset_id", F.explode("gaps").alias("g")).select("asset_id", "g.gap_code", "g.severity"),
    "readiness": lambda s, d: assets(s, d).select("asset_id", "ready", "project_ready", "conversion_ready", F.array_join("states", ",").alias("states"), F.array_join("blockers", ",").alias("blockers")),
    "overlay": overlaid,
    "overlay_leftovers": lambda s, d: E.overlay_leftovers(assets(s, d), overlay_rows(s, d)).select("asset_id"),
    "registry_summary": registered,
    "registry_match": registry_matches,
    "handoff_match": handoffs,
    "imageset_match": imagesets,
    "registry_page_after": third_page,
    "review_queue": lambda s, d: E.review_queue(assets(s, d).withColumn("duplicate_of", F.when(F.col("walk_pos") % 8 == 0, "x"))),
    "workset": lambda s, d: E.workset(assets(s, d), E.selected(prefixes=["src1", "src2/en"], query="asset tif"), 500).select("asset_id", "is_candidate", F.array_join("blocked_intents", ",").alias("blocked_intents")),
    "registry_search": lambda s, d: assets(s, d).where(filters.all_tokens(F.col("search_text"), "src1 tiff .mrc") & filters.token_prefixes(F.col("search_text"), "asset src1 ti")).select("asset_id", "relative_path"),
    "extension_summary": scanned,
    "largest_files": lambda s, d: E.largest(B.inventory(s, d), 50).select("relative_path", "size_bytes"),
    "registry_page": lambda s, d: E.page(B.inventory(s, d), 2, 40, "walk_pos").select("relative_path", "walk_pos"),
    "prefix_rollup": lambda s, d: E.prefix_rollup(prefixes(s, d), B.inventory(s, d)),
    "tree_digest": lambda s, d: E.tree_digest(B.inventory(s, d).withColumn("directory", F.substring_index("relative_path", "/", 2)), "directory"),
    "scored_match": scored,
    "latest_job": lambda s, d: _jobs(s, d).select("job_id", "dataset", "status", "n_events"),
    "batch_plan": lambda s, d: jobs.batch_plan(_jobs(s, d), ("purchase",), 20, 120),
    "batch_summary": lambda s, d: jobs.batch_summary(_jobs(s, d), BUCKETS),
    "run_status": lambda s, d: jobs.run_status(_jobs(s, d), "error", ("signup",)),
    "recent_events": lambda s, d: jobs.capped_recent(B.job_events(s, d), "job_id", 3).select("job_id", "event_id", F.col("recent").cast("bigint").alias("recent")),
    "event_payload": lambda s, d: B.table(s, d, "events").select("event_id", F.from_json("props", "k long").alias("p")).select("event_id", F.col("p.k").alias("k")),
    "histogram": histogram,
    "histogram_stats": lambda s, d: V.histogram_stats(histogram(s, d)),
    "percentile_stretch": lambda s, d: V.percentile_stretch(B.voxels(s, d)),
    "confusion": lambda s, d: V.acceptance(V.confusion(labelled(s, d), F.col("label01"), F.col("truth")), {"dice": 0.3, "recall": 0.9}),
    "label_bbox": lambda s, d: V.label_box(B.voxels(s, d).withColumn("label01", V.threshold(F.col("value"), "gt", 0.33))),
    "chunk_histogram": sampled_histogram,
    "chunk_grid": stored_grid,
    "chunk_journal": resumed_chunks,
    "token_search": token_search,
    "axis_slice": lambda s, d: V.axis_slice(B.voxels(s, d), "position", 17).select("row", "value"),
    "downsample": lambda s, d: V.downsample(B.voxels(s, d), 4),
    "chunk_roundtrip": lambda s, d: V.chunk_values(V.to_chunks(B.voxels(s, d), 32, 64)),
    "normalize_text": normalized_text,
    "size_ranges": size_ranges,
    "page_links": links,
}

_LATEST = f"WITH {B.JOBS_SQL}, latest AS (SELECT job_id, dataset, arg_max(status, (ts, event_id)) AS status, count(*) AS n_events FROM jobs GROUP BY ALL)"
_VOX = f"WITH {B.VOXELS_SQL}"
_HIST = _VOX + ", hist AS (SELECT CAST(least(greatest(floor((value + 1.0) / 2.0 * 64), 0), 63) AS INT) AS bin, count(*) AS n FROM voxels GROUP BY ALL)"
_LAB = _VOX + ", lab AS (SELECT *, CAST(value >= 0.1 AS INT) AS label01, CAST((label + position) % 3 = 0 AS INT) AS truth FROM voxels)"

ORACLES = {
    "duplicates": f"WITH {B.INVENTORY_SQL}, f AS (SELECT *, first_value(relative_path) OVER (PARTITION BY digest ORDER BY walk_pos, relative_path) AS duplicate_of FROM inventory) SELECT relative_path, duplicate_of, digest, size_bytes FROM f WHERE relative_path <> duplicate_of",
    "copy_verification": _SIDES_SQL + "SELECT relative_path, issue_type, s_size, t_size FROM issues",
    "copy_verification_summary": _SIDES_SQL + "SELECT 'common_paths' AS measure, count(*) AS n FROM j WHERE in_s AND in_t UNION ALL SELECT issue_type, count(*) FROM issues GROUP BY issue_type",
    "stale_purge": f"WITH {B.INVENTORY_SQL} SELECT relative_path, digest FROM inventory WHERE relative_path NOT IN (SELECT relative_path FROM inventory WHERE doc_id % 5 <> 0)",
    "latest_record": "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "metadata_gaps": ASSETS_SQL + "SELECT asset_id, g AS gap_code, CASE WHEN g IN ('missing_dimensions', 'missing_dtype', 'metadata_status_error') THEN 'blocker' ELSE 'review' END AS severity FROM (SELECT asset_id, unnest(gaps) AS g FROM assets)",
    "readiness": ASSETS_SQL + "SELECT asset_id, ready, project_ready, conversion_ready, array_to_string(states, ',') AS states, array_to_string(blockers, ',') AS blockers FROM assets",
    "overlay": _OVERLAY_SQL,
    "overlay_leftovers": "SELECT 'asset-' || (doc_id + 10000000) AS asset_id FROM labels WHERE doc_id % 10 = 0",
    "registry_summary": ASSETS_SQL + """, c AS (SELECT count(*) AS asset_count, count(*) FILTER (WHERE extension <> '.zarray') AS file_asset_count, count(*) FILTER (WHERE extension = '.zarray') AS logical_asset_count, sum(size_bytes) AS bytes_total,
  count(*) FILTER (WHERE is_candidate) AS volume_candidate_count, count(*) FILTER (WHERE is_candidate OR len(gaps) > 0 OR walk_pos % 19 = 0) AS review_queue_count, sum(len(gaps)) AS metadata_gap_count,
  count(*) FILTER (WHERE digest <> '') AS checksum_record_count, count(*) FILTER (WHERE walk_pos % 19 = 0) AS duplicate_asset_count, count(*) FILTER (WHERE project_ready) AS project_ready_count FROM assets),
n AS (UNPIVOT c ON COLUMNS(*) INTO NAME name VALUE n)
SELECT 'counter' AS kind, name, CAST(n AS BIGINT) AS n FROM n
UNION ALL SELECT 'extension', CASE WHEN extension = '' THEN '[none]' ELSE extension END, count(*) FROM assets GROUP BY 2 UNION ALL SELECT 'role', role, count(*) FROM assets GROUP BY 2 UNION ALL SELECT 'format', format, count(*) FROM assets GROUP BY 2
UNION ALL SELECT 'status', CASE WHEN walk_pos % 6 < 2 THEN 'unknown' ELSE 'seen' END, count(*) FROM assets GROUP BY 2
UNION ALL SELECT 'readiness', b, count(*) FROM (SELECT unnest(CASE WHEN len(blockers) = 0 THEN ['ready'] ELSE blockers END) AS b FROM assets) GROUP BY 2""",
    # every asset against every derivative, one rule after the other
    "registry_match": f"""WITH {B.INVENTORY_SQL}, norm AS (SELECT *, 'asset-' || doc_id AS asset_id, 'reg' || (doc_id % 2) AS reg, CASE WHEN doc_id % 4 = 0 THEN '/data/arch/' || relative_path WHEN doc_id % 4 = 1 THEN '/srv/data/' || relative_path ELSE relative_path END AS whole, CASE WHEN doc_id % 6 <> 0 THEN size_bytes END AS a_size,
  CASE WHEN doc_id % 4 = 0 THEN 'asset-' || (doc_id - doc_id % 8) END AS d_asset, CASE WHEN doc_id % 3 = 0 THEN 'reg' || (doc_id % 5 % 2) END AS d_reg, CASE WHEN doc_id % 3 = 0 THEN digest ELSE 'short' END AS d_sha, CASE WHEN doc_id % 9 = 0 THEN size_bytes + 1 WHEN doc_id % 9 <> 3 THEN size_bytes END AS d_size,
  CASE WHEN doc_id % 6 = 1 THEN '/data/arch/' || relative_path WHEN doc_id % 6 = 2 THEN '/srv/data/' || relative_path ELSE '' END AS d_source, CASE WHEN doc_id % 10 = 4 THEN '/else/where/' || relative_path WHEN doc_id % 10 = 2 THEN '/data/arch/' || relative_path ELSE '' END AS d_out, CASE WHEN doc_id % 11 = 5 THEN relative_path ELSE '' END AS d_rel FROM inventory),
p AS (SELECT a.asset_id, d.doc_id + 5000000 AS derivative_id, CASE WHEN d.d_asset = a.asset_id AND (d.d_reg IS NULL OR d.d_reg = a.reg) THEN 400
    WHEN d.d_sha = a.digest AND (coalesce(a.a_size, 0) = 0 OR coalesce(d.d_size, 0) = 0 OR a.a_size = d.d_size) THEN 300 WHEN d.d_source = a.whole OR d.d_out = a.whole THEN 200
    WHEN d.d_rel = a.relative_path OR ends_with(d.d_source, '/' || a.relative_path) OR ends_with(d.d_out, '/' || a.relative_path) THEN 100 END AS score FROM norm a, norm d WHERE a.doc_id % 7 <> 0 AND a.doc_id % 11 <> 0),
t AS (SELECT * FROM (SELECT asset_id, score, count(*) AS n, min(derivative_id) AS derivative_id FROM p WHERE score IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY score DESC) = 1)
SELECT norm.asset_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'blocked' WHEN n IS NULL THEN 'not-loaded' WHEN n = 1 THEN 'ready' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN derivative_id END AS derivative_id,
CASE WHEN n = 1 THEN CASE score WHEN 400 THEN 'archive-identity' WHEN 300 THEN 'checksum' WHEN 200 THEN 'local-path' ELSE 'relative-path' END END AS matched_by FROM norm LEFT JOIN t USING (asset_id)""",
    "handoff_match": """WITH h AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN 'set' || doc_id ELSE '' END AS ds, CASE WHEN doc_id % 3 = 0 THEN 'study' || (doc_id // 4) ELSE '' END AS st, CASE WHEN doc_id % 2 = 0 THEN ['empiar' || doc_id, 'x' || (doc_id + 1)] ELSE CAST([] AS VARCHAR[]) END AS acc FROM documents),
d AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'set_' || doc_id WHEN 1 THEN 'Study' || (doc_id // 4) ELSE 'other' || doc_id END AS slug, CASE doc_id % 4 WHEN 2 THEN 'empiar' || doc_id WHEN 3 THEN 'x' || doc_id ELSE 'study' || (doc_id // 8) END AS entry, n_chars % 3 > 0 AS loaded FROM documents),
p AS (SELECT doc_id, slug, loaded, CASE WHEN replace(lower(slug), '_', '') = ds THEN 100 WHEN st <> '' AND (replace(lower(slug), '_', '') = st OR entry = st) THEN 90 WHEN list_contains(acc, entry) THEN 80 END AS score FROM h, d),
t AS (SELECT * FROM (SELECT doc_id, score, count(*) AS n, min(slug) AS slug, bool_and(loaded) AS loaded FROM p WHERE score IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC) = 1)
SELECT h.doc_id AS handoff_id, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 AND loaded THEN 'ready' ELSE 'pending' END AS status, CASE WHEN n = 1 AND loaded THEN slug END AS slug,
CASE WHEN n = 1 AND loaded THEN CASE score WHEN 100 THEN 'dataset-id' WHEN 90 THEN 'study-id' ELSE 'repository-accession' END END AS matched_by FROM h LEFT JOIN t USING (doc_id)""",
    "imageset_match": f"""WITH {B.INVENTORY_SQL}, f AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'solo' ELSE split_part(relative_path, '/', 1) END AS entry_id, regexp_replace(split_part(relative_path, '/', 3), '\\.[^.]+$', '') AS stem, regexp_replace(relative_path, '(\\.mrc|\\.mrc\\.tif|\\.tif|\\.tiff)$', '') AS bare FROM inventory),
s AS (SELECT split_part(relative_path, '/', 1) AS entry_id, doc_id AS pos, CASE doc_id % 5 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN '/' || doc_id || '.ome' WHEN 2 THEN CAST(doc_id % 100 + 100 AS VARCHAR) WHEN 3 THEN '' END AS name, CASE WHEN doc_id % 29 = 7 THEN split_part(relative_path, '/', 1) || '/' || split_part(relative_path, '/', 2) ELSE '' END AS directory FROM inventory UNION ALL SELECT 'solo', 0, 'none', ''),
m AS (SELECT f.entry_id, relative_path, min(pos) AS pos FROM f JOIN s ON f.entry_id = s.entry_id AND ((s.name <> '' AND (stem = s.name OR ends_with(bare, s.name))) OR (directory <> '' AND starts_with(relative_path, directory || '/'))) GROUP BY ALL),
o AS (SELECT entry_id, min(pos) AS lone FROM s GROUP BY entry_id HAVING count(*) = 1)
SELECT f.entry_id, f.relative_path, coalesce(m.pos, lone) AS pos, CASE WHEN coalesce(m.pos, lone) IS NOT NULL THEN coalesce(s.name, '') END AS imageset FROM f LEFT JOIN m USING (entry_id, relative_path) LEFT JOIN o USING (entry_id) LEFT JOIN s ON s.entry_id = f.entry_id AND s.pos = coalesce(m.pos, lone)""",
    "registry_page_after": f"WITH {B.INVENTORY_SQL} SELECT size_bytes, relative_path FROM inventory ORDER BY size_bytes, relative_path LIMIT 40 OFFSET 80",
    "review_queue": ASSETS_SQL + """, r AS (SELECT *, list_concat(CASE WHEN is_candidate THEN ['volume_candidate'] ELSE CAST([] AS VARCHAR[]) END, gaps, CASE WHEN walk_pos % 8 = 0 THEN ['duplicate_checksum'] ELSE CAST([] AS VARCHAR[]) END) AS reasons FROM assets)
SELECT asset_id, relative_path, CASE WHEN list_has_any(gaps, ['missing_dimensions', 'missing_dtype', 'metadata_status_error']) THEN 'blocker' ELSE 'review' END AS severity, array_to_string(reasons, ';') AS reasons, array_to_string(blockers, ';') AS blockers FROM r WHERE len(reasons) > 0""",
    "workset": ASSETS_SQL + """, t AS (SELECT *, lower(asset_id || ' ' || relative_path || ' ' || format) AS txt FROM assets)
SELECT asset_id, is_candidate, array_to_string(list_filter([CASE WHEN NOT project_ready THEN 'view' END, CASE WHEN NOT conversion_ready THEN 'convert' END], lambda x: x IS NOT NULL), ',') AS blocked_intents
FROM t WHERE starts_with(relative_path, 'src1/') OR starts_with(relative_path, 'src2/en/') OR (contains(txt, 'asset') AND contains(txt, 'tif')) ORDER BY walk_pos, relative_path LIMIT 500""",
    "registry_search": ASSETS_SQL + """, t AS (SELECT *, lower(asset_id || ' ' || relative_path || ' ' || format) AS txt FROM assets)
SELECT asset_id, relative_path FROM t WHERE contains(txt, 'src1') AND contains(txt, 'tiff') AND contains(txt, '.mrc') AND regexp_matches(txt, '(^|[^a-z0-9])src1') AND regexp_matches(txt, '(^|[^a-z0-9])ti') AND regexp_matches(txt, '(^|[^a-z0-9])asset')""",
    "extension_summary": ASSETS_SQL + ", r AS (SELECT *, CASE WHEN walk_pos % 23 = 0 THEN 'symlink' ELSE 'file' END AS path_type, walk_pos * 1000 AS m FROM assets) " + " UNION ALL ".join(
        f"SELECT '{k}' AS grouping, {c} AS name, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS bytes, min(m) AS modified_min, max(m) AS modified_max FROM r GROUP BY 2" for k, c in (("extension", "CASE WHEN extension = '' THEN '[none]' ELSE extension END"), ("role", "role"), ("path_type", "path_type"), ("all", "'*'")))
    + " UNION ALL SELECT 'error', CASE WHEN walk_pos % 2 = 0 THEN 'stat' ELSE 'read' END, count(*), NULL, NULL, NULL FROM r WHERE walk_pos % 31 = 0 GROUP BY 2",
    "largest_files": f"WITH {B.INVENTORY_SQL} SELECT relative_path, size_bytes FROM inventory ORDER BY size_bytes DESC, walk_pos LIMIT 50",
    "registry_page": f"WITH {B.INVENTORY_SQL} SELECT relative_path, walk_pos FROM inventory ORDER BY walk_pos LIMIT 40 OFFSET 80",
    "prefix_rollup": f"""WITH {B.INVENTORY_SQL}, p AS (SELECT DISTINCT split_part(relative_path, '/', 1) AS prefix FROM inventory UNION SELECT DISTINCT split_part(relative_path, '/', 1) || '/' || split_part(relative_path, '/', 2) FROM inventory UNION SELECT 'nowhere')
SELECT prefix, count(relative_path) AS n_files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes, max(walk_pos) AS latest FROM p LEFT JOIN inventory ON starts_with(relative_path, prefix || '/') GROUP BY prefix""",
    "tree_digest": f"""WITH {B.INVENTORY_SQL} SELECT split_part(relative_path, '/', 1) || '/' || split_part(relative_path, '/', 2) AS directory, sha256(string_agg(relative_path || chr(0) || size_bytes || chr(0) || digest || chr(10), '' ORDER BY relative_path)) AS tree_digest, count(*) AS n_files FROM inventory GROUP BY ALL""",
    "scored_match": f"""WITH {B.INVENTORY_SQL}, l AS (SELECT *, split_part(relative_path, '/', 3) AS name FROM inventory), r AS (SELECT doc_id + 5000000 AS rid, CASE WHEN doc_id % 4 = 0 THEN doc_id END AS origin, CASE WHEN doc_id % 2 = 0 THEN digest END AS digest, CASE WHEN doc_id % 2 = 0 THEN split_part(relative_path, '/', 3) ELSE doc_id || '.none' END AS name FROM inventory),
p AS (SELECT l.doc_id, rid, max(score) AS score FROM (SELECT l.doc_id, rid, 400 AS score FROM l JOIN r ON origin = l.doc_id UNION ALL SELECT l.doc_id, rid, 300 FROM l JOIN r USING (digest) UNION ALL SELECT l.doc_id, rid, 100 FROM l JOIN r USING (name)) l GROUP BY ALL),
b AS (SELECT doc_id, score, count(*) AS k, min(rid) AS rid FROM p x WHERE score = (SELECT max(score) FROM p y WHERE y.doc_id = x.doc_id) GROUP BY ALL)
SELECT l.doc_id, CASE WHEN score IS NULL THEN 'unmatched' WHEN k = 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN k = 1 THEN rid END AS match_id, score FROM l LEFT JOIN b USING (doc_id)""",
    "latest_job": _LATEST + "SELECT job_id, dataset, status, n_events FROM latest",
    "batch_plan": _LATEST + """, o AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY job_id) AS place FROM latest WHERE status <> 'purchase'), w AS (SELECT job_id FROM o WHERE place <= 20 ORDER BY job_id LIMIT 120)
SELECT l.job_id, l.dataset, l.status, CASE WHEN place IS NULL THEN 'done' WHEN w.job_id IS NOT NULL THEN 'planned' WHEN place > 20 THEN 'dataset_quota' ELSE 'plan_full' END AS decision FROM latest l LEFT JOIN o USING (job_id) LEFT JOIN w ON w.job_id = l.job_id""",
    "batch_summary": _LATEST + "SELECT dataset, " + ", ".join(f"count(*) FILTER (WHERE coalesce(b, 'pending') = '{n}') AS n_{n}" for n in ("active", "blocked", "completed", "failed", "pending")) + " FROM (SELECT *, CASE status WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'active' WHEN 'click' THEN 'blocked' END AS b FROM latest) GROUP BY dataset",
    "run_status": _LATEST + "SELECT dataset, CASE WHEN bool_or(status = 'signup') THEN 'active' WHEN bool_or(status = 'error') THEN 'failed' ELSE 'completed' END AS run_status, count(*) AS n_jobs FROM latest GROUP BY dataset",
    "recent_events": f"WITH {B.JOBS_SQL} SELECT job_id, event_id, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS recent FROM jobs QUALIFY recent <= 3",
    "event_payload": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "histogram": _HIST + "SELECT bin, n FROM hist",
    "histogram_stats": _HIST + "SELECT CAST(sum(n) AS BIGINT) AS total, (SELECT bin FROM hist ORDER BY n DESC, bin LIMIT 1) AS peak_bin, (SELECT min(bin) FROM (SELECT bin, sum(n) OVER (ORDER BY bin) AS u, sum(n) OVER () AS t FROM hist) WHERE u >= t / 2) AS median_bin FROM hist",
    "percentile_stretch": _VOX + ", e AS (SELECT quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM voxels) SELECT row, position, CAST(floor(least(greatest((value - lo) / (hi - lo), 0.0), 1.0) * 255) AS INT) AS u8 FROM voxels, e",
    "confusion": _LAB + """, c AS (SELECT count(*) FILTER (WHERE label01 = 1 AND truth = 1) AS tp, count(*) FILTER (WHERE label01 = 1 AND truth = 0) AS fp, count(*) FILTER (WHERE label01 = 0 AND truth = 1) AS fn, count(*) FILTER (WHERE label01 = 0 AND truth = 0) AS tn FROM lab)
SELECT *, 2.0 * tp / (2 * tp + fp + fn) AS dice, tp / (tp + fp + fn) AS iou, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, tn / (tn + fp) AS specificity, fp / (fp + tn) AS false_positive_rate, (tp + tn) / (tp + fp + fn + tn) AS accuracy,
CASE WHEN 2.0 * tp / (2 * tp + fp + fn) >= 0.3 AND tp / (tp + fn) >= 0.9 THEN 'passed' ELSE 'failed' END AS acceptance FROM c""",
    "label_bbox": _VOX + ", lab AS (SELECT *, value > 0.33 AS f FROM voxels) SELECT count(*) FILTER (WHERE f) AS foreground, round(count(*) FILTER (WHERE f) / count(*), 6) AS fraction, min(row) FILTER (WHERE f) AS row_min, max(row) FILTER (WHERE f) AS row_max, min(position) FILTER (WHERE f) AS position_min, max(position) FILTER (WHERE f) AS position_max FROM lab",
    "chunk_histogram": _VOX + """, c AS (SELECT row // 400 AS c, row % 400 * 64 + position AS i, least(greatest(floor((value + 1) / 2 * 65535), 0), 65535) AS u FROM voxels), n AS (SELECT c, greatest(1, count(*) // 10000) AS step FROM c GROUP BY c)
SELECT CAST(least(255, floor(u / 65535 * 255)) AS INT) AS bin, count(*) AS n FROM c JOIN n USING (c) WHERE i % step = 0 GROUP BY 1""",
    "chunk_grid": """WITH n AS (SELECT max(vec_id) + 1 AS n FROM embeddings), c AS (SELECT CAST(unnest(range((n + 31) // 32)) AS INT) AS cz, n FROM n)
SELECT cz, 0 AS cy, 0 AS cx, cz * 32 AS z0, CAST(least(cz * 32 + 32, n) AS INT) AS z1, 0 AS y0, 1 AS y1, 0 AS x0, 64 AS x1, cz || '.0.0' AS name, (least(cz * 32 + 32, n) - cz * 32) * 64 AS voxels,
(SELECT count(*) * 256 FROM embeddings WHERE vec_id // 32 = cz) AS length FROM c""",
    "chunk_journal": "SELECT (vec_id // 32) || '.0.0' AS name, count(*) * 256 AS length, 1 AS times, 0 AS missing FROM embeddings GROUP BY 1",
    "token_search": "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])an') AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])th')",
    "axis_slice": _VOX + "SELECT row, value FROM voxels WHERE position = 17",
    "downsample": _VOX + "SELECT row // 4 AS row, CAST(position // 4 AS INT) AS position, value FROM voxels WHERE row % 4 = 0 AND position % 4 = 0",
    "chunk_roundtrip": _VOX + "SELECT row, position, value FROM voxels",
    "normalize_text": """SELECT p_partkey, p_name || ' x' AS cleaned, regexp_replace(regexp_replace(lower(p_name || ' / ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, p_name || '|contact sites|surface area|' || lower(p_type) || '|volume' AS terms,
'other|contacts|surface_area|volume' AS metrics, 'cell cycle' AS comparator, CASE WHEN regexp_matches(p_name, 'fib-sem|sbf-sem|sem|electron|cryo|tem|et') THEN 'EM' ELSE 'other' END AS family, CAST(1000 + p_size AS BIGINT) AS first_int, round((p_size + 2.5) / 2, 6) AS mean_number,
CASE WHEN p_size <= 1 THEN '1' WHEN p_size <= 10 THEN '2-10' WHEN p_size <= 50 THEN '11-50' ELSE '51+' END AS bucket, p_name AS species FROM part""",
    "size_ranges": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 1000000000 WHEN 1 THEN p_size * 3000000 WHEN 2 THEN p_size * 1000000000 + 1500000 END AS lo, CASE p_partkey % 4 WHEN 0 THEN p_size * 1000000000 WHEN 1 THEN (p_size + 5) * 3000000 WHEN 2 THEN p_size * 1000000000 + 1500000 END AS hi,
CASE p_partkey % 4 WHEN 0 THEN 'numeric cell without units in workbook; interpreted as GB from context' WHEN 1 THEN 'range multiplied by reported file count (3)' WHEN 2 THEN '' ELSE 'unable to parse size' END AS note FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)""",
    "page_links": """WITH l AS (SELECT page_id, url, list_filter(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda u: NOT starts_with(u, '?') AND NOT starts_with(u, '..') AND u <> '/' AND u <> '') AS k FROM pages)
SELECT page_id, CAST(len(k) AS INT) AS n_links, sha256(array_to_string(k, chr(10))) AS links_sha256, CASE WHEN contains(url, '://') THEN split_part(url, '/', 3) ELSE 'other' END AS repository FROM l""",
}

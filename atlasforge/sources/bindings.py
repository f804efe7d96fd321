"""Views of the driver's tables as the engine's inputs: catalog records, file inventories, job events, voxel grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..scratch import file_identity, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CATALOG_TABLES = ("orders", "lineitem", "part", "customer", "nation", "region")
_catalogs: dict[tuple, DataFrame] = {}


def load_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The load: the catalog written as a table by year, from all its sources."""
    return written(catalog_rows(spark, sf_dir), "catalog", "year")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loaded catalog. A load is used again in an application as long as its source files have the names, sizes and times they had; else it is done anew."""
    key = (spark.sparkContext.applicationId, sf_dir, file_identity(spark, *[f"{sf_dir}/{t}.parquet" for t in CATALOG_TABLES]))
    if key not in _catalogs:
        for old in [k for k in _catalogs if k[:2] == key[:2]]:
            del _catalogs[old]
        _catalogs[key] = load_catalog(spark, sf_dir)
    return _catalogs[key]


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order is one catalog record; its line items give the multi-valued traits."""
    t = lambda name: table(spark, sf_dir, name)
    types = t("part").select("p_partkey", F.lower("p_type").alias("type"))
    lines = t("lineitem").join(types, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("k"), "type", F.concat("l_returnflag", "l_linestatus").alias("metric"), "l_quantity")
    # an order has few lines: they are moved as they are and become sets once, not sets of each task that are packed and merged
    traits = (
        lines.repartition("k")
        .groupBy("k")
        .agg(F.sort_array(F.collect_set("type")).alias("organelles"), F.sort_array(F.collect_set("metric")).alias("metric_families"), F.sum("l_quantity").cast("int").alias("sample_size"))
    )
    none = F.array().cast("array<string>")
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "P", "partial").otherwise("none")
    comparator = F.when(k % 5 == 1, "cell type").when(k % 5 == 2, "treatment").when(k % 5 == 3, "methodology").when(k % 5 == 4, "other")
    xy = F.when(k % 7 != 0, F.col("o_totalprice") / 1000)
    known = F.array(F.concat(F.lit("https://zenodo.org/records/"), k.cast("string")), F.when(k % 2 == 0, F.concat(F.lit(" https://www.ebi.ac.uk/empiar/EMPIAR-"), k.cast("string"))))
    urls = F.when(F.col("o_orderstatus") == "O", none).otherwise(F.array_compact(known))
    rows = (
        t("orders")
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(traits, k == F.col("k"), "left")
        .select(
            F.concat(F.lit("rec-"), F.lpad(k.cast("string"), 9, "0")).alias("dataset_id"),
            F.concat(F.col("c_mktsegment"), F.lit(" whole-cell dataset ("), F.col("o_orderpriority"), F.lit(")")).alias("title"),
            F.concat(F.lit("Study of "), F.col("n_name")).alias("paper_title"),
            F.year("o_orderdate").cast("int").alias("year"),
            F.concat(F.lit("Journal "), (k % 11).cast("string")).alias("source"),
            status.alias("public_data_status"),
            F.col("n_name").alias("species"),
            F.col("c_mktsegment").alias("cell_type"),
            comparator.alias("comparator_class"),
            F.col("o_orderpriority").alias("modality"),
            F.col("r_name").alias("modality_family"),
            xy.alias("lateral_resolution_nm"),
            F.coalesce("organelles", none).alias("organelles"),
            F.coalesce("metric_families", none).alias("metric_families"),
            "sample_size",
            F.when(k % 17 == 0, "excluded").when(k % 10 == 0, "borderline").otherwise("included").alias("included_status"),
            F.concat(F.lit("Author"), (k % 97).cast("string"), F.lit(" et al. "), F.year("o_orderdate").cast("string")).alias("source_study_id"),
            F.when(k % 3 != 0, k.cast("string")).alias("publication_pmid"),
            F.when(k % 4 != 0, F.col("o_totalprice") / 500).alias("axial_resolution_nm"),
            F.when(k % 6 == 0, F.concat(F.lit("stain protocol "), (k % 13).cast("string"))).alias("comparator_detail"),
            F.when(k % 3 == 0, "yes").when(k % 3 == 1, "partial").otherwise("no").alias("whole_cell_boundary_confirmed"),
            F.when(k % 8 == 0, F.concat(F.lit("Reviewed by "), F.col("c_name"))).alias("notes"),
            urls.alias("public_locator_urls"),
        )
    )
    return rows.select(
        "*",
        N.publication_url(F.col("publication_pmid"), F.when(F.col("year") % 2 == 0, F.concat(F.lit("https://example.org/study/"), "dataset_id"))).alias("source_publication_url"),
        N.pairs_in_order(F.col("organelles")).alias("organelle_pairs"),
        N.sample_size_bucket(F.col("sample_size")).alias("sample_size_bucket"),
        N.completeness(F.col("organelles"), F.col("metric_families"), F.col("sample_size"), F.col("lateral_resolution_nm"), F.lit(None).cast("double"), F.col("public_data_status")).alias("metadata_completeness_score"),
    )


#: The same catalog for DuckDB.
CATALOG_SQL = """
arr AS (
  SELECT l_orderkey AS k, list_sort(list(DISTINCT lower(p_type))) AS organelles, list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS metric_families,
         CAST(sum(l_quantity) AS INT) AS sample_size
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
base AS (
  SELECT 'rec-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS dataset_id, c_mktsegment || ' whole-cell dataset (' || o_orderpriority || ')' AS title,
         'Study of ' || n_name AS paper_title, CAST(year(o_orderdate) AS INT) AS year, 'Journal ' || (o_orderkey % 11) AS source,
         CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'P' THEN 'partial' ELSE 'none' END AS public_data_status,
         n_name AS species, c_mktsegment AS cell_type,
         CASE o_orderkey % 5 WHEN 1 THEN 'cell type' WHEN 2 THEN 'treatment' WHEN 3 THEN 'methodology' WHEN 4 THEN 'other' END AS comparator_class,
         o_orderpriority AS modality, r_name AS modality_family,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 1000 END AS lateral_resolution_nm,
         coalesce(organelles, CAST([] AS VARCHAR[])) AS organelles, coalesce(metric_families, CAST([] AS VARCHAR[])) AS metric_families, sample_size,
         CASE WHEN o_orderkey % 17 = 0 THEN 'excluded' WHEN o_orderkey % 10 = 0 THEN 'borderline' ELSE 'included' END AS included_status,
         'Author' || (o_orderkey % 97) || ' et al. ' || year(o_orderdate) AS source_study_id,
         CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey AS VARCHAR) END AS publication_pmid, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice / 500 END AS axial_resolution_nm,
         CASE WHEN o_orderkey % 6 = 0 THEN 'stain protocol ' || (o_orderkey % 13) END AS comparator_detail, (['yes', 'partial', 'no'])[CAST(o_orderkey % 3 AS INT) + 1] AS whole_cell_boundary_confirmed,
         CASE WHEN o_orderkey % 8 = 0 THEN 'Reviewed by ' || c_name END AS notes,
         CASE WHEN o_orderstatus = 'O' THEN CAST([] AS VARCHAR[]) WHEN o_orderkey % 2 = 0 THEN ['https://zenodo.org/records/' || o_orderkey, ' https://www.ebi.ac.uk/empiar/EMPIAR-' || o_orderkey] ELSE ['https://zenodo.org/records/' || o_orderkey] END AS public_locator_urls,
         CASE WHEN o_orderkey % 3 <> 0 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || o_orderkey || '/' WHEN year(o_orderdate) % 2 = 0 THEN 'https://example.org/study/rec-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') END AS source_publication_url
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN arr ON o_orderkey = k),
catalog AS (
  SELECT *, flatten(list_transform(range(1, len(organelles) + 1), lambda i: list_transform(organelles[i + 1 :], lambda y: organelles[i] || ':' || y))) AS organelle_pairs,
         CASE WHEN sample_size IS NULL THEN 'unknown' WHEN sample_size <= 1 THEN '1' WHEN sample_size <= 10 THEN '2-10' WHEN sample_size <= 50 THEN '11-50' ELSE '51+' END AS sample_size_bucket,
         round(least(0.35 + CASE WHEN lateral_resolution_nm IS NOT NULL THEN 0.15 ELSE 0.05 END + CASE WHEN len(organelles) > 0 THEN 0.2 ELSE 0 END + CASE WHEN len(metric_families) > 0 THEN 0.1 ELSE 0 END
           + CASE WHEN sample_size IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN public_data_status <> 'none' THEN 0.1 ELSE 0.05 END, 1.0), 2) AS metadata_completeness_score
  FROM base)
"""


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as archived files: path, extension, digest, size."""
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".tif", ".ome.tif", ".mrc", ".json", ".csv", ".zarray", "")]), (F.col("doc_id") % 7 + 1).cast("int"))
    return d.select(
        "doc_id",
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), ext)).alias("relative_path"),
        F.sha2("text", 256).alias("digest"),
        F.col("n_chars").alias("size_bytes"),
        F.col("doc_id").alias("walk_pos"),
    )


INVENTORY_SQL = """
inventory AS (
  SELECT doc_id, source || '/' || lang || '/' || doc_id || (['.tif', '.ome.tif', '.mrc', '.json', '.csv', '.zarray', ''])[CAST(doc_id % 7 AS INT) + 1] AS relative_path,
         sha256(text) AS digest, n_chars AS size_bytes, doc_id AS walk_pos
  FROM documents)
"""


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as job state changes: job, dataset, status, created_at order."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
        F.concat(F.lit("set-"), (F.col("user_id") % 10).cast("string")).alias("dataset"),
        F.col("event_type").alias("status"),
        "ts",
        "event_id",
        "value",
    )


JOBS_SQL = """
jobs AS (SELECT 'job-' || user_id AS job_id, 'set-' || (user_id % 10) AS dataset, event_type AS status, ts, event_id, value FROM events)
"""


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a 2-D grid of values: row, position, value."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("row"), "label", F.posexplode("embedding").alias("position", "value")).withColumn("value", F.col("value").cast("double"))


VOXELS_SQL = """
voxels AS (SELECT vec_id AS row, label, CAST(i - 1 AS INT) AS position, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i))
"""

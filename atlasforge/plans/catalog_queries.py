"""Catalog queries over the driver's tables, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators.filters import FilterSpec, precedent_text, public_state
from ..sources import bindings as B

INCLUDED = "included_status = 'included'"
TARGET = "rec-000000007"
WANTED = ("rec-000000033", "rec-000000005", "rec-999999999", "rec-000000005", "rec-000000064")
ORGANELLES = ("promo", "economy")

_cat = B.catalog


def _pairs(spark, sf_dir):
    """Groups of three records with neighbouring ids."""
    return C.compare(_grouped(spark, sf_dir))


def _grouped(spark, sf_dir):
    return _cat(spark, sf_dir).selectExpr("*", "cast(floor(cast(substr(dataset_id, 5) as bigint) / 3) as bigint) as group_id")


def _strings(df, *arrays):
    for a in arrays:
        df = df.withColumn(a, F.array_join(a, ","))
    return df


SEARCH = FilterSpec(query="_u%d", year=1995, metric_family="AF", include_borderline=True, public_data_only=True)
PAGE = FilterSpec(cell_type="mach", organelle="promo")

QUERIES = {
    "catalog_search": lambda s, d: C.search(_cat(s, d), SEARCH, 200).select("dataset_id", "year", "title", "public_data_status", "lateral_resolution_nm", "sample_size"),
    "catalog_listing": lambda s, d: _strings(C.listing(_cat(s, d), FilterSpec(modality_family="asia", comparator_class="treat")).select("dataset_id", "year", "organelles"), "organelles"),
    "catalog_page_total": lambda s, d: C.total(_cat(s, d), PAGE),
    "facet_counts": lambda s, d: C.facets(_cat(s, d)),
    "commonalities_top5": lambda s, d: C.commonalities(_cat(s, d), FilterSpec(public_data_status="complete")),
    "cross_tab_cells": lambda s, d: C.cross_tab(_cat(s, d), "organelles", "comparator_class").where("row_value is not null and col_value is not null"),
    "cross_tab_margins": lambda s, d: C.cross_tab(_cat(s, d), "organelles", "comparator_class").where("row_value is null or col_value is null").selectExpr(
        "coalesce(row_value, '*') as row_value", "coalesce(col_value, '*') as col_value", "n"
    ),
    "frontier_points": lambda s, d: C.frontier(_cat(s, d), FilterSpec()),
    "toolkit_matrix": lambda s, d: C.toolkit_matrix(_cat(s, d)),
    "measurement_grammar": lambda s, d: C.grammar(_cat(s, d)),
    "grammar_diversity": lambda s, d: C.grammar_margins(_cat(s, d)),
    "reusability_map": lambda s, d: C.reusability(_cat(s, d)),
    "reusable_traits": lambda s, d: C.reusable_traits(_cat(s, d)),
    "coverage_atlas": lambda s, d: C.coverage(_cat(s, d)),
    "coverage_totals": lambda s, d: C.coverage_totals(_cat(s, d)),
    "timeline": lambda s, d: C.timeline(_cat(s, d)),
    "timeline_families": lambda s, d: C.timeline_families(_cat(s, d)),
    "benchmark_stats": lambda s, d: C.benchmarks(_cat(s, d)),
    "benchmark_upper_median": lambda s, d: C.upper_median(_cat(s, d), "modality_family", "sample_size"),
    "similar_records": lambda s, d: C.similar(_cat(s, d), TARGET).select("dataset_id", "similarity_score", "year"),
    "compare_pairs": _pairs,
    "plan_status": lambda s, d: C.plan_status(_cat(s, d), ORGANELLES, 120.0, 30),
    "plan_precedents": lambda s, d: C.plan_precedents(_cat(s, d), ORGANELLES, 120.0, 30).orderBy(*C.precedent_order("sample_desc")).select("dataset_id", "year", "sample_size"),
    "plan_precedents_by_author": lambda s, d: C.plan_precedents(_cat(s, d), ORGANELLES, 120.0, 30).orderBy(*C.precedent_order("author_asc")).select("dataset_id", "source_study_id"),
    "plan_precedents_by_resolution": lambda s, d: C.plan_precedents(_cat(s, d), ORGANELLES, 120.0, 30).orderBy(*C.precedent_order("res_asc")).select("dataset_id", "lateral_resolution_nm"),
    "plan_precedents_public_first": lambda s, d: C.plan_precedents(_cat(s, d), ORGANELLES, 120.0, 30).orderBy(*C.precedent_order("public_first")).select("dataset_id", "public_data_status"),
    "ids_in_request_order": lambda s, d: C.in_request_order(_cat(s, d), WANTED).select("pos", "dataset_id", "year"),
    "organelle_pairs": lambda s, d: _cat(s, d).selectExpr("dataset_id", "array_join(organelle_pairs, ',') as pairs", "sample_size_bucket", "metadata_completeness_score"),
    "bibtex": lambda s, d: C.bibtex(_cat(s, d).where(INCLUDED)),
    "csv_rows": lambda s, d: C.csv_rows(_cat(s, d).where(INCLUDED)),
    "precedent_csv_rows": lambda s, d: C.precedent_csv_rows(C.plan_precedents(_cat(s, d), ORGANELLES, 120.0, 30)),
    "repeated_studies": lambda s, d: C.repeated_studies(_cat(s, d).selectExpr("*", "cast(floor(cast(substr(dataset_id, 5) as bigint) / 500) as bigint) as group_id")),
    "precedent_text": lambda s, d: _cat(s, d).where(precedent_text(" Stain PROTOCOL 7")).select("dataset_id", "comparator_detail"),
    "precedent_state": lambda s, d: _cat(s, d).where(public_state("partial") | public_state("complete")).groupBy("public_data_status").agg(F.count("*").alias("n")),
    "handoff_fingerprint": lambda s, d: C.handoff_fingerprint(_cat(s, d)),
}


def _sql(body: str) -> str:
    return f"WITH {B.CATALOG_SQL},\ninc AS (SELECT * FROM catalog WHERE {INCLUDED})\n{body}"


_PLAN = """, m AS (SELECT *, coalesce(nullif(lateral_resolution_nm, 0), 999) <= 180 AND coalesce(sample_size, 0) >= 15 AS strict FROM inc WHERE list_has_any(organelles, ['promo', 'economy'])),
pre AS (SELECT * FROM m WHERE strict OR NOT (SELECT bool_or(strict) FROM m))"""


def _plan(body: str) -> str:
    return f"WITH {B.CATALOG_SQL},\ninc AS (SELECT * FROM catalog WHERE {INCLUDED}){_PLAN}\n{body}"


_FACET = "SELECT '{0}' AS facet, value, count(*) AS n FROM (SELECT {1} AS value FROM inc{2}) GROUP BY value"
_TOP = "(SELECT '{0}' AS trait, value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, value) AS rank FROM (SELECT {1} AS value FROM inc WHERE public_data_status = 'complete') GROUP BY value ORDER BY n DESC, value LIMIT 5)"
_TAB = "SELECT coalesce(nullif(trim(organelles[1]), ''), 'none') AS row_value, coalesce(nullif(trim(comparator_class), ''), 'none') AS col_value FROM catalog WHERE included_status IN ('included', 'borderline')"

ORACLES = {
    "catalog_search": _sql("""SELECT dataset_id, year, title, public_data_status, lateral_resolution_nm, sample_size FROM catalog
WHERE included_status IN ('included', 'borderline') AND year = 1995 AND list_contains(metric_families, 'AF') AND public_data_status <> 'none'
AND (title ILIKE '%_u%d%' OR paper_title ILIKE '%_u%d%' OR coalesce(source_study_id, '') ILIKE '%_u%d%' OR coalesce(publication_pmid, '') ILIKE '%_u%d%' OR source ILIKE '%_u%d%' OR species ILIKE '%_u%d%' OR cell_type ILIKE '%_u%d%' OR coalesce(notes, '') ILIKE '%_u%d%')
ORDER BY year DESC, dataset_id LIMIT 200"""),
    "catalog_listing": _sql("SELECT dataset_id, year, array_to_string(organelles, ',') AS organelles FROM inc WHERE modality_family ILIKE '%asia%' AND comparator_class ILIKE '%treat%'"),
    "catalog_page_total": _sql("SELECT count(*) AS total FROM inc WHERE cell_type ILIKE '%mach%' AND list_contains(organelles, 'promo')"),
    "facet_counts": _sql(" UNION ALL ".join([
        _FACET.format("cell_type", "cell_type", ""), _FACET.format("modality", "modality", ""), _FACET.format("comparator_class", "comparator_class", " WHERE trim(coalesce(comparator_class, '')) <> ''"),
        _FACET.format("organelle", "unnest(organelles)", ""), _FACET.format("metric_family", "unnest(metric_families)", "")])),
    "commonalities_top5": _sql(" UNION ALL ".join(_TOP.format(a, b) for a, b in (
        ("organelle", "unnest(organelles)"), ("organelle_pair", "unnest(organelle_pairs)"), ("metric_family", "unnest(metric_families)"), ("modality", "modality"), ("cell_type", "cell_type")))),
    "cross_tab_cells": _sql(f"SELECT row_value, col_value, count(*) AS n FROM ({_TAB}) GROUP BY ALL"),
    "cross_tab_margins": _sql(f"""SELECT row_value, '*' AS col_value, count(*) AS n FROM ({_TAB}) GROUP BY ALL
UNION ALL SELECT '*', col_value, count(*) FROM ({_TAB}) GROUP BY ALL UNION ALL SELECT '*', '*', count(*) FROM ({_TAB})"""),
    "frontier_points": _sql("SELECT dataset_id, lateral_resolution_nm AS x, sample_size AS y, modality_family AS family, year FROM inc WHERE lateral_resolution_nm IS NOT NULL AND sample_size IS NOT NULL"),
    "toolkit_matrix": _sql("SELECT organelle, modality_family, count(*) AS n FROM (SELECT unnest(organelles) AS organelle, modality_family FROM inc) GROUP BY ALL"),
    "measurement_grammar": _sql("SELECT organelle, metric_family, count(*) AS n FROM (SELECT o.x AS organelle, m.x AS metric_family FROM inc, unnest(organelles) AS o(x), unnest(metric_families) AS m(x)) GROUP BY ALL"),
    "grammar_diversity": _sql("SELECT organelle, CAST(count(*) AS BIGINT) AS total, count(DISTINCT metric_family) AS diversity FROM (SELECT o.x AS organelle, m.x AS metric_family FROM inc, unnest(organelles) AS o(x), unnest(metric_families) AS m(x)) GROUP BY ALL"),
    "reusability_map": _sql("""SELECT *, n_complete + n_partial AS reusable, round((n_complete + n_partial) / total, 3) AS share FROM (
SELECT organelle, count(*) FILTER (WHERE s = 'complete') AS n_complete, count(*) FILTER (WHERE s = 'partial') AS n_partial, count(*) FILTER (WHERE s = 'none') AS n_none, count(*) AS total
FROM (SELECT unnest(organelles) AS organelle, public_data_status AS s FROM inc) GROUP BY organelle)"""),
    "reusable_traits": _sql("""SELECT organelle, string_agg(DISTINCT modality_family, ',' ORDER BY modality_family) AS modality_families, string_agg(DISTINCT metric, ',' ORDER BY metric) AS metric_families
FROM (SELECT o.x AS organelle, m.x AS metric, modality_family FROM inc, unnest(organelles) AS o(x), unnest(metric_families) AS m(x) WHERE public_data_status <> 'none') GROUP BY organelle"""),
    "coverage_atlas": _sql("SELECT cell_type, organelle, count(*) AS n FROM (SELECT cell_type, unnest(organelles) AS organelle FROM inc) GROUP BY ALL"),
    "coverage_totals": _sql("""SELECT cell_type, count(*) AS records, string_agg(DISTINCT species, ',' ORDER BY species) AS species,
(SELECT count(DISTINCT o) FROM (SELECT unnest(organelles) AS o FROM inc i WHERE i.cell_type = inc.cell_type)) AS diversity FROM inc GROUP BY cell_type"""),
    "timeline": _sql("""SELECT year, count(*) AS records, count(*) FILTER (WHERE public_data_status <> 'none') AS public_records,
(SELECT count(DISTINCT o) FROM (SELECT unnest(organelles) AS o FROM inc i WHERE i.year = inc.year)) AS distinct_organelles,
(SELECT count(DISTINCT o) FROM (SELECT unnest(metric_families) AS o FROM inc i WHERE i.year = inc.year)) AS distinct_metrics FROM inc GROUP BY year"""),
    "timeline_families": _sql("SELECT year, modality_family, count(*) AS n FROM inc GROUP BY ALL"),
    "benchmark_stats": _sql("SELECT modality_family, count(*) AS records, " + ", ".join(
        f"count({c}) AS {n}_n, CAST(min({c}) AS DOUBLE) AS {n}_min, CAST(max({c}) AS DOUBLE) AS {n}_max, CAST(quantile_disc({c}, 0.5) AS DOUBLE) AS {n}_median, round(avg({c}), 1) AS {n}_mean"
        for c, n in (("lateral_resolution_nm", "resolution"), ("sample_size", "sample"))) + " FROM catalog WHERE included_status IN ('included', 'borderline') GROUP BY modality_family"),
    "benchmark_upper_median": _sql("SELECT modality_family, (list_sort(list(sample_size)))[count(sample_size) // 2 + 1] AS upper_median FROM catalog WHERE sample_size IS NOT NULL GROUP BY modality_family"),
    "similar_records": _sql(f"""SELECT inc.dataset_id, CAST(CASE WHEN inc.cell_type = t.cell_type THEN 40 ELSE 0 END + CASE WHEN inc.species = t.species THEN 10 ELSE 0 END + CASE WHEN inc.modality_family = t.modality_family THEN 10 ELSE 0 END
+ 5 * len(list_intersect(inc.organelles, t.organelles)) + 5 * len(list_intersect(inc.metric_families, t.metric_families)) AS INT) AS similarity_score, inc.year
FROM inc, (SELECT * FROM catalog WHERE dataset_id = '{TARGET}') t WHERE inc.dataset_id <> t.dataset_id ORDER BY similarity_score DESC, inc.year DESC, inc.dataset_id LIMIT 4"""),
    "compare_pairs": _sql("""
, g AS (SELECT *, CAST(floor(CAST(substr(dataset_id, 5) AS BIGINT) / 3) AS BIGINT) AS group_id FROM catalog),
x AS (SELECT group_id, list_sort(list_distinct(list_reduce(list(organelles), lambda a, b: list_intersect(a, b)))) AS so, list_sort(list_distinct(list_reduce(list(organelle_pairs), lambda a, b: list_intersect(a, b)))) AS sp,
  list_sort(list_distinct(list_reduce(list(metric_families), lambda a, b: list_intersect(a, b)))) AS sm, string_agg(DISTINCT modality, ',' ORDER BY modality) AS modalities,
  string_agg(DISTINCT sample_size_bucket, ',' ORDER BY sample_size_bucket) AS sample_size_buckets, string_agg(DISTINCT public_data_status, ',' ORDER BY public_data_status) AS public_data_statuses,
  string_agg(DISTINCT whole_cell_boundary_confirmed, ',' ORDER BY whole_cell_boundary_confirmed) AS boundary_confirmation,
  list_distinct(list(cell_type)) AS cts, list_distinct(list(species)) AS sps, list_distinct(list_filter(list(comparator_class), lambda c: c IS NOT NULL)) AS cms, list_distinct(list(modality_family)) AS mfs,
  count(DISTINCT cell_type) = 1 AS c1, count(DISTINCT species) = 1 AS c2, count(DISTINCT modality_family) = 1 AS c3, count(DISTINCT comparator_class) = 1 AS c4, min(metadata_completeness_score) >= 0.8 AS c5 FROM g GROUP BY group_id),
s AS (SELECT *, CAST(least(100, 25 * c1::INT + 10 * c2::INT + least(20, 5 * len(sp)) + least(15, 3 * len(sm)) + 10 * c3::INT + 10 * c4::INT + 10 * c5::INT) AS INT) AS comparability_score FROM x)
SELECT group_id, CASE WHEN len(cts) = 1 THEN cts[1] ELSE '' END AS shared_cell_types, CASE WHEN len(sps) = 1 THEN sps[1] ELSE '' END AS shared_species,
CASE WHEN len(cms) = 1 THEN cms[1] ELSE '' END AS shared_comparator_classes, CASE WHEN len(mfs) = 1 THEN mfs[1] ELSE '' END AS shared_modality_families, boundary_confirmation,
CASE WHEN comparability_score >= 75 THEN 'High biological overlap with enough shared structure to justify direct comparison.' WHEN comparability_score >= 50 THEN 'Moderate comparability; useful for targeted comparison with technical caveats.'
ELSE 'Low direct comparability; treat these datasets as analogs rather than close matches.' END AS summary, array_to_string(so, ',') AS shared_organelles, array_to_string(sp, ',') AS shared_organelle_pairs, array_to_string(sm, ',') AS shared_metric_families, modalities, sample_size_buckets, public_data_statuses,
comparability_score, CASE WHEN comparability_score >= 75 THEN 'high' WHEN comparability_score >= 50 THEN 'moderate' ELSE 'low' END AS band FROM s"""),
    "plan_status": _plan("""SELECT *, CASE status WHEN 'frontier' THEN 'No records in the current corpus capture this organelle target.'
  WHEN 'high-risk' THEN matched || ' matching records exist in the current corpus, but none meet the active threshold filters.'
  WHEN 'challenging' THEN 'Only ' || meeting || ' records in the current corpus meet the active threshold filters for this target.'
  ELSE meeting || ' records in the current corpus meet the active filters for this target.' END AS status_message,
'In the current corpus, ' || top_modality || ' is the most common modality for this target (' || matched || ' matching records).' AS modality_recommendation, 'promo & economy' AS biological_target,
(SELECT string_agg(dataset_id, ',' ORDER BY year DESC, dataset_id) FROM (SELECT dataset_id, year FROM m WHERE public_data_status <> 'none' ORDER BY year DESC, dataset_id LIMIT 3)) AS suggested_baselines FROM (SELECT count(*) AS matched, count(*) FILTER (WHERE strict) AS meeting,
CASE WHEN count(*) = 0 THEN 'frontier' WHEN count(*) FILTER (WHERE strict) = 0 THEN 'high-risk' WHEN count(*) FILTER (WHERE strict) < 3 THEN 'challenging' ELSE 'feasible' END AS status,
(SELECT modality FROM m GROUP BY modality ORDER BY count(*) DESC, min((-year, dataset_id)) LIMIT 1) AS top_modality,
(SELECT string_agg(v, ',' ORDER BY k) FROM (SELECT v, row_number() OVER (ORDER BY count(*) DESC, min((-year, dataset_id, i))) AS k FROM (SELECT year, dataset_id, i, metric_families[i] AS v FROM m, unnest(range(1, len(metric_families) + 1)) AS t(i)) GROUP BY v ORDER BY k LIMIT 3)) AS standard_metrics FROM m)"""),
    "plan_precedents": _plan("SELECT dataset_id, year, sample_size FROM pre ORDER BY coalesce(nullif(sample_size, 0), -1) DESC, year DESC, dataset_id"),
    "plan_precedents_by_author": _plan("SELECT dataset_id, source_study_id FROM pre ORDER BY lower(split_part(trim(regexp_replace(source_study_id, 'et al\\.?', '')), ' ', 1)), year DESC, dataset_id"),
    "plan_precedents_by_resolution": _plan("SELECT dataset_id, lateral_resolution_nm FROM pre ORDER BY lateral_resolution_nm ASC NULLS LAST, year DESC, dataset_id"),
    "plan_precedents_public_first": _plan("SELECT dataset_id, public_data_status FROM pre ORDER BY CASE public_data_status WHEN 'complete' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END DESC, year DESC, dataset_id"),
    "ids_in_request_order": _sql("SELECT CAST(i - 1 AS INT) AS pos, dataset_id, year FROM catalog JOIN (SELECT ids[i] AS dataset_id, i FROM (SELECT [" + ", ".join(f"'{w}'" for w in WANTED) + "] AS ids), unnest(range(1, 6)) AS t(i)) USING (dataset_id)"),
    "organelle_pairs": _sql("SELECT dataset_id, array_to_string(organelle_pairs, ',') AS pairs, sample_size_bucket, metadata_completeness_score FROM catalog"),
    "bibtex": _sql("""SELECT dataset_id, '@article{' || replace(dataset_id, '-', '') || ',' || chr(10) || '  title = {' || paper_title || '},' || chr(10) || '  author = {' || source_study_id || '},' || chr(10)
|| '  journal = {' || source || '},' || chr(10) || '  year = {' || year || '},' || chr(10) || coalesce('  pmid = {' || publication_pmid || '},' || chr(10), '') || '  note = {Indexed record: ' || title || '}' || chr(10) || '}' || chr(10) AS entry FROM inc"""),
    "csv_rows": _sql("""SELECT dataset_id, title, paper_title, coalesce(source_study_id, '') AS study, coalesce(publication_pmid, '') AS pmid, year, source AS journal, species, cell_type, modality, lateral_resolution_nm AS res_xy_nm, axial_resolution_nm AS res_z_nm,
array_to_string(organelles, '; ') AS organelles, array_to_string(metric_families, '; ') AS metrics, public_data_status, included_status, coalesce(source_publication_url, '') AS publication_url, array_to_string(public_locator_urls, '; ') AS public_data_urls, coalesce(notes, '') AS notes FROM inc"""),
    "precedent_csv_rows": _plan("""SELECT dataset_id, coalesce(source_study_id, '') AS study, coalesce(publication_pmid, '') AS pmid, paper_title, year, source AS journal, cell_type, species, modality, modality_family, lateral_resolution_nm AS res_xy_nm, axial_resolution_nm AS res_z_nm, sample_size,
array_to_string(organelles, '; ') AS organelles, array_to_string(metric_families, '; ') AS metrics, coalesce(comparator_class, '') AS comparator_class, coalesce(comparator_detail, '') AS comparator_detail, public_data_status, coalesce(source_publication_url, '') AS publication_url FROM pre"""),
    "repeated_studies": _sql("SELECT CAST(floor(CAST(substr(dataset_id, 5) AS BIGINT) / 500) AS BIGINT) AS group_id, source_study_id AS study, count(*) AS n FROM catalog GROUP BY ALL HAVING count(*) > 1"),
    "precedent_text": _sql("""SELECT dataset_id, comparator_detail FROM catalog WHERE contains(lower(concat_ws(' ', dataset_id, coalesce(source_study_id, ''), coalesce(publication_pmid, ''), paper_title, source, cell_type, species, modality, coalesce(comparator_class, ''), coalesce(comparator_detail, ''),
array_to_string(organelles, ' '), array_to_string(metric_families, ' '))), 'stain protocol 7')"""),
    "precedent_state": _sql("SELECT public_data_status, count(*) AS n FROM catalog WHERE public_data_status <> 'none' GROUP BY ALL"),
    "handoff_fingerprint": _sql("""SELECT dataset_id, sha256(array_to_string(list_concat([dataset_id, title, paper_title, CAST(year AS VARCHAR), coalesce(source_study_id, ''), coalesce(publication_pmid, ''), coalesce(source_publication_url, ''), public_data_status], list_sort(list_transform(public_locator_urls, lambda u: trim(u)))), chr(10))) AS fingerprint FROM catalog"""),
}

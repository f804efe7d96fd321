"""Catalog analytics (A1-A13, A25, O1-O5, F12, F22, R20-R22, X20-X22): long-form results, one scan of the filtered catalog each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import STATUSES, FilterSpec, condition, overlaps

DIMENSIONS = (
    "dataset_id", "title", "paper_title", "year", "source", "public_data_status", "species", "cell_type", "comparator_class", "modality", "modality_family",
    "sample_size_bucket", "included_status", "organelles", "organelle_pairs", "metric_families",
)
ARRAYS = ("organelles", "organelle_pairs", "metric_families")


def canonical_order() -> list[Column]:
    return [F.desc("year"), F.asc("dataset_id")]


def search(catalog: DataFrame, spec: FilterSpec, limit: int = 200) -> DataFrame:
    """O2: the first records in canonical order; limit 1 to 500."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    return catalog.where(condition(spec)).orderBy(*canonical_order()).limit(limit)


def listing(catalog: DataFrame, spec: FilterSpec, limit: int | None = None) -> DataFrame:
    """As search, unlimited unless a limit is given."""
    rows = catalog.where(condition(spec)).orderBy(*canonical_order())
    return rows if limit is None else rows.limit(limit)


def total(catalog: DataFrame, spec: FilterSpec) -> DataFrame:
    """The number of matching records, counted apart from the page so that no window gathers all rows."""
    return catalog.where(condition(spec)).agg(F.count("*").alias("total"))


def in_request_order(catalog: DataFrame, ids: Sequence[str]) -> DataFrame:
    """records of the ids in the request's order; unknown ids drop out, repeated ids repeat."""
    spark = catalog.sparkSession
    wanted = spark.range(1).select(F.posexplode(F.array(*[F.lit(i) for i in ids]).cast("array<string>")).alias("pos", "dataset_id"))
    return catalog.join(F.broadcast(wanted), "dataset_id").orderBy("pos")


def _values(**columns: Column) -> Column:
    """Exploded (name, value) pairs of a record: scalars once (null dropped), arrays for each element. All names are counted in one pass."""
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    each = lambda name, c: F.transform(c, lambda v: pair(name, v))
    scalar = lambda name, c: F.array_compact(F.array(F.when(c.isNotNull(), pair(name, c))))
    return F.explode(F.concat(*[(each if name in ("organelle", "organelle_pair", "metric_family") else scalar)(name, c) for name, c in columns.items()])).alias("x")


def facets(catalog: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """A1: counts of cell type, modality, comparator (blank dropped), organelle and metric family, from one scan."""
    rows = catalog.where(condition(spec or FilterSpec()))
    known = F.when(F.trim(F.coalesce("comparator_class", F.lit(""))) != "", F.col("comparator_class"))
    pairs = _values(cell_type=F.col("cell_type"), modality=F.col("modality"), comparator_class=known, organelle=F.col("organelles"), metric_family=F.col("metric_families"))
    return rows.select(pairs).groupBy(F.col("x.name").alias("facet"), F.col("x.value").alias("value")).agg(F.count("*").alias("n"))


def commonalities(catalog: DataFrame, spec: FilterSpec, limit: int = 5) -> DataFrame:
    """A2: the most frequent values of five traits, from one scan; ties by value."""
    pairs = _values(organelle=F.col("organelles"), organelle_pair=F.col("organelle_pairs"), metric_family=F.col("metric_families"), modality=F.col("modality"), cell_type=F.col("cell_type"))
    counts = catalog.where(condition(spec)).select(pairs).groupBy(F.col("x.name").alias("trait"), F.col("x.value").alias("value")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("trait").orderBy(F.desc("n"), F.asc("value")))
    return counts.withColumn("rank", rank).where(F.col("rank") <= limit)


def dimension(name: str) -> Column:
    """A cross-tab dimension: blank, null and empty arrays are 'none'; of arrays only the first element counts."""
    if name not in DIMENSIONS:
        raise ValueError(f"unknown dimension {name!r}")
    c = F.get(F.col(name), F.lit(0)) if name in ARRAYS else F.col(name).cast("string")
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("none"))


def cross_tab(catalog: DataFrame, row: str, col: str, include_borderline: bool = True) -> DataFrame:
    """A3: cells and both margins in one CUBE: row_value and col_value are null where summed over."""
    rows = catalog.where(condition(FilterSpec(include_borderline=include_borderline)))
    return rows.select(dimension(row).alias("row_value"), dimension(col).alias("col_value")).cube("row_value", "col_value").agg(F.count("*").alias("n"))


def frontier(catalog: DataFrame, spec: FilterSpec) -> DataFrame:
    """resolution against sample size where both are known."""
    rows = catalog.where(condition(spec) & F.col("lateral_resolution_nm").isNotNull() & F.col("sample_size").isNotNull())
    return rows.select("dataset_id", F.col("lateral_resolution_nm").alias("x"), F.col("sample_size").alias("y"), F.col("modality_family").alias("family"), "year").orderBy(*canonical_order())


def toolkit_matrix(catalog: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """A4: organelle by modality family."""
    rows = catalog.where(condition(spec or FilterSpec()))
    return rows.select(F.explode("organelles").alias("organelle"), "modality_family").groupBy("organelle", "modality_family").agg(F.count("*").alias("n"))


def grammar(catalog: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """A5: organelle by metric family (every combination within a record)."""
    rows = catalog.where(condition(spec or FilterSpec())).select(F.explode("organelles").alias("organelle"), "metric_families")
    return rows.select("organelle", F.explode("metric_families").alias("metric_family")).groupBy("organelle", "metric_family").agg(F.count("*").alias("n"))


def grammar_margins(catalog: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """Totals and number of different metrics by organelle."""
    return grammar(catalog, spec).groupBy("organelle").agg(F.sum("n").alias("total"), F.count("*").alias("diversity"))


def reusability(catalog: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """Records of each public status by organelle, reusable total and share."""
    rows = catalog.where(condition(spec or FilterSpec())).select(F.explode("organelles").alias("organelle"), "public_data_status")
    out = rows.groupBy("organelle").agg(*[F.count_if(F.col("public_data_status") == s).alias(f"n_{s}") for s in STATUSES], F.count("*").alias("total"))
    reusable = F.col("n_complete") + F.col("n_partial")
    return out.withColumn("reusable", reusable).withColumn("share", F.round(reusable / F.col("total"), 3))


def reusable_traits(catalog: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """Modality families and metrics of the public records by organelle; a family needs a record with a metric."""
    rows = catalog.where(condition(spec or FilterSpec()) & (F.col("public_data_status") != "none"))
    rows = rows.select(F.explode("organelles").alias("organelle"), "modality_family", "metric_families").select("organelle", "modality_family", F.explode("metric_families").alias("metric_family"))
    return rows.groupBy("organelle").agg(F.array_join(F.sort_array(F.collect_set("modality_family")), ",").alias("modality_families"), F.array_join(F.sort_array(F.collect_set("metric_family")), ",").alias("metric_families"))


def coverage(catalog: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """Cell type by organelle."""
    rows = catalog.where(condition(spec or FilterSpec()))
    return rows.select("cell_type", F.explode("organelles").alias("organelle")).groupBy("cell_type", "organelle").agg(F.count("*").alias("n"))


def coverage_totals(catalog: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """Records, species and organelle diversity by cell type, from one scan; cell types without organelles stay with 0."""
    rows = catalog.where(condition(spec or FilterSpec()))
    pairs = _values(species=F.coalesce("species", F.lit("")), organelle=F.col("organelles"))
    n = rows.select("cell_type", pairs).groupBy("cell_type", "x.name", "x.value").agg(F.count("*").alias("n"))
    kind = lambda k: F.col("name") == k
    return n.groupBy("cell_type").agg(
        F.sum(F.when(kind("species"), F.col("n"))).alias("records"), F.array_join(F.sort_array(F.collect_set(F.when(kind("species"), F.nullif(F.col("value"), F.lit(""))))), ",").alias("species"), F.count_if(kind("organelle")).alias("diversity")
    )


def timeline(catalog: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """Per year records, public records, different organelles and metrics (0 without any), from one scan."""
    rows = catalog.where(condition(spec or FilterSpec()))
    pairs = _values(record=F.when(F.col("public_data_status") != "none", "public").otherwise("other"), organelle=F.col("organelles"), metric_family=F.col("metric_families"))
    n = rows.select("year", pairs).groupBy("year", "x.name", "x.value").agg(F.count("*").alias("n"))
    kind = lambda k: F.col("name") == k
    public = F.sum(F.when(kind("record") & (F.col("value") == "public"), F.col("n")).otherwise(0))
    return n.groupBy("year").agg(F.sum(F.when(kind("record"), F.col("n"))).alias("records"), public.alias("public_records"), F.count_if(kind("organelle")).alias("distinct_organelles"), F.count_if(kind("metric_family")).alias("distinct_metrics"))


def timeline_families(catalog: DataFrame, spec: FilterSpec | None = None) -> DataFrame:
    """Year by modality family."""
    return catalog.where(condition(spec or FilterSpec())).groupBy("year", "modality_family").agg(F.count("*").alias("n"))


def values_at_ranks(rows: DataFrame, group: str, value: str, ranks: dict[str, tuple[float, Column]], accuracy: int = 10_000) -> DataFrame:
    """By group, the values at the given ranks, exact. ranks: name to (quantile, rank from 1 as a Column over n, the number of known values), at most two ranks apart.

    A sketch, off by n / accuracy ranks at most, gives two values that surely enclose each rank. A second scan counts what lies below
    them, and only what lies between is ranked; a group of few values is ranked as it is. If a rank is not enclosed after all, the query fails.
    """
    known = rows.where(F.col(value).isNotNull()).select(F.col(group).alias("_g"), F.col(value).alias("_v"))
    at = [max(0.0, q - 4 / accuracy) for q, _ in ranks.values()] + [min(1.0, q + 4 / accuracy) for q, _ in ranks.values()]
    sketch = known.groupBy("_g").agg(F.count("*").alias("n"), F.percentile_approx("_v", at, accuracy).alias("_at"))
    few = F.col("n") <= 2 * accuracy
    ends = [F.struct(F.lit(k).alias("name"), r.cast("bigint").alias("rank"), F.when(~few, F.get("_at", F.lit(i))).alias("lo"), F.when(~few, F.get("_at", F.lit(i + len(ranks)))).alias("hi")) for i, (k, (_, r)) in enumerate(ranks.items())]
    ends = sketch.select(F.col("_g").alias("_h"), F.array(*ends).alias("_ends"))
    each = known.join(F.broadcast(ends), F.col("_g").eqNullSafe(F.col("_h")))  # a row for each group
    # of values below only the number counts: they become null
    part = lambda e: F.struct(e["name"].alias("name"), e["rank"].alias("rank"), F.when(F.coalesce(F.col("_v") >= e["lo"], F.lit(True)), F.col("_v")).alias("v"))
    near = F.transform(F.filter("_ends", lambda e: F.coalesce(F.col("_v") <= e["hi"], F.lit(True))), part)
    counts = each.select("_g", F.explode(near).alias("x")).groupBy("_g", "x.name", "x.rank", "x.v").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("_g", "name").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reached = counts.withColumn("_upto", upto).where("_upto >= rank")
    found = reached.groupBy("_g", "name").agg(F.min_by(F.struct("v"), "_upto").alias("s"))
    enclosed = F.when(F.col("s.v").isNull(), F.raise_error(F.lit("a rank is not enclosed"))).otherwise(F.col("s.v"))
    return found.select(F.col("_g").alias(group), "name", enclosed.alias("v")).groupBy(group).agg(*[F.min(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in ranks])


def benchmarks(catalog: DataFrame, include_borderline: bool = True) -> DataFrame:
    """Count, extremes, discrete median and mean (one decimal) of two measures by modality family."""
    rows = catalog.where(condition(FilterSpec(include_borderline=include_borderline)))
    aggs = []
    measures = (("lateral_resolution_nm", "resolution"), ("sample_size", "sample"))
    for column, name in measures:
        aggs += [F.count(column).alias(f"{name}_n"), F.min(column).cast("double").alias(f"{name}_min"), F.max(column).cast("double").alias(f"{name}_max"), F.round(F.avg(column), 1).alias(f"{name}_mean")]
    out = rows.groupBy("modality_family").agg(F.count("*").alias("records"), *aggs)
    for column, name in measures:
        median = values_at_ranks(rows, "modality_family", column, {f"{name}_median": (0.5, F.ceil(F.col("n") / 2))})
        out = out.join(F.broadcast(median.withColumnRenamed("modality_family", "_family")), F.col("modality_family").eqNullSafe(F.col("_family")), "left").drop("_family").withColumn(f"{name}_median", F.col(f"{name}_median").cast("double"))  # a row for each family
    return out


def upper_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The upper middle value by group: the value of rank n / 2 + 1."""
    return values_at_ranks(rows, group, value, {"upper_median": (0.5, F.floor(F.col("n") / 2) + 1)})


def similar(catalog: DataFrame, target_id: str, limit: int = 4) -> DataFrame:
    """The included records most like the target: cell type 40, species 10, family 10, 5 for each shared trait."""
    target = catalog.where(F.col("dataset_id") == target_id).select(*[F.col(c).alias(f"t_{c}") for c in ("dataset_id", "cell_type", "species", "modality_family", "organelles", "metric_families")])
    same = lambda c, points: F.when(F.col(c) == F.col(f"t_{c}"), points).otherwise(0)
    shared = lambda c: 5 * F.size(F.array_intersect(c, f"t_{c}"))
    score = same("cell_type", 40) + same("species", 10) + same("modality_family", 10) + shared("organelles") + shared("metric_families")
    rows = catalog.where(F.col("included_status") == "included").crossJoin(F.broadcast(target.limit(1))).where(F.col("dataset_id") != F.col("t_dataset_id"))  # one target row
    return rows.withColumn("similarity_score", score).orderBy(F.desc("similarity_score"), F.desc("year"), F.asc("dataset_id")).limit(limit)


#: The summary of each band of comparability.
COMPARABILITY = {
    75: "High biological overlap with enough shared structure to justify direct comparison.",
    50: "Moderate comparability; useful for targeted comparison with technical caveats.",
    0: "Low direct comparability; treat these datasets as analogs rather than close matches.",
}


def compare(records: DataFrame) -> DataFrame:
    """Comparability of the records of each group_id, 2 to 8 records a group, in one aggregation.

    Traits of one value count as shared where the least known value is the greatest; counts of distinct values would copy each record, with its lists, once a trait.
    """
    g = records.withColumn("comparator_class", F.nullif("comparator_class", F.lit(""))).groupBy("group_id")
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    fields = {"organelles": "organelles", "organelle_pairs": "organelle_pairs", "metric_families": "metric_families"}
    out = g.agg(
        F.min("metadata_completeness_score").alias("least"),
        *[F.collect_list(c).alias(f"all_{c}") for c in fields.values()],
        joined("modality").alias("modalities"), joined("sample_size_bucket").alias("sample_size_buckets"), joined("public_data_status").alias("public_data_statuses"), joined("whole_cell_boundary_confirmed").alias("boundary_confirmation"),
        *[F.when(F.min(c) == F.max(c), F.min(c)).alias(f"shared_{c}") for c in ("cell_type", "species", "comparator_class", "modality_family")],
    )
    for c in fields.values():
        shared = F.aggregate(F.slice(f"all_{c}", 2, F.greatest(F.size(f"all_{c}"), F.lit(1))), F.get(F.col(f"all_{c}"), F.lit(0)), lambda acc, x: F.array_intersect(acc, x))
        out = out.withColumn(f"shared_{c}", F.array_sort(F.array_distinct(shared)))
    one = lambda c: F.col(f"shared_{c}").isNotNull()
    points = (
        F.when(one("cell_type"), 25).otherwise(0)
        + F.when(one("species"), 10).otherwise(0)
        + F.least(F.lit(20), 5 * F.size("shared_organelle_pairs"))
        + F.least(F.lit(15), 3 * F.size("shared_metric_families"))
        + F.when(one("modality_family"), 10).otherwise(0)
        + F.when(one("comparator_class"), 10).otherwise(0)
        + F.when(F.col("least") >= 0.8, 10).otherwise(0)
    )
    out = out.withColumn("comparability_score", F.least(F.lit(100), points))
    band = F.when(F.col("comparability_score") >= 75, "high").when(F.col("comparability_score") >= 50, "moderate").otherwise("low")
    summary = F.when(F.col("comparability_score") >= 75, COMPARABILITY[75]).when(F.col("comparability_score") >= 50, COMPARABILITY[50]).otherwise(COMPARABILITY[0])
    return out.select(
        "group_id", F.coalesce("shared_cell_type", F.lit("")).alias("shared_cell_types"), F.coalesce("shared_species", F.lit("")).alias("shared_species"),
        *[F.array_join(f"shared_{c}", ",").alias(f"shared_{c}") for c in fields.values()],
        F.coalesce("shared_comparator_class", F.lit("")).alias("shared_comparator_classes"), F.coalesce("shared_modality_family", F.lit("")).alias("shared_modality_families"),
        "modalities", "sample_size_buckets", "public_data_statuses", "boundary_confirmation", "comparability_score", band.alias("band"), summary.alias("summary"),
    )


def repeated_studies(records: DataFrame) -> DataFrame:
    """Studies of which a comparison (group_id) has more than one record, with their number; blank studies drop out."""
    study = F.nullif(F.trim("source_study_id"), F.lit(""))
    return records.where(study.isNotNull()).groupBy("group_id", study.alias("study")).agg(F.count("*").alias("n")).where("n > 1")


def plan_thresholds(resolution: float | None, sample: int | None) -> Column:
    """Within 1.5 times the resolution and at least half the sample; an unknown or zero resolution is 999, an unknown sample 0."""
    ok = F.lit(True)
    if resolution is not None:
        ok = ok & (F.coalesce(F.nullif(F.col("lateral_resolution_nm"), F.lit(0.0)), F.lit(999.0)) <= resolution * 1.5)
    if sample is not None:
        ok = ok & (F.coalesce("sample_size", F.lit(0)) >= sample * 0.5)
    return ok


def plan_status(catalog: DataFrame, organelles: Sequence[str], resolution: float | None, sample: int | None) -> DataFrame:
    """Counts, feasibility with its message, most frequent modality (ties: first in canonical order), the three most frequent metrics, and three baselines.

    Modalities and metrics, which are controlled words, are counted in one scan. Baselines are the first matching records with
    public data; they need no more than a top three.
    """
    base = catalog.where(condition(FilterSpec()) & overlaps("organelles", organelles))
    strict = plan_thresholds(resolution, sample)
    pair = lambda kind, value, p: F.struct(F.lit(kind).alias("kind"), value.alias("value"), p.alias("p"))
    pairs = F.concat(F.array(pair("modality", F.col("modality"), F.lit(0))), F.transform("metric_families", lambda m, i: pair("metric", m, i)))
    rows = base.select("year", "dataset_id", strict.alias("strict"), F.explode(pairs).alias("x"))
    counts = rows.groupBy("x.kind", "x.value").agg(F.count("*").alias("n"), F.count_if("strict").alias("m"), F.min(F.struct(-F.col("year"), F.col("dataset_id"), F.col("x.p"))).alias("first"))
    kind = lambda k: F.col("kind") == k
    place = F.struct(-F.col("n"), F.col("first"))
    out = counts.agg(
        F.coalesce(F.sum(F.when(kind("modality"), F.col("n"))), F.lit(0)).alias("matched"),
        F.coalesce(F.sum(F.when(kind("modality"), F.col("m"))), F.lit(0)).alias("meeting"),
        F.coalesce(F.min_by(F.when(kind("modality"), F.col("value")), F.when(kind("modality"), place)), F.lit("Unknown")).alias("top_modality"),
        F.slice(F.array_sort(F.collect_list(F.when(kind("metric"), F.struct(place.alias("place"), "value")))), 1, 3).alias("metrics"),
    )
    near = base.where("public_data_status <> 'none'").select("year", "dataset_id").orderBy(*canonical_order()).limit(3)
    near = near.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("year"), "dataset_id"))), lambda x: x["dataset_id"]), ",").alias("suggested_baselines"))
    n, m = F.col("matched").cast("string"), F.col("meeting").cast("string")
    # The wording of the messages
    messages = {
        "frontier": F.lit("No records in the current corpus capture this organelle target."),
        "high-risk": F.concat(n, F.lit(" matching records exist in the current corpus, but none meet the active threshold filters.")),
        "challenging": F.concat(F.lit("Only "), m, F.lit(" records in the current corpus meet the active threshold filters for this target.")),
        "feasible": F.concat(m, F.lit(" records in the current corpus meet the active filters for this target.")),
    }
    advice = F.concat(F.lit("In the current corpus, "), "top_modality", F.lit(" is the most common modality for this target ("), n, F.lit(" matching records)."))
    status = F.when(F.col("matched") == 0, "frontier").when(F.col("meeting") == 0, "high-risk").when(F.col("meeting") < 3, "challenging").otherwise("feasible")
    message = F.coalesce(*[F.when(F.col("status") == k, v) for k, v in messages.items()])
    out = out.withColumn("status", status).crossJoin(F.broadcast(near))  # one row each
    return out.select(
        F.lit(" & ".join(organelles)).alias("biological_target"), "matched", "meeting", "status", message.alias("status_message"), "top_modality", advice.alias("modality_recommendation"),
        F.array_join(F.transform("metrics", lambda x: x["value"]), ",").alias("standard_metrics"), "suggested_baselines",
    )


def plan_precedents(catalog: DataFrame, organelles: Sequence[str], resolution: float | None, sample: int | None) -> DataFrame:
    """Records that meet the thresholds, or all that match where none does."""
    base = catalog.where(condition(FilterSpec()) & overlaps("organelles", organelles)).withColumn("strict", plan_thresholds(resolution, sample))
    any_strict = base.agg(F.coalesce(F.bool_or("strict"), F.lit(False)).alias("any_strict"))
    return base.crossJoin(F.broadcast(any_strict)).where("strict or not any_strict").drop("strict", "any_strict")  # one row


def precedent_order(key: str = "year_desc") -> list[Column]:
    """O3: the six sort orders, each ending in the unique id."""
    year, ident = F.desc("year"), F.asc("dataset_id")
    author = F.lower(F.coalesce(F.nullif(F.get(F.split(F.trim(F.regexp_replace(F.coalesce("source_study_id", F.lit("")), "et al\\.?", "")), " "), F.lit(0)), F.lit("")), F.col("dataset_id")))
    public = F.when(F.col("public_data_status") == "complete", 2).when(F.col("public_data_status") == "partial", 1).otherwise(0)
    orders = {
        "year_desc": [year, ident],
        "year_asc": [F.asc("year"), ident],
        "author_asc": [author.asc(), year, ident],
        "sample_desc": [F.coalesce(F.nullif(F.col("sample_size"), F.lit(0)), F.lit(-1)).desc(), year, ident],
        "res_asc": [F.asc_nulls_last("lateral_resolution_nm"), year, ident],
        "public_first": [public.desc(), year, ident],
    }
    return orders.get(key, orders["year_desc"])


def bibtex(records: DataFrame) -> DataFrame:
    """K3: one @article entry per record."""
    line = lambda name, value: F.concat(F.lit(f"  {name} = {{"), value, F.lit("},\n"))
    entry = F.concat(
        F.lit("@article{"), F.replace(F.col("dataset_id"), F.lit("-"), F.lit("")), F.lit(",\n"),
        line("title", F.col("paper_title")), line("author", F.coalesce("source_study_id", "source")), line("journal", F.col("source")), line("year", F.col("year").cast("string")),
        F.coalesce(line("pmid", F.nullif(F.trim("publication_pmid"), F.lit(""))), F.lit("")), F.lit("  note = {Indexed record: "), F.col("title"), F.lit("}\n}\n"),
    )
    return records.select("dataset_id", entry.alias("entry"))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def csv_rows(records: DataFrame) -> DataFrame:
    """K1: the 19 export columns, arrays joined by '; ' and nulls of texts blank."""
    return records.select(
        "dataset_id", "title", "paper_title", _text("source_study_id").alias("study"), _text("publication_pmid").alias("pmid"), "year", F.col("source").alias("journal"), "species", "cell_type", "modality",
        F.col("lateral_resolution_nm").alias("res_xy_nm"), F.col("axial_resolution_nm").alias("res_z_nm"), F.array_join("organelles", "; ").alias("organelles"), F.array_join("metric_families", "; ").alias("metrics"),
        "public_data_status", "included_status", _text("source_publication_url").alias("publication_url"), F.array_join("public_locator_urls", "; ").alias("public_data_urls"), _text("notes").alias("notes"),
    )


def precedent_csv_rows(records: DataFrame) -> DataFrame:
    """K4: the 19 columns of a plan's precedents."""
    return records.select(
        "dataset_id", _text("source_study_id").alias("study"), _text("publication_pmid").alias("pmid"), "paper_title", "year", F.col("source").alias("journal"), "cell_type", "species", "modality", "modality_family",
        F.col("lateral_resolution_nm").alias("res_xy_nm"), F.col("axial_resolution_nm").alias("res_z_nm"), "sample_size", F.array_join("organelles", "; ").alias("organelles"), F.array_join("metric_families", "; ").alias("metrics"),
        _text("comparator_class").alias("comparator_class"), _text("comparator_detail").alias("comparator_detail"), "public_data_status", _text("source_publication_url").alias("publication_url"),
    )


def guarded(records: DataFrame, most: int) -> DataFrame:
    """K5: the records, or an error when they are more than an export may hold. Reads at most one row too many."""
    if records.limit(most + 1).count() > most:
        raise ValueError(f"export of more than {most} rows")
    return records


def locators() -> Column:
    """The record's public locators, trimmed, blank ones and repeats left out, in their order."""
    return F.array_distinct(F.filter(F.transform("public_locator_urls", lambda u: F.trim(u)), lambda u: u != ""))


def identity_fingerprint(urls: Column) -> Column:
    """SHA-256 of the newline-joined identity fields and sorted locators."""
    fields = ("dataset_id", "title", "paper_title", "year", "source_study_id", "publication_pmid", "source_publication_url", "public_data_status")
    return F.sha2(F.array_join(F.concat(F.array(*[_text(c) for c in fields]), F.array_sort(urls)), "\n"), 256)


def handoff_fingerprint(records: DataFrame) -> DataFrame:
    return records.select("dataset_id", identity_fingerprint(locators()).alias("fingerprint"))

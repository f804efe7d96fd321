"""Public-data rules (R1, R3, R14-R19, R23-R25, R30, A19-A20, A23-A24, T5-T7, X23, X35): record in, record out, all projections and joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from .catalog import identity_fingerprint, locators

VOLUME_FORMATS = ("MRC", "TIFF", "HDF5", "Zarr")
TRUSTED_SCALES = ("asset_api_details", "citation_details")
NO_TEXT = "array<string>"


# ---------------------------------------------------------------- catalog and scaffold


def build_catalog(locators: DataFrame, studies: DataFrame, public: DataFrame) -> DataFrame:
    """Typed catalog rows from the three all-string manifests; of rows that repeat a study the last one counts."""
    last = lambda df: df.groupBy("study_id").agg(F.max_by(F.struct(*[c for c in df.columns if c not in ("study_id", "pos")]), "pos").alias("r")).select("study_id", "r.*")
    study = last(studies.where("included_status = 'included'").select("study_id", "pos", "title", "pmid", "quantifications", "comparators_conditions"))
    asset = last(public.select("study_id", "pos", "availability_scope_note")).withColumn("has_asset", F.lit(True))
    j = locators.join(study, "study_id").join(asset, "study_id", "left")
    status = N.public_status(F.coalesce("has_asset", F.lit(False)), F.col("availability_scope_note"))
    organelles = N.split_terms(F.col("organelles_common"), F.col("organelles_specialized"))
    xy, z = N.mean_numeric(F.col("xy_nm")), N.mean_numeric(F.col("z_nm"))
    j = j.withColumns({"status": status, "org": organelles, "met": N.metric_families(F.col("quantifications")), "xy": xy, "z": z, "n": F.nullif(F.col("min_sample_size"), F.lit("")).cast("int")})
    return j.select(
        F.col("dataset_locator_id").alias("dataset_id"),
        F.concat("cell_type", F.lit(" whole-cell dataset ("), "imaging_modality", F.lit(")")).alias("title"),
        F.col("title").alias("paper_title"),
        F.col("year").cast("int").alias("year"),
        F.coalesce(F.nullif(F.col("journal_published"), F.lit("")), "study_id").alias("source"),
        F.col("status").alias("public_data_status"),
        N.species(F.col("cell_type"), F.col("organism_type")).alias("species"),
        F.trim("cell_type").alias("cell_type"),
        N.comparator_class(F.col("comparators_conditions")).alias("comparator_class"),
        F.nullif(F.trim(F.coalesce("comparators_conditions", F.lit(""))), F.lit("")).alias("comparator_detail"),
        F.col("imaging_modality").alias("modality"),
        N.modality_family(F.col("imaging_modality")).alias("modality_family"),
        F.col("xy").alias("lateral_resolution_nm"),
        F.col("z").alias("axial_resolution_nm"),
        N.isotropic(F.col("xy"), F.col("z")).alias("isotropic"),
        F.col("org").alias("organelles"),
        N.pairs(F.col("org")).alias("organelle_pairs"),
        F.col("met").alias("metric_families"),
        F.col("n").alias("sample_size"),
        N.sample_size_bucket(F.col("n")).alias("sample_size_bucket"),
        N.completeness(F.col("org"), F.col("met"), F.col("n"), F.col("xy"), F.col("z"), F.col("status")).alias("metadata_completeness_score"),
        N.notes(F.col("status"), F.col("sample_size_notes")).alias("notes"),
        "included_status",
        F.col("study_id").alias("source_study_id"),
        F.nullif(F.trim("pmid"), F.lit("")).alias("publication_pmid"),
        F.filter(F.transform(F.split(F.coalesce("public_locator_urls", F.lit("")), ";"), lambda u: F.trim(u)), lambda u: u != "").alias("public_locator_urls"),
    )


#: Fields that a record must have, and the defaults of fields that are absent.
REQUIRED = (
    "cell_type", "dataset_id", "metadata_completeness_score", "metric_families", "modality", "modality_family", "organelle_pairs", "organelles",
    "paper_title", "public_data_status", "source", "source_type", "species", "title", "whole_cell_boundary_confirmed", "year",
)
DEFAULTS = {"source_type": "repository", "public_data_status": "none", "modality_family": "other", "sample_size_bucket": "unknown", "whole_cell_boundary_confirmed": "unclear", "metadata_completeness_score": 0.0}
LISTS = ("organelles", "organelle_pairs", "metric_families")
PLAIN = (
    "title", "year", "source", "source_type", "public_data_status", "species", "cell_type", "tissue_or_system", "comparator_class", "comparator_detail", "modality", "modality_family",
    "lateral_resolution_nm", "axial_resolution_nm", "isotropic", "sample_size", "sample_size_bucket", "metadata_completeness_score", "whole_cell_boundary_confirmed", "notes",
)


def _falsy(name: str, kind: str) -> Column:
    """Null, empty text, empty list, false or zero; the text '0' is none of these."""
    c = F.col(name)
    if kind == "string":
        return F.coalesce(c, F.lit("")) == ""
    if kind.startswith("array"):
        return F.coalesce(F.size(c), F.lit(0)) <= 0
    return ~F.coalesce(c.cast("boolean"), F.lit(False)) if kind != "void" else F.lit(True)


def scaffold(raw: DataFrame) -> DataFrame:
    """Aliases and defaults, and one warning that names the record and its missing required fields in order. A null counts as an absent field."""
    kinds = dict(raw.dtypes)
    have = lambda c: F.col(c) if c in kinds else F.lit(None).cast("string")
    either = lambda a, b: F.coalesce(F.nullif(have(a).cast("string"), F.lit("")), have(b).cast("string")).alias(a)
    plain = [(F.coalesce(have(c), F.lit(DEFAULTS[c])) if c in DEFAULTS else have(c)).alias(c) for c in PLAIN]
    out = raw.select(either("dataset_id", "id"), either("paper_title", "publication_title"), *plain, *[F.coalesce(have(c) if c in kinds else F.lit(None), F.array().cast("array<string>")).alias(c) for c in LISTS])
    kinds = dict(out.dtypes)
    missing = F.array_compact(F.array(*[F.when(_falsy(c, kinds[c]), F.lit(c)) for c in REQUIRED]))
    about = F.concat(F.coalesce("dataset_id", F.lit("None")), F.lit(": Missing required fields: "), F.array_join(missing, ", "))
    return out.withColumn("warning", F.when(F.size(missing) > 0, about))


# ---------------------------------------------------------------- asset states


def z_spacing_warning(z_nm: Column) -> Column:
    """Suspicious outside 30 to 250 nm."""
    return F.when((z_nm != 0) & ((z_nm < 30) | (z_nm > 250)), F.concat(F.lit("trakem2_z_spacing_suspicious:"), z_nm.cast("int").cast("string"), F.lit("nm")))


def warnings() -> Column:
    """Warnings of an asset (columns format, nx, mx, cell_x, tiff_error, trakem2_z_nm, preview_warning)."""
    volume = F.col("format").isin(*VOLUME_FORMATS)
    default = (F.col("format") == "MRC") & (F.col("nx") == F.col("mx")) & (F.col("cell_x") == F.col("nx"))
    return F.array_compact(
        F.array(
            F.when(default, "mrc_header_physical_scale_likely_default"),
            F.when(F.col("tiff_error").isNotNull(), F.concat(F.lit("tiff_parse_warning:"), "tiff_error")),
            F.when(volume, z_spacing_warning(F.col("trakem2_z_nm"))),
            F.when(volume & F.col("preview_warning").isNotNull(), F.concat(F.lit("preview_warning:"), "preview_warning")),
        )
    )


def split_warnings(assets: DataFrame) -> DataFrame:
    """A default MRC scale is a note where the scale comes from a trusted source; all else blocks."""
    noted = lambda w: (w == "mrc_header_physical_scale_likely_default") & F.coalesce(F.col("scale_source"), F.lit("")).isin(*TRUSTED_SCALES)
    distinct = lambda c: F.array_sort(F.array_distinct(c))
    return assets.withColumn("blockers", distinct(F.filter("warnings", lambda w: ~noted(w)))).withColumn("review_notes", distinct(F.filter("warnings", noted)))


def asset_states(assets: DataFrame) -> DataFrame:
    """Validated, needs_review or not_applicable, from size, scale, preview and blockers."""
    volume = F.col("format").isin(*VOLUME_FORMATS)
    sized = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    good = sized & F.col("scale_nm").isNotNull() & F.col("preview").isNotNull() & (F.size("blockers") == 0)
    return assets.withColumn("state", F.when(~volume, "not_applicable").when(good, "validated").otherwise("needs_review"))


def conversion(assets: DataFrame) -> DataFrame:
    """Sidecar, ready, ready_with_review_notes or blocked, with all blockers."""
    sized = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    extra = F.array_compact(F.array(F.when(~sized, "missing_volume_dimensions"), F.when(F.col("scale_nm").isNull(), "missing_physical_voxel_size"), F.when(F.col("preview").isNull(), "missing_preview")))
    all_blockers = F.array_sort(F.array_distinct(F.concat("blockers", extra)))
    out = assets.withColumn("conversion_blockers", F.when(F.col("state") == "not_applicable", F.array().cast(NO_TEXT)).otherwise(all_blockers))
    readiness = (
        F.when(F.col("state") == "not_applicable", "not_a_volume")
        .when(F.size("conversion_blockers") > 0, "blocked")
        .when(F.size("review_notes") > 0, "ready_with_review_notes")
        .otherwise("ready_for_conversion_trial")
    )
    return out.withColumn("readiness", readiness)


def conversion_totals(assets: DataFrame) -> DataFrame:
    """Assets and GiB (3 decimals) that are ready, blocked and sidecar."""
    kind = F.when(F.col("readiness") == "not_a_volume", "sidecar").when(F.col("readiness") == "blocked", "blocked").otherwise("ready")
    return assets.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("size_bytes") / F.lit(float(1024**3)), 3).alias("gib"))


def imageset_warnings(files: DataFrame) -> DataFrame:
    """Image sets whose reported number of images differs from the sum of the depths that are known; one file and many are worded apart."""
    g = files.where("coalesce(api_name, '') <> ''").groupBy("api_name").agg(
        F.min_by("expected", "pos").alias("expected"), F.sum("depth").alias("total"), F.count("depth").alias("known"), F.count("*").alias("n"), F.min_by("relative_path", "pos").alias("path")
    )
    many = F.format_string("%s: API reports %s images for an imageset spanning %s local files with %s total slices; treat API count as collection-level metadata.", "api_name", "expected", "n", "total")
    one = F.format_string("%s: API reports %s images but local file has %s slices.", "path", "expected", "total")
    return g.where("expected is not null and known > 0 and total <> expected").select("api_name", F.when(F.col("n") > 1, many).otherwise(one).alias("warning"))


def tiff_series(assets: DataFrame, least: int = 2) -> DataFrame:
    """Single planes of one directory, name and size as ordered series of at least `least` planes."""
    name = F.regexp_replace(F.substring_index("relative_path", "/", -1), "(?i)\\.tiff?$", "")
    part = lambda i: F.regexp_extract(name, "^(.*?)(\\d+)([^0-9]*)$", i)
    rows = assets.where((F.col("format") == "TIFF") & (F.col("z") == 1) & (F.col("x") > 0) & (F.col("y") > 0) & F.rlike("relative_path", F.lit("(?i)\\.tiff?$")) & F.rlike(name, F.lit("\\d")))
    directory = F.when(F.contains("relative_path", F.lit("/")), F.regexp_replace("relative_path", "/[^/]*$", "")).otherwise(F.lit(""))
    rows = rows.select("relative_path", "size_bytes", "x", "y", directory.alias("directory"), part(1).alias("prefix"), part(2).alias("place"), part(3).alias("suffix"))
    g = rows.groupBy("directory", "prefix", "suffix", "x", "y").agg(
        F.count("*").alias("planes"), F.sum("size_bytes").alias("bytes"),
        F.min(F.struct(F.col("place").cast("decimal(38,0)").alias("i"), "relative_path", "place")).alias("first"), F.max(F.struct(F.col("place").cast("decimal(38,0)").alias("i"), "relative_path", "place")).alias("last"),
    )
    source = F.concat(F.when(F.col("directory") != "", F.concat("directory", F.lit("/"))).otherwise(F.lit("")), "prefix", "first.place", F.lit("-"), "last.place", "suffix", F.lit(".tiff-series"))
    return g.where(F.col("planes") >= least).select(source.alias("source_path"), "planes", "bytes", F.col("first.relative_path").alias("first_asset"), F.col("last.relative_path").alias("last_asset"))


# ---------------------------------------------------------------- advisories

_SCALES = ("validated_volume.warnings", "physical_voxel_size_nm", "header_voxel_size_nm")
_OWN_SCALES = ("validated_volume.physical_voxel_size_nm", "validated_volume.header_voxel_size_nm")
_SIZE = ("validated_volume.dimensions", "derived_advisory_code")

#: Code of an asset, whether more follows it after a colon, category, severity, summary, impact, recommended action, fields of the evidence.
ASSET_RULES = (
    ("mrc_header_physical_scale_likely_default", False, "physical_scale", "review", "Raw MRC header physical scale appears default-like.",
     "Users reading the raw MRC header may recover a voxel size that conflicts with curated repository or paper metadata.",
     "Use the curated physical scale recorded in the catalog and verify voxel size against repository or paper methods before quantitative measurement.", _SCALES),
    ("trakem2_z_spacing_suspicious", True, "physical_scale", "warning", "Parsed TrakEM2 z-spacing is outside the expected serial-section range.",
     "Quantitative measurements that depend on section thickness may be misleading until the sidecar calibration is reviewed.",
     "Inspect the paired TrakEM2 XML and paper methods before treating z-spacing as validated.", _SCALES),
    ("missing_physical_voxel_size", False, "physical_scale", "warning", "No physical voxel size is available from the checked metadata sources.",
     "The volume can be inspected visually, but should not be used for physical measurement without external calibration.",
     "Find an authoritative voxel-size source before quantitative reuse.", _OWN_SCALES),
    ("missing_volume_dimensions", False, "volume_geometry", "warning", "Volume dimensions could not be validated from available metadata.",
     "Users may not be able to confirm axis size or stack depth without opening the source asset manually.",
     "Verify volume dimensions from a trusted reader before downstream analysis.", _SIZE),
    ("tiff_parse_warning", True, "file_readability", "warning", "TIFF metadata parsing produced a warning.",
     "Some readers may disagree about dimensions, planes, or calibration for this asset.",
     "Open the TIFF with an independent scientific image reader before quantitative reuse.", ("validated_volume.warnings",)),
)

#: What a report's warning says, with the asset as its first group, then code, category, severity, summary, impact, recommended action.
REPORT_RULES = (
    ("()collection-level metadata", "collection_level_image_count", "repository_metadata", "info", "Repository image count appears to describe a collection rather than one local file.",
     "Users should not interpret the reported image count as the slice count for each individual asset.",
     "Treat the repository image count as collection-level context and use validated local file dimensions for per-volume work."),
    (r"^(.+): API reports \d+ images but local file has \d+ slices\.$", "image_count_mismatch", "repository_metadata", "warning", "Repository image count does not match the parsed local slice count.",
     "Users may misread the expected stack depth if they rely on repository metadata alone.",
     "Use parsed local dimensions for stack navigation and verify count semantics in the repository record."),
    (r"^(.+): Figshare expected \d+ bytes but local file has \d+ bytes\.$", "figshare_size_mismatch", "file_integrity", "critical", "Local file size does not match Figshare metadata.",
     "The mirrored file may be incomplete or stale and should not be trusted for analysis.",
     "Re-download the asset and compare against Figshare's current metadata before reuse."),
    (r"^(.+): Figshare MD5 mismatch\.$", "figshare_md5_mismatch", "file_integrity", "critical", "Local checksum does not match Figshare metadata.",
     "The mirrored file may be corrupted or may not match the repository asset.",
     "Re-download the asset and verify checksum before reuse."),
    (r"^(.+): MRC MAP marker missing or unexpected\.$", "mrc_map_marker_unexpected", "file_format", "warning", "MRC header marker is missing or unexpected.",
     "Some MRC readers may reject this file or interpret it inconsistently.",
     "Open the asset with an independent MRC reader before quantitative reuse."),
)

#: Parts of a report's warnings that the assets' own codes tell better.
TOLD_BY_ASSETS = ("header physical scale is likely default", "trakem2_z_spacing_suspicious", "no physical voxel size found")
DATASET = ("dataset_source", "entry_id", "dataset_slug")
FINDING = (*DATASET, "finding_id", "asset_relative_path", "severity", "category", "code", "summary", "impact", "recommended_action", "evidence", "public_notice_candidate", "review_status")


def _rule(names: Sequence[str], values: Sequence) -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values, strict=True)])


def _finding(rows: DataFrame) -> DataFrame:
    """Adds the five-part id and the state in which a finding begins."""
    part = lambda c, other: F.coalesce(F.nullif(F.substring(N.slug(F.coalesce(c, F.lit(""))), 1, 80), F.lit("")), F.lit(other))
    blank = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    ident = (blank("dataset_source", F.lit("source")), blank("entry_id", F.col("dataset_slug")), F.col("category"), blank("asset_relative_path", F.lit("dataset")), F.col("code"))
    rows = rows.withColumns({"finding_id": F.concat_ws("-", *[part(c, "dataset") for c in ident]), "public_notice_candidate": F.lit(True), "review_status": F.lit("needs_human_review")})
    return rows.select(*FINDING)


def asset_findings(assets: DataFrame) -> DataFrame:
    """A finding for each different code of an asset (warnings, blockers, review_notes, and of a volume its missing size or scale) that a rule names.

    Columns: dataset_source, entry_id, dataset_slug, relative_path, state, warnings, blockers, review_notes, x, y, z, scale_nm, and header_scale_nm if it is known.
    """
    header = F.col("header_scale_nm") if "header_scale_nm" in assets.columns else F.lit(None).cast("double")
    volume = F.col("state") != "not_applicable"
    sized = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    derived = F.array_compact(F.array(F.when(volume & ~sized, "missing_volume_dimensions"), F.when(volume & F.col("scale_nm").isNull(), "missing_physical_voxel_size")))
    none = F.array().cast(NO_TEXT)
    said = F.filter(F.array_distinct(F.concat(*[F.coalesce(c, none) for c in ("warnings", "blockers", "review_notes")], derived)), lambda c: c != "")
    json = lambda *c: F.coalesce(F.to_json(F.struct(*c)), F.lit("{}"))
    value = {
        "validated_volume.warnings": F.col("said"), "derived_advisory_code": F.col("said"), "validated_volume.dimensions": json("x", "y", "z"),
        **dict.fromkeys(("physical_voxel_size_nm", _OWN_SCALES[0]), json(F.col("scale_nm").alias("nm"))), **dict.fromkeys(("header_voxel_size_nm", _OWN_SCALES[1]), json(header.alias("nm"))),
    }
    names = ("code", "category", "severity", "summary", "impact", "recommended_action")
    rules = []
    for code, more, *texts, fields in ASSET_RULES:
        hit = F.startswith("said", F.lit(code + ":")) if more else F.col("said") == code
        evidence = F.array(*[F.struct(F.lit("asset-state-manifest").alias("source"), F.lit(f).alias("field"), value[f].alias("value")) for f in fields])
        rules.append(F.when(hit, F.struct(_rule(names, (code, *texts)).alias("r"), evidence.alias("evidence"))))
    rows = assets.select(*DATASET, F.col("relative_path").alias("asset_relative_path"), "x", "y", "z", "scale_nm", *(["header_scale_nm"] if "header_scale_nm" in assets.columns else []), F.explode(said).alias("said"))
    rows = rows.withColumn("hit", F.coalesce(*rules)).where("hit is not null")
    return _finding(rows.select(*DATASET, "asset_relative_path", "hit.r.*", "hit.evidence"))


def report_findings(report: DataFrame) -> DataFrame:
    """A finding for each warning of a validation report (dataset_source, entry_id, dataset_slug, warning) that a rule reads; the asset is taken from the text."""
    names = ("code", "category", "severity", "summary", "impact", "recommended_action")
    told = F.lit(False)
    for text in TOLD_BY_ASSETS:
        told = told | F.contains("warning", F.lit(text))
    rules = [F.when(F.rlike("warning", F.lit(pattern)), F.struct(F.regexp_extract("warning", pattern, 1).alias("asset"), _rule(names, texts).alias("r"))) for pattern, *texts in REPORT_RULES]
    rows = report.where(~told).withColumn("hit", F.coalesce(*rules)).where("hit is not null")
    evidence = F.array(F.struct(F.lit("validation-report").alias("source"), F.lit("warnings").alias("field"), F.col("warning").alias("value")))
    return _finding(rows.select(*DATASET, F.col("hit.asset").alias("asset_relative_path"), "hit.r.*", evidence.alias("evidence")))


def findings(assets: DataFrame, report: DataFrame) -> DataFrame:
    """The findings of a dataset's assets, and those of its validation report whose (asset, code) no asset has."""
    own = asset_findings(assets)
    key = ["dataset_slug", "asset_relative_path", "code"]
    return own.unionByName(report_findings(report).join(own.select(*key).distinct(), key, "left_anti").select(*FINDING))


def advisory_summary(rows: DataFrame) -> DataFrame:
    """Findings by severity, category and review status in long form."""
    return rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).alias("name")) for c in ("severity", "category", "review_status")])).alias("x")).select("x.*").groupBy("by", "name").agg(F.count("*").alias("n"))


def review(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decided statuses replace those of their findings (the last decision of a finding counts)."""
    last = decisions.groupBy("finding_id").agg(F.max_by("decision", "pos").alias("decision"))
    return rows.join(last, "finding_id", "left").withColumn("review_status", F.coalesce("decision", "review_status")).drop("decision")


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """T5: rows of new, and rows of old whose key new has not."""
    return old.join(new.select(*key), list(key), "left_anti").unionByName(new)


def replace_scope(old: DataFrame, new: DataFrame, scope: str, order: str, most: int) -> DataFrame:
    """New rows and the old rows outside their scopes, the most recent `most`."""
    return old.join(new.select(scope).distinct(), scope, "left_anti").unionByName(new).orderBy(F.desc(order)).limit(most)


def with_evidence(inventory: DataFrame, remote: DataFrame, previews: DataFrame) -> DataFrame:
    """Inventory rows with their remote file and preview by path, and flags of what was found."""
    out = inventory.join(remote.withColumn("has_remote", F.lit(True)), "relative_path", "left").join(previews.withColumn("has_preview", F.lit(True)), "relative_path", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_remote", "has_preview")})


def extremes(assets: DataFrame) -> DataFrame:
    """The smallest asset by size, ties by path."""
    return assets.where("size_bytes is not null").agg(F.min_by("relative_path", F.struct("size_bytes", "relative_path")).alias("smallest"), F.min("size_bytes").alias("bytes"))


def longest_groups(assets: DataFrame, group: str) -> DataFrame:
    """By group, the asset of the greatest depth (z), ties by path; a group without any depth has none."""
    return assets.groupBy(group).agg(F.min_by(F.when(F.col("z").isNotNull(), F.col("relative_path")), F.when(F.col("z").isNotNull(), F.struct((-F.col("z")).alias("d"), "relative_path"))).alias("longest"), F.max("z").alias("depth"))


def manifest_order(rows: DataFrame, *more: str) -> DataFrame:
    """By status, study and what follows."""
    return rows.orderBy("status", "study_id", *more)


# ---------------------------------------------------------------- hand-off and queues


def repository_identity(url: Column) -> Column:
    """struct(repository, accession) from host and path; a blank accession is null."""
    host = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    number = lambda text, pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    pair = lambda name, acc: F.struct(name.cast("string").alias("repository"), acc.cast("string").alias("accession"))
    return (
        F.when(F.contains(host, F.lit("empiar")) | F.contains(host, F.lit("ebi.ac.uk")), pair(F.lit("EMPIAR"), number(F.concat(host, path), "(?i)(?:EMPIAR[-_/]?|world_availability/)(\\d+)")))
        .when(F.contains(host, F.lit("figshare")), pair(F.lit("Figshare"), number(path, "(?i)/(?:articles|ndownloader)/(?:[^/?#]+/)*(\\d+)(?:[/?#]|$)")))
        .when(F.contains(host, F.lit("zenodo")), pair(F.lit("Zenodo"), number(path, "(?i)/(?:records?|record)/(\\d+)(?:[/?#]|$)")))
        .otherwise(pair(F.nullif(host, F.lit("")), F.lit(None)))
    )


def handoff(records: DataFrame) -> DataFrame:
    """Distinct locators in order with their repository, and the fingerprint of the identity fields and sorted locators."""
    out = records.withColumn("urls", locators())
    return out.select("dataset_id", F.transform("urls", lambda u: F.struct(u.alias("locator_url"), repository_identity(u).alias("r"))).alias("candidates"), identity_fingerprint(F.col("urls")).alias("fingerprint"))


def first_failure(rules: Sequence[tuple[Column, str]], passed: str) -> Column:
    """the code of the first rule that holds, else `passed`."""
    out = F.coalesce(*[F.when(cond, F.lit(code)) for cond, code in rules])
    return F.coalesce(out, F.lit(passed))


def queue_status(assets: DataFrame) -> DataFrame:
    """Indexed over ready over cache states over sidecar over review; the gate's first failure is given."""
    gate = first_failure(
        [
            (~F.coalesce("can_convert", F.lit(False)), "permission_denied"),
            (F.col("readiness") == "not_a_volume", "not_a_volume"),
            (F.size("conversion_blockers") > 0, "blocked"),
            (~F.rlike(F.coalesce("sha256", F.lit("")), F.lit("^[0-9a-f]{64}$")), "checksum_missing"),
            (~(F.least("x", "y", "z") > 0), "dimensions_missing"),
        ],
        "ready",
    )
    rows = assets.withColumn("gate", gate)
    status = F.when(F.col("indexed"), "indexed").when(F.col("gate") == "ready", "ready").when(F.col("cached"), "cached").when(F.col("gate") == "not_a_volume", "sidecar").otherwise("review")
    return rows.withColumn("queue_status", status)


def packaged(rows: DataFrame, position: str, findings: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Of entries with one slug the last by position stays (positions are to tell them apart); those without derivatives drop out.

    findings (dataset_slug, finding_id, severity) and labels (slug, label_path) are attached, if they are given, as sorted lists.
    """
    last = rows.groupBy("slug").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "slug"]), position).alias("r")).select("slug", "r.*").select(*rows.columns).where("n_derivatives > 0")
    if findings is not None:
        per = findings.groupBy(F.col("dataset_slug").alias("slug")).agg(F.array_sort(F.collect_list(F.struct("finding_id", "severity"))).alias("findings"))
        last = last.join(per, "slug", "left").withColumn("findings", F.coalesce("findings", F.array().cast("array<struct<finding_id:string,severity:string>>")))
    if labels is not None:
        per = labels.groupBy("slug").agg(F.array_sort(F.collect_set("label_path")).alias("labels"))
        last = last.join(per, "slug", "left").withColumn("labels", F.coalesce("labels", F.array().cast(NO_TEXT)))
    return last

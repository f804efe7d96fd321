"""Manifests and scan rules (R2, J2, R18, R32, R34, X26, X29, X34, X40, X41, X47): joins and projections over all-string rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N

# Role of each class of extensions, in the order of the tests, and folder names of derived files.
DERIVED_FOLDERS = ("analysis", "cache", "derived", "export", "figure", "figures", "mask", "masks", "preview", "processed", "segmentation")
ROLES = (
    ("raw_volume_candidate", (".ome.tif", ".ome.tiff", ".tif", ".tiff", ".mrc", ".h5", ".hdf5", ".zarr")),
    ("imaging_candidate", (".am", ".hdf", ".ims", ".lif", ".nd2", ".oib", ".oir")),
    ("preview_or_publication_figure", (".jpg", ".jpeg", ".png", ".gif", ".webp")),
    ("tabular_metadata_or_measurements", (".csv", ".tsv", ".xls", ".xlsx")),
    ("metadata_sidecar", (".json", ".xml", ".yaml", ".yml")),
    ("document_or_publication_context", (".doc", ".docx", ".md", ".pdf", ".ppt", ".pptx", ".txt")),
    ("code_or_notebook", (".ipynb", ".m", ".py", ".r", ".sh")),
)
SCALE_STEPS = tuple(m * 10**e for e in range(6) for m in (1, 2, 5))


def likely_role(path: Column, is_link: Column) -> Column:
    """Link, then a derived folder anywhere in the path, then the class of the extension."""
    ext = N.extension(path)
    out = F.when(is_link, "symlink").when(F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*[F.lit(x) for x in DERIVED_FOLDERS])), "derived_or_analysis_output")
    for role, suffixes in ROLES:
        out = out.when(ext.isin(*suffixes), role)
    return out.when(ext == "", "no_extension").otherwise("unknown")


def scale_precedence(candidates: dict[str, Column]) -> Column:
    """The first scale (struct x, y, z) that is known, with the name of its source; null without any."""
    return F.coalesce(*[F.when(c.isNotNull(), F.struct(c["x"].alias("x"), c["y"].alias("y"), c["z"].alias("z"), F.lit(name).alias("source"))) for name, c in candidates.items()])


def fnv1a(c: Column) -> Column:
    """64-bit FNV-1a of the text's bytes as 16 hexadecimal digits.

    The product is taken in two halves of 32 bits with exact decimals, so that no step overflows.
    """
    size, prime = 2**32, 0x100000001B3
    number = lambda v: F.lit(v).cast("decimal(38,0)")
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(c)), lambda i: F.conv(F.hex(F.substring(F.encode(c, "UTF-8"), i, F.lit(1))), 16, 10).cast("bigint"))
    state = lambda hi, lo: F.struct(hi.cast("bigint").alias("hi"), lo.cast("bigint").alias("lo"))

    def step(s: Column, b: Column) -> Column:
        low = s["lo"].bitwiseXOR(b)
        whole = low.cast("decimal(38,0)") * number(prime)
        carry = F.floor(whole / number(size))
        high = (s["hi"].cast("decimal(38,0)") * number(prime) + carry) % number(size)
        return state(high, whole % number(size))

    done = F.aggregate(F.when(F.octet_length(c) > 0, octets).otherwise(F.array().cast("array<bigint>")), state(F.lit(0xCBF29CE4), F.lit(0x84222325)), step)
    return F.concat(F.lpad(F.lower(F.hex(done["hi"])), 8, "0"), F.lpad(F.lower(F.hex(done["lo"])), 8, "0"))


def roi_center(lo: Column, hi: Column, size: Column) -> Column:
    """The midpoint, halves up, within the volume."""
    return F.greatest(F.lit(0), F.least(F.floor((lo + hi) / 2 + 0.5), size - 1)).cast("bigint")


def scale_bar(target_nm: Column) -> Column:
    """The step nearest to the target by ratio; ties take the smaller."""
    scored = F.transform(F.array(*[F.lit(s) for s in SCALE_STEPS]), lambda s: F.struct(F.abs(F.log(target_nm / s)).alias("d"), s.alias("s")))
    return F.array_min(scored)["s"]


def log_axis(c: Column) -> Column:
    """log10 of positive values, null otherwise."""
    return F.when(c > 0, F.log10(c))


def public_manifest(sheet: DataFrame) -> DataFrame:
    """R2: public assets from sheet rows (study_id, link, notes, size, files, status): URLs, repositories and byte range."""
    urls = N.extract_urls(F.col("link"), F.col("notes"))
    rows = sheet.withColumn("urls", urls).withColumn("range", N.size_range(F.col("size"), F.col("files")))
    return rows.select(
        "study_id", N.slug(F.col("study_id")).alias("study_slug"), F.col("status").alias("included_status"), F.array_join("urls", "; ").alias("public_locator_urls"), F.array_join(N.repository_types(F.col("urls")), "; ").alias("repository_types"),
        F.col("size").alias("total_size_raw"), F.col("range.lo").alias("total_size_bytes_min"), F.col("range.hi").alias("total_size_bytes_max"), F.col("range.note").alias("size_parse_note"),
    )


def locator_manifest(datasets: DataFrame, studies: DataFrame, public: DataFrame) -> DataFrame:
    """Locators with what is known of their study and public assets; blanks and 'included' where nothing is."""
    j = datasets.join(studies.select("study_id", F.col("included_status").alias("s"), "journal_published"), "study_id", "left").join(public.select("study_id", "public_locator_urls", "repository_types"), "study_id", "left")
    blank = lambda c: F.coalesce(c, F.lit(""))
    return j.select(
        F.concat(N.slug(F.col("study_id")), F.lit("-"), F.format_string("%03d", F.col("pos").cast("bigint"))).alias("dataset_locator_id"), "study_id", F.coalesce("s", F.lit("included")).alias("included_status"), "cell_type",
        blank(F.col("journal_published")).alias("journal_published"), blank(F.col("public_locator_urls")).alias("public_locator_urls"), blank(F.col("repository_types")).alias("public_repository_types"),
    )


VOLUME_FORMATS = ("MRC", "TIFF", "HDF5", "Zarr")


def _about(path: str, rules: list[tuple[Column, Column | str]]) -> Column:
    """The texts `path: words` of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(hit, F.concat(path, F.lit(": "), F.lit(words) if isinstance(words, str) else words)) for hit, words in rules]))


def validation_warnings(files: DataFrame, previews: DataFrame, entries: DataFrame, source: str = "empiar") -> DataFrame:
    """(entry_id, section, pos, rank, warning), in the report's order: entry, files, image sets, previews.

    files: entry_id, pos, relative_path, format, size_bytes, tiff_error, scale_nm and, by source, map_marker, nx, mx, cell_x, api_name, expected, depth (empiar) or
    expected_size, supplied_md5, computed_md5, local_md5, trakem2_z_nm (figshare). previews: entry_id, pos, relative_path, kind, warning. entries: entry_id, dataset_size.
    """
    from .public_data import imageset_warnings, z_spacing_warning

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    volume = F.col("format").isin(*VOLUME_FORMATS)
    tiff = (text("tiff_error") != "", F.concat(F.lit("TIFF parse warning: "), "tiff_error"))
    if source == "empiar":
        mrc = F.col("format") == "MRC"
        mirrors = mrc & (F.coalesce("nx", F.lit(0)) != 0) & (F.col("nx") == F.col("mx")) & (text("cell_x") == text("nx"))
        rules = [
            (mrc & (text("map_marker") != "MAP "), "MRC MAP marker missing or unexpected."), (mirrors, "MRC cell dimensions mirror voxel counts; header physical scale is likely default, not authoritative."), tiff,
            (volume & F.col("scale_nm").isNull(), "no physical voxel size found in curated text, API metadata, TIFF metadata, or MRC header."),
        ]
    elif source == "figshare":
        md5 = F.when(text("computed_md5") != "", F.col("computed_md5")).otherwise(text("supplied_md5"))
        spacing = z_spacing_warning(F.col("trakem2_z_nm"))
        rules = [
            (F.col("expected_size").isNotNull() & (F.col("size_bytes") != F.col("expected_size")), F.concat(F.lit("Figshare expected "), text("expected_size"), F.lit(" bytes but local file has "), text("size_bytes"), F.lit(" bytes."))),
            ((md5 != "") & (text("local_md5") != "") & (md5 != F.col("local_md5")), "Figshare MD5 mismatch."), tiff, (spacing.isNotNull(), spacing),
            (volume & F.col("scale_nm").isNull(), "no physical voxel size found in Figshare, TIFF, or paired TrakEM2 metadata."),
        ]
    else:
        raise ValueError(f"unknown source {source!r}")
    own = files.select("entry_id", F.lit(1).alias("section"), "pos", F.posexplode(_about("relative_path", rules)).alias("rank", "warning"))
    totals = entries.join(files.groupBy("entry_id").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")), "entry_id", "left")
    none, size = F.coalesce("n", F.lit(0)) == 0, text("dataset_size")
    said = [F.when(none, F.lit("No local data files found."))]
    if source == "empiar":
        said.append(F.when((size != "") & (F.coalesce("bytes", F.lit(0)) == 0), F.concat(F.lit("Entry reports dataset_size="), size, F.lit(" but no local bytes were inventoried."))))
    entry = totals.select("entry_id", F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("pos"), F.posexplode(F.array_compact(F.array(*said))).alias("rank", "warning"))
    shown = previews.where(F.col("kind").isin(*VOLUME_FORMATS) & (text("warning") != ""))
    last = shown.select("entry_id", F.lit(3).alias("section"), "pos", F.lit(0).alias("rank"), F.concat("relative_path", F.lit(": preview warning: "), "warning").alias("warning"))
    out = entry.unionByName(own).unionByName(last)
    if source != "empiar":
        return out
    # image sets are told apart by entry, in the order of their first files
    of = files.where("coalesce(api_name, '') <> ''").withColumn("api_key", F.to_json(F.struct("entry_id", "api_name")))
    named = of.groupBy("api_key").agg(F.min("entry_id").alias("entry_id"), F.min("api_name").alias("name"), F.min("pos").alias("pos"))
    found = imageset_warnings(of.withColumn("api_name", F.col("api_key"))).withColumnRenamed("api_name", "api_key").join(named, "api_key")
    # the key stands for the name in the text
    worded = F.when(F.startswith("warning", F.col("api_key")), F.concat("name", F.substring("warning", F.length("api_key") + 1, F.length("warning")))).otherwise(F.col("warning"))
    return out.unionByName(found.select("entry_id", F.lit(2).alias("section"), "pos", F.lit(0).alias("rank"), worded.alias("warning")))


def normalised_assets(rows: DataFrame, source: str = "empiar") -> DataFrame:
    """Inventory rows as assets: dimensions, the chosen physical scale with where it comes from, and the header's scale.

    rows: entry_id, relative_path, format, size_bytes, sha256, mrc_nx, mrc_ny, mrc_nz, tiff_width, tiff_height, tiff_slices, the scales tiff_scale, mrc_scale and, by source,
    asset_scale, citation_scale, curated_scale (empiar) or trakem2 (figshare: trakem2_calibration()); a scale is struct(x, y, z) or null. A size of 0 is unknown.
    """
    known = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit(0)) for x in c])
    ranked = {"empiar": ("asset_scale", "citation_scale", "curated_scale", "tiff_scale"), "figshare": ("tiff_scale", "trakem2")}
    if source not in ranked:
        raise ValueError(f"unknown source {source!r}")
    names = {"asset_scale": F.lit("asset_api_details"), "citation_scale": F.lit("citation_details"), "curated_scale": F.lit("curated_public_data_assets_resolution"), "tiff_scale": F.lit("tiff_imagej_metadata")}
    if source == "figshare":
        names["trakem2"] = F.coalesce(F.nullif(F.col("trakem2.z_source"), F.lit("")), F.lit("trakem2_calibration"))
    whole = lambda c: (F.col(f"{c}.x") + F.col(f"{c}.y") + F.col(f"{c}.z")).isNotNull()
    axis = lambda a: F.coalesce(*[F.when(whole(c), F.col(f"{c}.{a}")) for c in ranked[source]]).alias(a)
    chosen = F.coalesce(*[F.when(whole(c), names[c]) for c in ranked[source]], F.lit(""))
    header = F.col("mrc_scale")
    return rows.select(
        "entry_id", "relative_path", "format", "size_bytes", F.coalesce("sha256", F.lit("")).alias("sha256"),
        F.struct(known("mrc_nx", "tiff_width").alias("x"), known("mrc_ny", "tiff_height").alias("y"), known("mrc_nz", "tiff_slices").alias("z")).alias("dimensions"),
        F.struct(axis("x"), axis("y"), axis("z"), chosen.alias("source")).alias("physical_voxel_size_nm"),
        F.struct(header["x"].alias("x"), header["y"].alias("y"), header["z"].alias("z"), F.when(header["x"].isNotNull(), "mrc_header").otherwise("").alias("source")).alias("header_voxel_size_nm"),
    )


def validation_totals(files: DataFrame, previews: DataFrame, entries: DataFrame) -> DataFrame:
    """file_count, formats (sorted), total_bytes, total_gib (3 decimals) and preview_count of each entry."""
    f = files.groupBy("entry_id").agg(F.count("*").alias("file_count"), F.array_sort(F.collect_set("format")).alias("formats"), F.sum("size_bytes").alias("total_bytes"))
    p = previews.where("coalesce(preview, '') <> ''").groupBy("entry_id").agg(F.count("*").alias("preview_count"))
    out = entries.select("entry_id").join(f, "entry_id", "left").join(p, "entry_id", "left")
    zero = F.lit(0).cast("bigint")
    counts = {c: F.coalesce(c, zero) for c in ("file_count", "total_bytes", "preview_count")}
    return out.withColumns(counts | {"formats": F.coalesce("formats", F.array().cast("array<string>"))}).withColumn("total_gib", F.round(F.col("total_bytes") / F.lit(float(1024**3)), 3))


def preflight(checks: DataFrame) -> DataFrame:
    """Blockers and warnings of planned scans (columns scan_id, root_exists, root_is_folder, root_readable, output_inside, output_writable, free_bytes, same_device, checksums, same_identity, known_checksums)."""
    blockers = F.array_compact(
        F.array(
            F.coalesce(F.when(~F.col("root_exists"), "root_missing"), F.when(~F.col("root_is_folder"), "root_not_a_folder"), F.when(~F.col("root_readable"), "root_unreadable")),
            F.when(F.col("output_inside"), "output_inside_root"),
            F.when(~F.col("output_writable"), "output_not_writable"),
            F.when(F.col("free_bytes") < 1024**3, "less_than_1_gib_free"),
            F.when(~F.col("same_identity"), "state_of_another_scan"),
        )
    )
    warnings = F.array_compact(F.array(F.when(F.col("same_device") & F.col("checksums"), "shared_device"), F.when(F.col("known_checksums") == 0, "no_prior_checksums")))
    return checks.select("scan_id", blockers.alias("blockers"), warnings.alias("warnings"), (F.size(blockers) == 0).alias("may_run"))

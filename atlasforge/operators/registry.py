"""Registry assembly and views (R7, R8, R10, R12, R27-R31, F16, F17, F21, F24, A14, A17, A18, A21, J12, J13, J16, J19, O10, O11, O15, W6, M7, M8, M11, T6, X27, X45, X48, X49)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from . import estate as E


def assemble(rows: DataFrame, registry_id: str) -> DataFrame:
    """Nested asset documents with a stable id and the search text, from joined and judged rows."""
    ident = N.stable_id(F.lit(registry_id), F.col("relative_path"))
    return rows.select(
        F.lit(registry_id).alias("registry_id"), ident.alias("asset_id"), "relative_path",
        F.struct("digest", F.col("digest").isNotNull().alias("present")).alias("checksum"),
        F.struct("metadata_status", "format", "x", "y", "z", "dtype", "voxel_nm").alias("metadata"),
        F.struct(F.transform("gaps", lambda g: g["gap_code"]).alias("gap_codes"), "gaps").alias("review"),
        F.struct("ready", "project_ready", "conversion_ready", "blockers", F.col("is_candidate").alias("is_volume_candidate")).alias("readiness"),
        F.lower(F.concat_ws(" ", ident, "relative_path", "format", F.array_join("blockers", " "))).alias("search_text"),
    )


def directory_volumes(candidates: DataFrame, manifest: DataFrame) -> DataFrame:
    """Candidates that are directories, with the size of what is below; always blocked by the missing composite checksum, which is added after the readiness flags."""
    alone = E.synthetic_candidates(candidates, manifest)
    sized = E.prefix_rollup(alone.select(F.col("relative_path").alias("prefix")), manifest)
    return sized.select(F.col("prefix").alias("relative_path"), "n_files", "bytes", F.array(F.lit("missing_composite_checksum")).alias("blockers"))


def import_public(sources: DataFrame, derivatives: DataFrame) -> DataFrame:
    """Source assets and derivatives as one registry; of derivatives with one path the first stays."""
    first = derivatives.groupBy("relative_path").agg(F.min_by(F.struct("sha256", "format"), "pos").alias("d")).select("relative_path", "d.sha256", "d.format", F.lit("derivative").alias("kind"))
    return sources.select("relative_path", "sha256", "format", F.lit("source").alias("kind")).unionByName(first)


#: Readiness of a source that may be converted.
CONVERTIBLE = ("validated", "ready_for_conversion_trial", "ready_with_review_notes")


def public_registry(sources: DataFrame, derivatives: DataFrame) -> DataFrame:
    """Source assets and their derivatives as registry rows with status, permissions, gaps and readiness; of derivatives with one output path the first stays.

    sources: dataset_slug, relative_path, asset_group (ready, blocked, sidecar), readiness, conversion_target, sha256, size_bytes, format, x, y, z, blockers, review_notes.
    derivatives: dataset_slug, pos, source_relative_path, output_path (below the root), byte_size, validation, checksum, shape (z, y, x). A derivative without a checksum of its
    files, or that has not passed validation, is blocked; one that is clear may be viewed, and no source may.
    """
    converted = derivatives.select("dataset_slug", F.col("source_relative_path").alias("relative_path")).distinct().withColumn("converted", F.lit(True))
    s = sources.join(converted, ["dataset_slug", "relative_path"], "left")
    none = F.array().cast("array<string>")
    state = F.coalesce(F.nullif("readiness", F.lit("")), F.when(F.col("asset_group") == "sidecar", "not_applicable").otherwise("unknown"))
    can_convert = state.isin(*CONVERTIBLE)
    listed = lambda c: F.coalesce(c, none)
    gap = lambda c, severity: F.transform(listed(c), lambda g: F.struct(g.alias("gap_code"), F.lit(severity).alias("severity")))
    sized = F.col("x").isNotNull() | F.col("y").isNotNull() | F.col("z").isNotNull()
    blocked = F.when(state.isin("blocked", "needs_review"), F.array(F.lit("blocked_review"))).otherwise(none)
    source = s.select(
        F.lit("source").alias("kind"), F.concat("dataset_slug", F.lit("/data/"), "relative_path").alias("relative_path"), F.lit("file").alias("path_type"), F.when(F.coalesce("conversion_target", F.lit(False)), "raw_volume_candidate").otherwise("metadata_sidecar").alias("role"),
        "size_bytes", F.nullif("sha256", F.lit("")).alias("digest"), F.when(can_convert, "validated").otherwise(state).alias("asset_status"), F.lit("checksummed").alias("fixity_status"), F.when(can_convert, "validated").otherwise(state).alias("triage_status"),
        blocked.alias("blocked_states"), F.concat(F.array(F.lit("public_data_manifest")), F.when(F.col("converted"), F.array(F.lit("streamable_derivative_available"))).otherwise(none)).alias("review_notes"),
        can_convert.alias("can_convert"), F.lit(False).alias("can_view"), F.when(sized, "readable").otherwise("not_extracted").alias("metadata_status"), F.coalesce("format", F.lit("")).alias("format"), F.concat(gap("blockers", "blocker"), gap("review_notes", "review")).alias("gaps"),
        F.col("asset_group").isin("ready", "blocked").alias("is_candidate"),
    )
    first = derivatives.groupBy("output_path").agg(F.min_by(F.struct("byte_size", "validation", "checksum", "shape"), F.struct("pos", "dataset_slug", "source_relative_path")).alias("d")).select("output_path", "d.*")
    whole = F.coalesce("checksum", F.lit("")) != ""
    wrong = F.array_compact(F.array(F.when(F.coalesce("validation", F.lit("")) != "passed", "blocked_validation"), F.when(~whole, "missing_composite_checksum")))
    clear = F.size(wrong) == 0
    made = first.select(
        F.lit("derivative").alias("kind"), F.col("output_path").alias("relative_path"), F.lit("directory_volume").alias("path_type"), F.lit("raw_volume_candidate").alias("role"), F.col("byte_size").alias("size_bytes"), F.nullif("checksum", F.lit("")).alias("digest"),
        F.when(clear, "project_ready").otherwise("derived_review").alias("asset_status"), F.when(whole, "composite_checksummed").otherwise("component_checksums_pending").alias("fixity_status"), F.lit("converted").alias("triage_status"), wrong.alias("blocked_states"),
        F.array(F.lit("public_data_derivative_manifest")).alias("review_notes"), F.lit(False).alias("can_convert"), clear.alias("can_view"), F.when(F.coalesce(F.size("shape"), F.lit(0)) == 3, "readable").otherwise("not_extracted").alias("metadata_status"), F.lit("Zarr").alias("format"),
        F.array().cast("array<struct<gap_code:string,severity:string>>").alias("gaps"), F.lit(True).alias("is_candidate"),
    )
    return source.unionByName(made).withColumns({"review_required": F.size("blocked_states") > 0, "publication_status": F.lit("published"), "rights_status": F.lit("public")})


def under_review() -> Column:
    """Whether a review is required or gaps are left."""
    return F.coalesce("review_required", F.lit(False)) | (F.size("gaps") > 0)


def section(name: str) -> Column:
    """F16: predicate of a registry section."""
    queue = ~F.col("project_ready") & F.col("can_convert") & F.col("ready") & F.col("digest").isNotNull()
    flags = {"all": F.lit(True), "project_ready": F.col("project_ready"), "conversion_queue": queue, "review": under_review() | (F.size("blockers") > 0) | (F.coalesce("duplicate_of", F.lit("")) != "")}
    if name not in flags:
        raise ValueError(f"unknown section {name!r}")
    return flags[name]


def queue_filter(name: str) -> Column:
    """ready, review, matched or all, without regard to the permission blocker."""
    left = F.filter("blockers", lambda b: b != "blocked_permission")
    flags = {"all": F.lit(True), "ready": F.size(left) == 0, "review": F.size(left) > 0, "matched": F.col("matched")}
    if name not in flags:
        raise ValueError(f"unknown queue filter {name!r}")
    return flags[name]


def public_notices(findings: DataFrame) -> DataFrame:
    """approved findings that may be shown."""
    return findings.where((F.col("review_status") == "approved") & F.col("public_candidate"))


def on_plane(overlays: DataFrame, axis: str, index: int) -> DataFrame:
    """overlays drawn on one plane: those of its axis and slice."""
    return overlays.where((F.col("axis") == axis) & (F.col("slice_index") == index))


def unresolved(assets: DataFrame, entries: DataFrame, registry_id: str) -> DataFrame:
    """What breaks a registry bundle: assets of another registry, and search entries that name no asset."""
    foreign = assets.where(F.col("registry_id") != registry_id).select(F.lit("foreign_asset").alias("problem"), "asset_id")
    lost = entries.join(assets.select("asset_id"), "asset_id", "left_anti").select(F.lit("unknown_entry").alias("problem"), "asset_id")
    return foreign.unionByName(lost)


def normalise_workset(rows: DataFrame) -> DataFrame:
    """Workset rows as registry rows: review_required where there are findings or gaps, and the blocked intents among the blockers, sorted."""
    blockers = F.array_sort(F.array_distinct(F.concat("blockers", F.transform("blocked_intents", lambda i: F.concat(F.lit("blocked_intent:"), i)))))
    return rows.withColumn("review_required", (F.size("gaps") > 0) | (F.size("blocked_intents") > 0)).withColumn("blockers", blockers)


def exactly_one(rows: DataFrame, condition: Column) -> DataFrame:
    """the one row of a selection; raises for none and for more."""
    found = rows.where(condition)
    n = found.limit(2).count()
    if n != 1:
        raise ValueError("no asset matches" if n == 0 else "the selection is ambiguous")
    return found


def match_keys(rows: DataFrame, ident: str) -> DataFrame:
    """Keys under which an asset can be found: its path, its path below the first folder, and its name, each normalised; distinct."""
    path = N.normal_path(F.lower("relative_path"))
    keys = F.array_distinct(F.array(path, F.regexp_replace(path, "^[^/]*/", ""), F.substring_index(path, "/", -1)))
    return rows.select(ident, F.explode(keys).alias("match_key"))


def matched(rows: DataFrame, keys: DataFrame, ident: str) -> DataFrame:
    """Rows any of whose keys is wanted."""
    return rows.join(match_keys(rows, ident).join(keys.select("match_key").distinct(), "match_key", "left_semi").select(ident).distinct(), ident, "left_semi")


def sidecars(volumes: DataFrame, files: DataFrame) -> DataFrame:
    """Sidecar files by the normalised stem of their volume."""
    stem = lambda c: N.identity(F.regexp_replace(F.substring_index(c, "/", -1), "\\.[^/]*$", ""))
    return volumes.select(F.col("relative_path").alias("volume"), stem(F.col("relative_path")).alias("stem")).join(files.select(F.col("relative_path").alias("sidecar"), stem(F.col("relative_path")).alias("stem")), "stem").where("stem <> ''").select("volume", "sidecar")


def conversion_order() -> list[Column]:
    """Assets under review pressure last, then by path in code-point order."""
    return [under_review().cast("int").asc(), F.asc("relative_path")]


def advisory_order() -> list[Column]:
    """Severity (alphabetic), category, path, id."""
    return [F.asc("severity"), F.asc("category"), F.asc("relative_path"), F.asc("finding_id")]


def manifest_summary(assets: DataFrame) -> DataFrame:
    """Rows by status, and the sum of the parsed byte ranges, in all and of the included."""
    inc = F.col("included_status") == "included"
    return assets.agg(
        F.count("*").alias("rows"), F.count_if(inc).alias("included"), F.sum("lo").alias("bytes_min"), F.sum("hi").alias("bytes_max"), F.sum(F.when(inc, F.col("lo"))).alias("included_min"), F.sum(F.when(inc, F.col("hi"))).alias("included_max")
    )


def long_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of the values of several columns in long form, in one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("counter"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("name")) for c in columns])
    return rows.select(F.explode(pairs).alias("x")).select("x.*").groupBy("counter", "name").agg(F.count("*").alias("n"))


def top_actions(rows: DataFrame, actions: str, n: int = 12) -> DataFrame:
    """The most frequent recommended actions, ties by name."""
    return rows.select(F.explode(actions).alias("action")).groupBy("action").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc("action")).limit(n)


def next_label(labels: DataFrame, prefix: str = "M") -> DataFrame:
    """The next free number of labels such as M7."""
    number = F.regexp_extract("label", f"^{prefix}(\\d+)$", 1)
    return labels.agg(F.concat(F.lit(prefix), (F.coalesce(F.max(F.nullif(number, F.lit("")).cast("bigint")), F.lit(0)) + 1).cast("string")).alias("label"))


def volume_fingerprint(*parts: str) -> Column:
    """Identity of a volume: its fields joined by '::', with the size as ZxYxX."""
    return F.concat_ws("::", *parts, F.concat_ws("x", "z", "y", "x"))


def resolve_volumes(project: DataFrame, loaded: DataFrame) -> DataFrame:
    """A project's volume is resolved, changed or missing by slug and asset and then its fingerprint."""
    j = project.join(loaded.select("slug", "asset", F.col("fingerprint").alias("now")), ["slug", "asset"], "left")
    return j.withColumn("resolution", F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("fingerprint"), "resolved").otherwise("changed")).drop("now")


def signature(rows: DataFrame, fields: list[str]) -> DataFrame:
    """SHA-256 of the stable fields as JSON with sorted names."""
    return rows.withColumn("signature", F.sha2(F.to_json(F.struct(*[F.col(f) for f in sorted(fields)])), 256))


def project_violations(measurements: DataFrame, volumes: DataFrame) -> DataFrame:
    """Measurements that name no volume or lie outside it."""
    j = measurements.join(volumes.select("volume_id", "x", "y", "z"), "volume_id", "left")
    out = lambda a: ~F.col(f"p{a}").between(0, F.col(a) - 1)
    codes = F.array_compact(F.array(F.when(F.col("x").isNull(), "unknown_volume"), *[F.when(out(a), f"{a}_out_of_bounds") for a in "xyz"]))
    return j.select("measurement_id", F.explode(codes).alias("violation"))


def canonical(path: Column) -> Column:
    """A path without empty and . parts, and each .. taken together with the part before it; one that climbs above its start is null."""
    none = F.array().cast("array<string>")
    up = lambda a: F.when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1))
    step = lambda a, p: F.when(a.isNull(), a).when(p.isin("", "."), a).when(p == "..", up(a)).otherwise(F.concat(a, F.array(p)))
    return F.aggregate(F.split(path, "/"), none, step, lambda a: F.array_join(a, "/"))


LABEL_SCHEMA, LABEL_VERSION = "segmentation-manifest", 1


def label_derivatives(sources: DataFrame, manifests: DataFrame, entries: DataFrame, schema: str = LABEL_SCHEMA) -> DataFrame:
    """Label stores as derivatives of their sources: source_relative_path (source#segmentation=id), source_path, output_path.

    sources: relative_path, output_path, shape. manifests: manifest_path, schema, schema_version, source_output_path. entries: manifest_path, segmentation_id, validation,
    output_path, shape. A manifest lies beside its source as <name>.segmentations.json and must name the schema, its version and the source; an entry must
    have passed validation, have the source's shape and lie below <name>.segmentations. Paths are compared as canonical().
    """
    s = sources.where(~F.contains("relative_path", F.lit("#segmentation="))).select("relative_path", canonical(F.col("output_path")).alias("source_path"), F.col("shape").alias("source_shape"))
    s = s.where("source_path is not null").withColumn("manifest", F.concat("source_path", F.lit(".segmentations.json")))
    m = manifests.where((F.col("schema") == schema) & (F.col("schema_version") == LABEL_VERSION)).select("manifest_path", canonical(F.col("manifest_path")).alias("manifest"), canonical(F.col("source_output_path")).alias("source_path"))
    e = entries.where((F.col("validation") == "passed") & (F.coalesce("segmentation_id", F.lit("")) != "")).select("manifest_path", "segmentation_id", canonical(F.col("output_path")).alias("output_path"), "shape")
    j = s.join(m, ["manifest", "source_path"]).join(e, "manifest_path")
    below = F.startswith("output_path", F.concat("source_path", F.lit(".segmentations/"))) | (F.col("output_path") == F.concat("source_path", F.lit(".segmentations")))
    return j.where(below & F.col("shape").eqNullSafe(F.col("source_shape"))).select(F.concat("relative_path", F.lit("#segmentation="), "segmentation_id").alias("source_relative_path"), "source_path", "output_path")


def labels_in_root(manifests: DataFrame, roots: list[str]) -> DataFrame:
    """Label stores that passed validation, have the source's shape and lie below an allowed folder, after their paths' steps upwards are taken."""
    path = canonical(F.col("label_path"))
    below = F.lit(False)
    for r in roots:
        below = below | F.startswith(path, F.lit(r.strip("/") + "/"))
    return manifests.where(F.coalesce(below, F.lit(False)) & (F.col("validation") == "passed") & (F.col("shape") == F.col("source_shape")))


def resume(items: DataFrame, active: tuple[str, ...], retry: bool) -> DataFrame:
    """M7: active items become pending after a restart; failed ones too when asked."""
    again = F.col("status").isin(*active, *(("failed",) if retry else ()))
    return items.withColumn("status", F.when(again, "pending").otherwise(F.col("status")))


def needs_rebuild(index: DataFrame, source: DataFrame) -> DataFrame:
    """M8: sources whose version, path, size or time is not what the index has."""
    keys = ["version", "relative_path", "size_bytes", "modified_at"]
    return source.join(index.select(*keys), keys, "left_anti")


def valid_code(codes: DataFrame, now: Column, most: int = 5) -> DataFrame:
    """The latest code of each user, if it is not consumed, not expired and has attempts left."""
    latest = codes.withColumn("_r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("code_id")))).where("_r = 1").drop("_r")
    return latest.where(F.col("consumed_at").isNull() & (F.col("expires_at") > now) & (F.col("attempts") < most))


def upsert_if_ranked(old: DataFrame, new: DataFrame, key: list[str], rank: str, position: str) -> DataFrame:
    """Per key the row of the highest rank; a new row replaces an old one of equal rank."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = F.struct(rank, "_new", position)
    rest = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), best).alias("r")).select(*key, *[f"r.{c}" for c in rest if c != "_new"])


def overlay_flag(c: Column) -> Column:
    """Yes, true or 1, and no, false or 0; blank is null; any other word raises."""
    word = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(word == "", F.lit(None).cast("boolean")).when(word.isin("1", "true", "yes", "y"), True).when(word.isin("0", "false", "no", "n"), False).otherwise(F.raise_error(F.concat(F.lit("not a yes or no: "), word)).cast("boolean"))


def overlay_list(c: Column) -> Column:
    """Blank is null; 'none' and '[]' are the empty list; else the parts between semicolons or commas."""
    text = F.trim(F.coalesce(c, F.lit("")))
    parts = F.filter(F.transform(F.split(text, "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(text == "", F.lit(None).cast("array<string>")).when(F.lower(text).isin("none", "[]"), F.array().cast("array<string>")).otherwise(parts)


def example_pair(rows: DataFrame) -> DataFrame:
    """The first pair by position that shares the cell type, else species and comparator, else the first two.

    For each rule the first pair has its earlier row at the first place of a group of two or more, found by aggregation.
    """
    def first(keys: list[str], rule: int) -> DataFrame:
        known = rows.dropna(subset=keys)
        firsts = known.groupBy(*keys).agg(F.min(F.struct("pos", "dataset_id")).alias("l"))
        later = known.join(firsts, keys).where(F.col("pos") > F.col("l.pos")).groupBy("l").agg(F.min(F.struct("pos", "dataset_id")).alias("r"))
        return later.select(F.lit(rule).alias("rule"), F.col("l.pos").alias("a"), F.col("l.dataset_id").alias("left_id"), F.col("r.dataset_id").alias("right_id"))

    two = rows.orderBy("pos").limit(2).agg(F.array_sort(F.collect_list(F.struct("pos", "dataset_id"))).alias("p")).where("size(p) = 2")
    fallback = two.select(F.lit(3).alias("rule"), F.col("p")[0]["pos"].alias("a"), F.col("p")[0]["dataset_id"].alias("left_id"), F.col("p")[1]["dataset_id"].alias("right_id"))
    every = first(["cell_type"], 1).unionByName(first(["species", "comparator_class"], 2)).unionByName(fallback)
    return every.orderBy("rule", "a").limit(1).select("left_id", "right_id")

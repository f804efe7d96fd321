"""Worksets, pilot reports, asset states and project files (R11, R12, R15, R27, A17, A18): rows in, rows out; summaries in long form from one pass each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .estate import WORKSET_LIMIT

# ---------------------------------------------------------------- summaries


def named(column: str, other: str) -> Column:
    """The text of a column, or another where it is null or blank."""
    return F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(other))


def summary(rows: DataFrame, counters: dict[str, Column], tallies: dict[str, Column], lists: dict[str, Column]) -> DataFrame:
    """Long form (kind, name, n): counters (aggregates by name), and how often each value of the tallies (texts) and lists (arrays of texts) comes."""
    pair = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("name"))
    single = F.array(*[pair(k, c) for k, c in tallies.items()])

    def values(kind: str, c: Column) -> Column:
        known = F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit("")) != "")
        return F.transform(known, lambda v: pair(kind, v))

    every = F.concat(single, *[values(k, c) for k, c in lists.items()])
    counted = rows.select(F.explode(every).alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("n")).select("kind", "name", "n")
    one = rows.agg(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(k) for k, c in counters.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit("counter").alias("kind"), F.lit(k).alias("name"), F.col(k).alias("n")) for k in counters])).alias("x")).select("x.*").unionByName(counted)


def _findings(totals: DataFrame, empty: str, rules: Sequence[tuple[Column, str, str, Column]]) -> DataFrame:
    """(place, severity, code, summary) of the rules that hold for one row of totals with `selected`; an empty selection has one finding alone."""
    row = lambda severity, code, text: F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), text.alias("summary"))
    found = F.array_compact(F.array(*[F.when(hit, row(severity, code, text)) for hit, severity, code, text in rules]))
    none = F.array(row("blocker", "empty_selection", F.lit(empty)))
    return totals.select(F.posexplode(F.when(F.col("selected") == 0, none).otherwise(found)).alias("place", "f")).select("place", "f.*")


def _text(n: Column, words: str) -> Column:
    return F.concat(n.cast("string"), F.lit(words))


# ---------------------------------------------------------------- R11: worksets

#: The operations that can be intended, and the permission that each needs (none: always allowed).
OPERATIONS = {"review": None, "inspect": "can_view", "convert": "can_convert", "measure": "can_view", "publish": "can_publish", "backup": "can_backup"}


def promote(assets: DataFrame, condition: Column, intents: Sequence[str], limit: int = WORKSET_LIMIT) -> DataFrame:
    """The selected assets, the first `limit` in walk order, with blocked_operations (sorted) and can_enter; an operation that is not known is blocked.

    A permission column that is absent or null permits nothing.
    """
    if not 0 < limit <= WORKSET_LIMIT:
        raise ValueError(f"a workset holds 1 to {WORKSET_LIMIT} assets")
    may = lambda p: F.coalesce(F.col(p), F.lit(False)) if p in assets.columns else F.lit(False)
    denied = []
    for operation in sorted(set(intents)):
        needs = OPERATIONS.get(operation, "")
        if needs is not None:
            denied.append(F.when(~may(needs), F.lit(operation)))
    blocked = F.array_compact(F.array(*denied)) if denied else F.array().cast("array<string>")
    rows = assets.where(condition).orderBy("walk_pos", "relative_path").limit(limit).withColumn("blocked_operations", blocked)
    return rows.withColumn("can_enter", F.size("blocked_operations") == 0)


def workset_summary(records: DataFrame) -> DataFrame:
    """Counters, and tallies of rights, triage and publication status, format, blockers and blocked operations."""
    counters = {
        "selected_asset_count": F.count("*"), "selected_bytes_total": F.sum("size_bytes"), "checksum_record_count": F.count_if(F.coalesce("digest", F.lit("")) != ""), "metadata_ready_count": F.count_if("ready"),
        "conversion_ready_count": F.count_if("conversion_ready"), "project_ready_count": F.count_if("project_ready"), "dataset_mode_ready_count": F.count_if("can_enter"),
    }
    tallies = {k: named(k, "unknown") for k in ("rights_status", "triage_status", "publication_status")} | {"format": named("format", "[none]")}
    return summary(records, counters, tallies, {"blocker": F.col("blockers"), "blocked_operation": F.col("blocked_operations")})


def workset_findings(records: DataFrame, intents: Sequence[str]) -> DataFrame:
    """What stands in a workset's way: missing fixity, unknown rights, blocked operations, or an empty selection."""
    totals = records.agg(
        F.count("*").alias("selected"), F.count_if(F.coalesce("digest", F.lit("")) != "").alias("sums"), F.count_if(named("rights_status", "unknown") == "unknown").alias("unknown"), F.coalesce(F.sum(F.size("blocked_operations")), F.lit(0)).alias("blocked")
    )
    rules = (
        (F.col("sums") < F.col("selected"), "review", "missing_fixity", _text(F.col("selected") - F.col("sums"), " selected assets lack checksum records.")),
        (F.col("unknown") > 0, "blocker", "rights_unknown", _text(F.col("unknown"), " selected assets still have unknown rights status.")),
        (F.col("blocked") > 0, "blocker", "intended_operations_blocked", _text(F.col("blocked"), f" requested asset operations are blocked for {', '.join(intents)}.")),
    )
    return _findings(totals, "The workset selector did not match any registry assets.", rules)


def workset_review_queue(records: DataFrame) -> DataFrame:
    """Records with blocked operations, blockers or unknown rights."""
    return records.where((F.size("blocked_operations") > 0) | (F.size("blockers") > 0) | (named("rights_status", "unknown") == "unknown"))


# ---------------------------------------------------------------- R12, A18: pilot reports


def pilot_summary(assets: DataFrame, most: int = 12) -> DataFrame:
    """Counters and tallies of the selected assets; of the recommended actions the `most` frequent, ties by name."""
    counters = {
        "selected_asset_count": F.count("*"), "selected_bytes_total": F.sum("size_bytes"), "volume_candidate_count": F.count_if("is_candidate"), "checksum_record_count": F.count_if(F.coalesce("digest", F.lit("")) != ""),
        "duplicate_asset_count": F.count_if(F.coalesce("duplicate_of", F.lit("")) != ""), "metadata_ready_count": F.count_if("ready"), "conversion_ready_count": F.count_if("conversion_ready"),
        "project_ready_count": F.count_if("project_ready"), "review_required_count": F.count_if("review_required"),
    }
    tallies = {"role": named("role", "unknown"), "format": named("format", "[none]"), "extension": named("extension", "[none]")} | {k: named(k, "unknown") for k in ("rights_status", "publication_status", "triage_status")}
    every = summary(assets, counters, tallies, {"blocker": F.col("blockers"), "metadata_gap": F.transform("gaps", lambda g: g["gap_code"]), "action": F.col("actions")})
    actions = every.where("kind = 'action'").orderBy(F.desc("n"), F.asc("name")).limit(most)
    return every.where("kind <> 'action'").unionByName(actions)


def _pilot_totals(assets: DataFrame) -> DataFrame:
    return assets.agg(
        F.count("*").alias("selected"), F.count_if(named("rights_status", "unknown") == "unknown").alias("unknown"), F.count_if(F.coalesce("digest", F.lit("")) != "").alias("sums"), F.coalesce(F.sum(F.size("gaps")), F.lit(0)).alias("gap_total"),
        F.count_if("project_ready").alias("ready"), F.count_if(F.coalesce("duplicate_of", F.lit("")) != "").alias("copies"),
    )


def pilot_findings(assets: DataFrame) -> DataFrame:
    """Findings of a pilot selection in their order."""
    rules = (
        (F.col("unknown") > 0, "blocker", "rights_unknown", _text(F.col("unknown"), " selected assets still have unknown rights status.")),
        (F.col("sums") < F.col("selected"), "review", "missing_fixity", _text(F.col("selected") - F.col("sums"), " selected assets do not have direct checksum records.")),
        (F.col("gap_total") > 0, "review", "metadata_gaps", _text(F.col("gap_total"), " metadata gaps remain across the selected pilot subset.")),
        (F.col("ready") == 0, "blocker", "no_project_ready_assets", F.lit("No selected assets are currently project-ready.")),
        (F.col("copies") > 0, "review", "duplicate_checksums", _text(F.col("copies"), " selected assets duplicate another checksum.")),
    )
    return _findings(_pilot_totals(assets), "The pilot selector did not match any registry assets.", rules)


#: The step that a kind of pilot adds.
KIND_STEPS = {
    "published": "Map selected assets to DOI, figure, supplement, and methods text for publication reconstruction.",
    "triaged": "Capture the triage reason so the archive records why these assets should not be promoted.",
    "candidate": "Write one candidate scientific question and the minimum measurement/ROI/job evidence needed.",
}


def pilot_next_steps(assets: DataFrame, kind: str) -> DataFrame:
    """(place, step): what to do next, from the totals and the kind of the pilot."""
    steps = [
        F.lit("Confirm data owner, allowed operations, publication/triage status, and reviewer for this pilot subset."),
        F.when(F.col("sums") < F.col("selected"), "Run or resume SHA-256 fixity for selected assets that lack direct checksum records."),
        F.when(F.col("gap_total") > 0, "Resolve metadata gaps before conversion or measurement, starting with blocker-severity gaps."),
        F.when(F.col("ready") == 0, "Curate rights/status and select at least one asset that can be converted and viewed.").otherwise("Open the project-ready assets and create a local project package."),
    ]
    if kind in KIND_STEPS:
        steps.append(F.lit(KIND_STEPS[kind]))
    return _pilot_totals(assets).select(F.posexplode(F.array_compact(F.array(*steps))).alias("place", "step"))


def pilot_review_queue(assets: DataFrame) -> DataFrame:
    """Selected assets with blockers, gaps or unknown rights."""
    return assets.where((F.size("blockers") > 0) | (F.size("gaps") > 0) | (named("rights_status", "unknown") == "unknown"))


# ---------------------------------------------------------------- R15: four stages of an asset


def asset_state_manifest(assets: DataFrame, remote: DataFrame, previews: DataFrame, root: str) -> DataFrame:
    """Each asset as source, mirror, validated volume and streamable derivative.

    assets: relative_path, source, size_bytes, sha256, format, x, y, z, scale_nm, header_scale_nm, state, warnings, blockers, review_notes (asset_states()).
    remote: relative_path, url. previews: relative_path, preview. The last of several rows of a path counts, by pos.
    """
    last = lambda df, c: df.groupBy("relative_path").agg(F.max_by(c, "pos").alias(c))
    j = assets.drop("url", "preview").join(last(remote, "url"), "relative_path", "left").join(last(previews, "preview"), "relative_path", "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return j.select(
        "relative_path",
        F.struct(F.lit("indexed").alias("state"), "source", text("url"), F.col("relative_path").alias("repository_path")).alias("source_asset"),
        F.struct(F.lit("mirrored").alias("state"), F.concat(F.lit(root.rstrip("/") + "/data/"), "relative_path").alias("local_path"), "size_bytes", "sha256", "format").alias("mirrored_asset"),
        F.struct("state", F.struct("x", "y", "z").alias("dimensions"), F.col("scale_nm").alias("physical_voxel_size_nm"), F.col("header_scale_nm").alias("header_voxel_size_nm"), text("preview").alias("preview_path"), "warnings", "blockers", "review_notes").alias("validated_volume"),
        F.struct(F.lit("not_started").alias("state"), F.lit("").alias("format"), F.lit("").alias("path"), F.lit("OME-Zarr or equivalent conversion has not been attempted in the pilot stage.").alias("note")).alias("streamable_derivative"),
    )


# ---------------------------------------------------------------- R27: project files

#: Fixed values of a project file.
AXES, ROI_KINDS, NOTE_SCOPES, JOB_KINDS = ("z", "y", "x"), ("point", "box"), ("project", "view", "volume"), ("project-audit", "roi-inventory", "histogram")


def _blank(*columns: str) -> list[Column]:
    return [F.when(F.trim(F.coalesce(c, F.lit(""))) == "", f"{c}_missing") for c in columns]


def _timestamps(*columns: str) -> list[Column]:
    return [F.when(F.try_to_timestamp(F.col(c)).isNull(), f"{c}_invalid") for c in columns]


def _choice(column: str, values: Sequence[str]) -> Column:
    return F.when(~F.coalesce(F.col(column).isin(*values), F.lit(False)), f"{column}_unknown")


def _point(name: str, wanted: Column | None = None) -> list[Column]:
    """Each coordinate of a point (name.x, .y, .z) is an index of its axis; a point that is not wanted may be absent."""
    inside = lambda a: F.coalesce(F.col(f"{name}.{a}").between(0, F.col(a) - 1), F.lit(False))
    asked = F.col(name).isNotNull() if wanted is None else wanted | F.col(name).isNotNull()
    return [F.when(F.col("z").isNotNull() & asked & ~inside(a), f"{name}_{a}_out_of_bounds") for a in "xyz"]


def _violations(rows: DataFrame, table: str, codes: Sequence[Column]) -> DataFrame:
    return rows.select("project_id", F.lit(table).alias("item"), F.col("id").cast("string").alias("id"), F.explode(F.array_compact(F.array(*codes))).alias("violation"))


def _placed(rows: DataFrame, volumes: DataFrame) -> DataFrame:
    """Rows with the shape (z, y, x) of the volume that they name in their project; null where there is none."""
    shapes = volumes.groupBy("project_id", "dataset_slug", "asset_path").agg(*[F.min(a).alias(a) for a in "zyx"])
    return rows.drop("z", "y", "x").join(shapes, ["project_id", "dataset_slug", "asset_path"], "left")


def _slice() -> Column:
    limit = F.coalesce(*[F.when(F.col("axis") == a, F.col(a)) for a in AXES])
    return F.when(F.col("z").isNotNull() & limit.isNotNull() & ~F.coalesce(F.col("slice").between(0, limit - 1), F.lit(False)), "slice_out_of_bounds")


def project_violations(project: DataFrame, volumes: DataFrame, notes: DataFrame, measurements: DataFrame, rois: DataFrame, jobs: DataFrame) -> DataFrame:
    """(project_id, item, id, violation): every rule that a project file breaks, all rules at once.

    project: project_id, name, created_at, updated_at, active_slug, active_path, active_fingerprint, volume_count, volume_fingerprints. volumes: project_id,
    id, dataset_slug, asset_path, source, entry_id, format, dtype, z, y, x, source_size_bytes, fingerprint. notes, measurements, rois and jobs are rows of
    project_id and id with the fields of their rules.
    """
    lost = F.when(F.col("z").isNull(), "unknown_volume")
    reference = _blank("dataset_slug", "asset_path")
    positive = [F.when(~F.coalesce(F.col(a) >= 1, F.lit(False)), f"{a}_invalid") for a in "zyx"]
    size = F.when(~F.coalesce(F.col("source_size_bytes") >= 0, F.lit(False)), "source_size_bytes_invalid")
    own = ["project_id", "dataset_slug", "asset_path"]
    twice = volumes.groupBy(*own).agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1")
    distance = F.when(F.isnan("distance_um") | ~F.coalesce((F.col("distance_um") >= 0) & (F.col("distance_um") < float("inf")), F.lit(False)), "distance_um_invalid")
    box = F.coalesce(F.col("kind") == "box", F.lit(False))
    out = [
        _violations(volumes, "volume", [*_blank("dataset_slug", "asset_path", "source", "entry_id", "format", "dtype"), *positive, size]),
        _violations(twice, "volume", [F.lit("duplicate_volume")]),
        _violations(notes, "note", [*_blank("id"), _choice("scope", NOTE_SCOPES), *_timestamps("created_at", "updated_at")]),
        _violations(_placed(measurements, volumes), "measurement", [*_blank("id", "label"), *reference, lost, _choice("axis", AXES), _slice(), *_point("start", F.lit(True)), *_point("end", F.lit(True)), distance, *_timestamps("created_at")]),
        _violations(_placed(rois, volumes), "roi", [*_blank("id", "label", "category"), *reference, lost, _choice("kind", ROI_KINDS), _choice("axis", AXES), _slice(), *_point("start", F.lit(True)), *_point("end", box), *_timestamps("created_at")]),
        _violations(_placed(jobs, volumes), "job", [*_blank("id", "title", "summary"), *reference, lost, _choice("kind", JOB_KINDS), F.when(F.coalesce("status", F.lit("")) != "completed", "status_not_completed"), *_timestamps("created_at")]),
    ]
    # the project itself: its active volume, and the fingerprints that it lists
    known = volumes.groupBy("project_id").agg(F.count("*").alias("n"), F.collect_set("fingerprint").alias("known"))  # the volumes of one file
    active = volumes.groupBy(*own).agg(F.min("fingerprint").alias("active")).withColumnsRenamed({"dataset_slug": "active_slug", "asset_path": "active_path"})
    p = project.withColumn("id", F.col("project_id")).join(known, "project_id", "left").join(active, ["project_id", "active_slug", "active_path"], "left")
    listed = F.coalesce("volume_fingerprints", F.array().cast("array<string>"))
    have = F.coalesce("known", F.array().cast("array<string>"))
    codes = [
        *_blank("name"), *_timestamps("created_at", "updated_at"), F.when(F.coalesce("n", F.lit(0)) == 0, "no_volumes"), F.when(F.col("active").isNull(), "active_volume_unknown"),
        F.when(F.col("active").isNotNull() & ~F.col("active").eqNullSafe(F.col("active_fingerprint")), "active_fingerprint_differs"), F.when(~F.coalesce(F.col("volume_count") == F.col("n"), F.lit(False)), "volume_count_differs"),
        F.when(~F.coalesce(F.size(listed) == F.col("n"), F.lit(False)), "fingerprint_count_differs"), F.when(F.size(F.array_except(listed, have)) > 0, "fingerprint_unknown"), F.when(F.size(F.array_except(have, listed)) > 0, "fingerprint_unlisted"),
    ]
    out.append(_violations(p, "project", codes))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every

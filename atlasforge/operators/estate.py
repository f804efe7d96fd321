"""Archive estate (R4-R13, J5-J11, W2-W3, A15-A18, A32, F15-F20, O6-O8): inventories, readiness, overlays, worksets, copies."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .filters import all_tokens

VOLUME_EXTENSIONS = (".am", ".h5", ".hdf", ".hdf5", ".ims", ".lif", ".mrc", ".nd2", ".oib", ".oir", ".tif", ".tiff", ".zarr", ".ome.tif", ".ome.tiff", ".zarray")  # fixed values
WORKSET_LIMIT = 10_000


def duplicates(files: DataFrame) -> DataFrame:
    """For each digest the first path in walk order; every later file points to it."""
    first = files.groupBy("digest").agg(F.min(F.struct("walk_pos", "relative_path")).alias("f")).select("digest", F.col("f.relative_path").alias("duplicate_of"))
    return files.join(first, "digest").where("relative_path <> duplicate_of").select("relative_path", "duplicate_of", "digest", "size_bytes")


def copy_verification(source: DataFrame, target: DataFrame, require_checksums: bool = False) -> DataFrame:
    """Issues between two manifests (relative_path, size_bytes, digest; a null digest is no checksum), in rule order."""
    s = source.select("relative_path", F.lit(True).alias("in_s"), F.col("size_bytes").alias("s_size"), F.col("digest").alias("s_digest"))
    t = target.select("relative_path", F.lit(True).alias("in_t"), F.col("size_bytes").alias("t_size"), F.col("digest").alias("t_digest"))
    both = s.join(t, "relative_path", "full_outer")
    common = F.col("in_s").isNotNull() & F.col("in_t").isNotNull()
    issue = lambda cond, name: F.when(cond, F.lit(name))
    rules = [
        issue(F.col("in_s").isNull(), "unexpected_in_target"),
        issue(F.col("in_t").isNull(), "missing_in_target"),
        issue(common & (F.coalesce("s_size", F.lit(0)) != F.coalesce("t_size", F.lit(0))), "size_mismatch"),
        issue(common & F.lit(require_checksums) & F.col("s_digest").isNull(), "missing_source_checksum"),
        issue(common & F.lit(require_checksums) & F.col("t_digest").isNull(), "missing_target_checksum"),
        issue(common & (F.col("s_digest") != F.col("t_digest")), "checksum_mismatch"),
    ]
    return both.select("relative_path", F.posexplode(F.array_compact(F.array(*rules))).alias("rank", "issue_type"), "s_size", "t_size")


def copy_summary(source: DataFrame, target: DataFrame, issues: DataFrame) -> DataFrame:
    """Paths in common, issues by type; passed only without any issue."""
    common = source.select("relative_path").join(target.select("relative_path"), "relative_path").agg(F.count("*").alias("n")).select(F.lit("common_paths").alias("measure"), "n")
    return common.unionByName(issues.groupBy(F.col("issue_type").alias("measure")).agg(F.count("*").alias("n")))


def stale(cache: DataFrame, manifest: DataFrame) -> DataFrame:
    """Cached rows whose path is gone."""
    return cache.join(manifest.select("relative_path"), "relative_path", "left_anti")


def latest_by_rank(rows: DataFrame, key: Sequence[str], rank: str, position: str) -> DataFrame:
    """Per key the row of the highest rank, ties by the later position. Combines before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(rank, position)).alias("r")).select(*key, *[f"r.{c}" for c in rest])


def keep_last(rows: DataFrame, key: Sequence[str], position: str) -> DataFrame:
    return latest_by_rank(rows, key, position, position)


def needs_review(role: Column, extension: Column) -> Column:
    return role.isin("raw_volume_candidate", "imaging_candidate") | extension.isin(*VOLUME_EXTENSIONS)


def gaps() -> Column:
    """Array of struct(gap_code, severity) of one asset (columns role, extension, metadata_status, format, x, y, z, dtype, voxel_nm)."""
    gap = lambda cond, code, severity: F.when(cond, F.struct(F.lit(code).alias("gap_code") if isinstance(code, str) else code.alias("gap_code"), severity.alias("severity")))
    status = F.col("metadata_status")
    missing = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    blocker, review = F.lit("blocker"), F.lit("review")
    hdf5 = (status == "detected") & (F.coalesce("format", F.lit("")) == "HDF5")
    rules = F.array_compact(
        F.array(
            gap(hdf5, "hdf5_internal_metadata_pending", review),
            gap(~hdf5 & (status != "readable"), F.concat(F.lit("metadata_status_"), status), F.when(status.isin("error", "unreadable"), blocker).otherwise(review)),
            gap(missing("x") | missing("y"), "missing_dimensions", blocker),
            gap(missing("z"), "missing_z_dimension", review),
            gap(F.coalesce("dtype", F.lit("")) == "", "missing_dtype", blocker),
            gap(F.col("voxel_nm").isNull(), "missing_voxel_size", review),
        )
    )
    none = F.array().cast("array<struct<gap_code:string,severity:string>>")
    extractor = F.array(F.struct(F.lit("no_metadata_extractor").alias("gap_code"), F.lit("review").alias("severity")))
    return F.when(~needs_review(F.col("role"), F.col("extension")), none).when(status.isNull(), extractor).otherwise(rules)


def blocked_states(gaps_col: str = "gaps") -> Column:
    """States seeded from the gaps; permission is denied until curated."""
    has = lambda cond: F.exists(gaps_col, cond)
    return F.array_sort(
        F.array_compact(
            F.array(
                F.lit("blocked_permission"),
                F.when(has(lambda g: g["gap_code"].isin("missing_dimensions", "missing_dtype", "no_metadata_extractor")), "blocked_missing_metadata"),
                F.when(has(lambda g: F.startswith(g["gap_code"], F.lit("metadata_status_")) & (g["severity"] == "blocker")), "blocked_unreadable"),
                F.when(has(lambda g: g["gap_code"] == "missing_voxel_size"), "blocked_unknown_voxel_size"),
            )
        )
    )


def metadata_ready() -> Column:
    positive = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    return (F.coalesce("metadata_status", F.lit("")) == "readable") & positive("x") & positive("y") & positive("z") & (F.coalesce("dtype", F.lit("")) != "") & F.col("voxel_nm").isNotNull()


def readiness(assets: DataFrame) -> DataFrame:
    """Adds ready, blockers (sorted), project_ready and conversion_ready; needs gaps, states, digest, is_candidate, can_view, can_convert."""
    ready = metadata_ready()
    blockers = F.array_union(
        F.array_union("states", F.transform("gaps", lambda g: g["gap_code"])),
        F.array_compact(
            F.array(
                F.when(F.col("digest").isNull(), "missing_checksum"), F.when(F.col("is_candidate") & ~ready, "blocked_missing_metadata"), F.when(~F.col("can_view"), "blocked_permission")
            )
        ),
    )
    out = assets.withColumn("ready", ready).withColumn("blockers", F.array_sort(F.array_distinct(blockers)))
    clear = F.col("digest").isNotNull() & F.col("ready") & (F.size("blockers") == 0)
    return out.withColumn("project_ready", F.col("can_view") & clear).withColumn("conversion_ready", F.col("can_convert") & clear)


def registry(manifest: DataFrame, checksums: DataFrame, metadata: DataFrame, gap_rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Manifest with its checksum, metadata, gaps and candidate flag, all by relative_path; gaps are gathered per path first."""
    g = gap_rows.groupBy("relative_path").agg(F.array_sort(F.collect_list(F.struct("gap_code", "severity"))).alias("gaps"))
    c = candidates.select("relative_path").distinct().withColumn("is_candidate", F.lit(True))
    out = manifest.join(checksums, "relative_path", "left").join(metadata, "relative_path", "left").join(g, "relative_path", "left").join(c, "relative_path", "left")
    return out.withColumns({"gaps": F.coalesce("gaps", F.array().cast("array<struct<gap_code:string,severity:string>>")), "is_candidate": F.coalesce("is_candidate", F.lit(False))})


def synthetic_candidates(candidates: DataFrame, manifest: DataFrame) -> DataFrame:
    """Candidates that are no file of the manifest (directory volumes)."""
    return candidates.join(manifest.select("relative_path"), "relative_path", "left_anti")


def prefix_rollup(prefixes: DataFrame, files: DataFrame) -> DataFrame:
    """Count, bytes and latest walk position of the files below each directory. Every file's ancestors are exploded, so the join is on equality."""
    parts = F.split("relative_path", "/")
    depth = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    ancestors = F.when(F.size(parts) > 1, F.transform(depth, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    below = files.select(F.explode(ancestors).alias("prefix"), "size_bytes", "walk_pos").groupBy("prefix").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("bytes"), F.max("walk_pos").alias("latest"))
    return prefixes.join(below, "prefix", "left").select("prefix", F.coalesce("n_files", F.lit(0)).cast("bigint").alias("n_files"), F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"), "latest")


def tree_digest(files: DataFrame, group: str) -> DataFrame:
    """SHA-256 over a directory's sorted 'path NUL size NUL digest' lines. It hashes the children's digests, not their bytes."""
    line = F.concat("relative_path", F.lit("\0"), F.col("size_bytes").cast("string"), F.lit("\0"), "digest", F.lit("\n"))
    rows = files.select(F.col(group).cast("string").alias("g"), "relative_path", line.alias("line")).repartition("g").sortWithinPartitions("g", "relative_path").select("g", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines come in order, so a directory of any size is hashed as it passes; the state is one digest."""
        name, state, n, begun = None, hashlib.sha256(), 0, False
        result = lambda: pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([state.hexdigest()]), pa.array([n], pa.int64())], names=[group, "tree_digest", "n_files"])
        for batch in batches:
            names = batch.column(0)
            ends = [i for i in range(1, len(names)) if names[i] != names[i - 1]] + [len(names)]
            start = 0
            for end in ends:
                if start == end:
                    continue
                if begun and names[start].as_py() != name:
                    yield result()
                    state, n = hashlib.sha256(), 0
                name, begun = names[start].as_py(), True
                for text in batch.column(1).slice(start, end - start).drop_null().to_pylist():
                    state.update(text.encode())
                n += end - start
                start = end
        if begun:
            yield result()

    return rows.mapInArrow(run, f"{group} string, tree_digest string, n_files long")


def overlay(assets: DataFrame, rows: DataFrame) -> DataFrame:
    """Curated rows by asset_id, else by relative_path (the last row of a key wins); states replace, notes append, operations patch."""
    fields = ["rights_status", "states", "notes", "can_view", "can_convert"]
    by_id = keep_last(rows.where("asset_id is not null"), ["asset_id"], "pos").select("asset_id", F.struct(*fields).alias("by_id"))
    by_path = keep_last(rows.where("asset_id is null and relative_path is not null"), ["relative_path"], "pos").select("relative_path", F.struct(*fields).alias("by_path"))
    out = assets.join(by_id, "asset_id", "left").join(by_path, "relative_path", "left").withColumn("o", F.coalesce("by_id", "by_path"))
    return out.withColumns(
        {
            "overlaid": F.col("o").isNotNull(),
            "rights_status": F.coalesce("o.rights_status", "rights_status"),
            "states": F.coalesce("o.states", "states"),
            "notes": F.concat("notes", F.coalesce("o.notes", F.array().cast("array<string>"))),
            "can_view": F.coalesce("o.can_view", "can_view"),
            "can_convert": F.coalesce("o.can_convert", "can_convert"),
        }
    ).drop("by_id", "by_path", "o")


def overlay_leftovers(assets: DataFrame, rows: DataFrame) -> DataFrame:
    """Curated rows that match no asset."""
    by_id = rows.where("asset_id is not null").join(assets.select("asset_id"), "asset_id", "left_anti").select("asset_id", "relative_path")
    by_path = rows.where("asset_id is null").join(assets.select("relative_path"), "relative_path", "left_anti").select("asset_id", "relative_path")
    return by_id.unionByName(by_path)


def selected(ids: Sequence[str] = (), prefixes: Sequence[str] = (), query: str = "", everything: bool = False, candidates_only: bool = False) -> Column:
    """all, or one of the ids, or below a prefix, or with every query term; then candidates alone if asked."""
    hit = F.lit(everything)
    if ids:
        hit = hit | F.col("asset_id").isin(*ids)
    for p in prefixes:
        hit = hit | (F.col("relative_path") == p.rstrip("/")) | F.startswith("relative_path", F.lit(p.rstrip("/") + "/"))
    if query.strip():
        hit = hit | all_tokens(F.col("search_text"), query.lower())
    return hit & F.col("is_candidate") if candidates_only else hit


def workset(assets: DataFrame, condition: Column, limit: int = WORKSET_LIMIT) -> DataFrame:
    """The first `limit` selected assets in stream order, then candidates first and by path; operations that are not ready are blocked."""
    if limit > WORKSET_LIMIT:
        raise ValueError(f"a workset holds at most {WORKSET_LIMIT} assets")
    rows = assets.where(condition).orderBy("walk_pos", "relative_path").limit(limit)
    blocked = F.array_compact(F.array(F.when(~F.col("project_ready"), "view"), F.when(~F.col("conversion_ready"), "convert")))
    return rows.withColumn("blocked_intents", blocked).orderBy(F.desc("is_candidate"), "relative_path")


def report_order(assets: DataFrame, condition: Column, limit: int) -> DataFrame:
    """Sorted first, then limited."""
    return assets.where(condition).orderBy(F.desc("is_candidate"), "relative_path").limit(limit)


def review_queue(assets: DataFrame) -> DataFrame:
    """assets to review with their reasons and severity."""
    reasons = F.concat(
        F.array_compact(F.array(F.when(F.col("is_candidate"), "volume_candidate"))),
        F.transform("gaps", lambda g: g["gap_code"]),
        F.array_compact(F.array(F.when(F.col("duplicate_of").isNotNull(), "duplicate_checksum"))),
    )
    severity = F.when(F.exists("gaps", lambda g: g["severity"] == "blocker"), "blocker").otherwise("review")
    return assets.withColumn("reasons", reasons).where(F.size("reasons") > 0).select("asset_id", "relative_path", severity.alias("severity"), F.array_join("reasons", ";").alias("reasons"), F.array_join("blockers", ";").alias("blockers"))


def registry_summary(assets: DataFrame) -> DataFrame:
    """Ten counters and five tallies in long form (kind, name, n), each in one pass: the assets are read twice.

    A blank extension or format is [none], a blank role or status unknown; an asset without blockers tallies as ready.
    """
    named = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    queued = F.col("is_candidate") | (F.size("gaps") > 0) | F.col("duplicate_of").isNotNull()
    logical = F.col("path_type") == "directory_volume"
    counters = {
        "asset_count": F.count("*"), "file_asset_count": F.count_if(~logical), "logical_asset_count": F.count_if(logical), "bytes_total": F.coalesce(F.sum("size_bytes"), F.lit(0)), "volume_candidate_count": F.count_if("is_candidate"),
        "review_queue_count": F.count_if(queued), "metadata_gap_count": F.coalesce(F.sum(F.size("gaps")), F.lit(0)), "checksum_record_count": F.count_if(F.coalesce("digest", F.lit("")) != ""),
        "duplicate_asset_count": F.count_if(F.col("duplicate_of").isNotNull()), "project_ready_count": F.count_if("project_ready"),
    }
    pair = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("name"))
    single = F.array(pair("extension", named("extension", "[none]")), pair("role", named("role", "unknown")), pair("format", named("format", "[none]")), pair("status", named("asset_status", "unknown")))
    readiness_of = F.transform(F.when(F.size("blockers") == 0, F.array(F.lit("ready"))).otherwise(F.col("blockers")), lambda b: pair("readiness", b))
    tallies = assets.select(F.explode(F.concat(single, readiness_of)).alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))
    counts = assets.agg(*[c.cast("bigint").alias(k) for k, c in counters.items()])
    long = counts.select(F.explode(F.array(*[F.struct(F.lit("counter").alias("kind"), F.lit(k).alias("name"), F.col(k).alias("n")) for k in counters])).alias("x")).select("x.*")
    return long.unionByName(tallies.select("kind", "name", "n"))


def scan_summary(files: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Files, bytes, and first and last time of change by extension, role, path type and over all, in one pass of grouping sets; and the errors by operation.

    A blank extension is [none]. errors: rows with `operation`; their rows have a number and nothing else.
    """
    rows = files.withColumn("extension", F.coalesce(F.nullif("extension", F.lit("")), F.lit("[none]")))
    sets = rows.groupingSets([[F.col("extension")], [F.col("role")], [F.col("path_type")], []], "extension", "role", "path_type")
    kind = F.when(F.col("g") == 3, "extension").when(F.col("g") == 5, "role").when(F.col("g") == 6, "path_type").otherwise("all")
    out = sets.agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("bytes"), F.min("modified_at").alias("modified_min"), F.max("modified_at").alias("modified_max"), F.grouping_id().alias("g"))
    out = out.select(kind.alias("grouping"), F.coalesce("extension", "role", "path_type", F.lit("*")).alias("name"), "n_files", "bytes", "modified_min", "modified_max")
    if errors is None:
        return out
    failed = errors.groupBy(F.col("operation").alias("name")).agg(F.count("*").alias("n_files")).withColumn("grouping", F.lit("error"))
    return out.unionByName(failed, allowMissingColumns=True)


def largest(files: DataFrame, n: int = 200) -> DataFrame:
    """The largest files, ties in walk order."""
    return files.orderBy(F.desc("size_bytes"), "walk_pos").limit(n)


def page(files: DataFrame, number: int, size: int, order: str) -> DataFrame:
    """One page of 1 to 100 rows."""
    size = min(100, max(1, size))
    return files.orderBy(order).offset(number * size).limit(size)


def page_after(rows: DataFrame, order: Sequence[str], last: Sequence | None, size: int = 100) -> DataFrame:
    """The page of 1 to 100 rows that follows the row whose order columns are `last` (None: the first page), nulls first.

    The columns must tell rows apart. Rows up to `last` are left out by a filter on the first column, which scans can use, so a page
    costs the rows after it and a top-k, however far back it is; nothing is counted or skipped.
    """
    size = min(100, max(1, size))
    if last is None:
        return rows.orderBy(*order).limit(size)
    beyond = F.lit(False)
    for column, value in reversed(list(zip(order, last, strict=True))):
        c = F.col(column)
        same, more = (c.isNull(), c.isNotNull()) if value is None else (c == F.lit(value), c > F.lit(value))
        beyond = more | (same & beyond)
    first = F.col(order[0])
    if last[0] is not None:
        rows = rows.where(first >= F.lit(last[0]))
    return rows.where(beyond).orderBy(*order).limit(size)


def unchanged(previous: DataFrame, current: DataFrame) -> DataFrame:
    """M2: current files with the digest of a previous run where path, algorithm, size, time, device and inode are the same; null otherwise."""
    keys = ["relative_path", "algorithm", "size_bytes", "modified_at", "device_id", "inode"]
    return current.join(previous.select(*keys, "digest"), keys, "left")

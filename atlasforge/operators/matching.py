"""Matching (J13-J15, J18): arms of equality joins, the best arm of each left row, unique at the top or ambiguous.

Keys of the right side are gathered first, into how many rows have a key and the first of them, so a key that very many rows share on
both sides costs one row a left row, and no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N


def _best(left: DataFrame, arms: list[DataFrame]) -> DataFrame:
    """l, score, n, r of the highest arm (l, score, n: right rows that match, r: the least of them) of each left id."""
    every = arms[0]
    for arm in arms[1:]:
        every = every.unionByName(arm)
    top = every.groupBy("l").agg(F.max(F.struct("score", "n", "r")).alias("t"))
    return left.select("l").distinct().join(top, "l", "left").select("l", "t.score", "t.n", "t.r")


def _known(rows: DataFrame, key: Column, *columns: Column) -> DataFrame:
    return rows.select(key.alias("key"), *columns).where("key is not null and key <> ''")


def scored_best_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, arms: list[tuple[int, Column, Column]]) -> DataFrame:
    """left_id, status (matched, ambiguous, unmatched), right id and score of the highest arm (score, left key, right key) that matches; null and blank keys match nothing."""
    ids = left.select(F.col(left_id).alias("l"))
    found = []
    for score, lkey, rkey in arms:
        b = _known(right, rkey, F.col(right_id).alias("r")).distinct().groupBy("key").agg(F.count("*").alias("n"), F.min("r").alias("r"))
        # a left id with several keys counts the different right rows of all of them
        per = _known(left, lkey, F.col(left_id).alias("l")).distinct().join(b, "key").groupBy("l").agg(F.max("n").alias("n"), F.min("r").alias("r"), F.count_distinct("r").alias("k"))
        found.append(per.select("l", F.lit(score).alias("score"), F.greatest("n", "k").alias("n"), "r"))
    top = _best(ids, found)
    status = F.when(F.col("score").isNull(), "unmatched").when(F.col("n") == 1, "matched").otherwise("ambiguous")
    return top.select(F.col("l").alias(left_id), status.alias("status"), F.when(F.col("n") == 1, F.col("r")).alias("match_id"), "score")


def local_path(path: Column) -> Column:
    """A path without file://, with single forward slashes and none at the end."""
    text = F.regexp_replace(F.coalesce(path, F.lit("")), "^file://", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\", "/"), "/+", "/"), "/$", "")


def path_suffixes(path: Column) -> Column:
    """All proper suffixes of a path at its slashes."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).otherwise(F.array().cast("array<string>"))


REGISTRY_MATCH = {400: "archive-identity", 300: "checksum", 200: "local-path", 100: "relative-path"}


def registry_match(assets: DataFrame, derivatives: DataFrame) -> DataFrame:
    """asset_id, status (blocked, not-loaded, ambiguous, ready), derivative_id, matched_by.

    assets: asset_id, registry_id, root, relative_path, digest, size_bytes, project_ready, can_view. derivatives: derivative_id,
    asset_id, registry_id, source_sha256, source_size_bytes, source_local_path, output_path, source_relative_path. Identity counts if the
    derivative names no other registry, a checksum of 64 characters if sizes that are known agree; then the whole local path; then the relative path
    as such or as the end of a local path. Assets that are not cleared and ready are blocked before anything is compared.
    """
    open_ = F.coalesce(F.col("project_ready"), F.lit(False)) & F.coalesce(F.col("can_view"), F.lit(False))
    a = assets.where(open_).select(F.col("asset_id").alias("l"), "registry_id", "root", "relative_path", F.lower(F.trim("digest")).alias("digest"), F.coalesce("size_bytes", F.lit(0)).alias("size"))
    d = derivatives.withColumns({"r": F.col("derivative_id"), "guard": F.coalesce("registry_id", F.lit("")), "size": F.coalesce("source_size_bytes", F.lit(0))})

    def guarded(score: int, lkey: Column, rkey: Column, own: str, guard: str, nothing: Column) -> DataFrame:
        """Right rows are gathered by key and guard value; a guard that is blank, or blank on the left, agrees with all."""
        right = _known(d, rkey, F.col(guard).alias("g"), F.col("r")).groupBy("key", "g").agg(F.count("*").alias("n"), F.min("r").alias("r"))
        joined = _known(a, lkey, F.col("l"), F.col(own).alias("own")).join(right, "key").where((F.col("g") == nothing) | F.coalesce(F.col("own") == F.col("g"), F.lit(False)) | ((F.col("own") == nothing) if guard == "size" else F.lit(False)))
        return joined.groupBy("l").agg(F.sum("n").alias("n"), F.min("r").alias("r")).select("l", F.lit(score).alias("score"), "n", "r")

    def plain(score: int, lkey: Column, rkeys: Column) -> DataFrame:
        right = d.select("r", F.explode(rkeys).alias("key")).where("key <> ''").distinct().groupBy("key").agg(F.count("*").alias("n"), F.min("r").alias("r"))
        return _known(a, lkey, F.col("l")).join(right, "key").select("l", F.lit(score).alias("score"), "n", "r")

    relative = F.regexp_replace(local_path(F.col("relative_path")), "^/", "")
    root = local_path(F.col("root"))
    whole = F.when(root != "", F.concat(root, F.lit("/"), relative)).otherwise(relative)
    source, output = local_path(F.col("source_local_path")), local_path(F.col("output_path"))
    ends = F.concat(F.array(F.regexp_replace(local_path(F.col("source_relative_path")), "^/", "")), path_suffixes(source), path_suffixes(output))
    full = F.when(F.length("digest") == 64, F.col("digest"))
    arms = [
        guarded(400, F.col("l").cast("string"), F.col("asset_id").cast("string"), "registry_id", "guard", F.lit("")),
        guarded(300, full, F.lower(F.trim("source_sha256")), "size", "size", F.lit(0)),
        plain(200, whole, F.array(source, output)),
        plain(100, relative, ends),
    ]
    top = _best(a, arms)
    name = F.coalesce(*[F.when(F.col("score") == s, F.lit(n)) for s, n in REGISTRY_MATCH.items()])
    status = F.when(F.col("score").isNull(), "not-loaded").when(F.col("n") == 1, "ready").otherwise("ambiguous")
    one = lambda c: F.when(F.col("n") == 1, c)
    out = top.select(F.col("l").alias("asset_id"), status.alias("status"), one(F.col("r")).alias("derivative_id"), one(name).alias("matched_by"))
    return out.unionByName(assets.where(~open_).select("asset_id", F.lit("blocked").alias("status")), allowMissingColumns=True)


def handoff_match(handoffs: DataFrame, datasets: DataFrame) -> DataFrame:
    """handoff_id, status (pending, ambiguous, ready), slug, matched_by.

    handoffs: handoff_id, dataset_id, source_study_id, accessions. datasets: slug, entry_id, n_derivatives. Identities are compared by their letters and
    digits: dataset id and slug 100, study id and slug or entry 90, an accession and the entry 80. The best dataset must be the only one, and have a derivative.
    """
    same = N.identity
    h = handoffs.select(F.col("handoff_id").alias("l"), same(F.col("dataset_id")).alias("dataset"), same(F.col("source_study_id")).alias("study"), F.transform(F.coalesce("accessions", F.array().cast("array<string>")), same).alias("accessions"))
    d = datasets.select(F.col("slug").alias("r"), same(F.col("slug")).alias("slug"), same(F.col("entry_id")).alias("entry"), (F.coalesce("n_derivatives", F.lit(0)) > 0).alias("loaded"))
    # rows are datasets: two with one slug are two
    gathered = lambda rows: rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("r", "loaded")).alias("r"))
    either = d.select("r", "loaded", F.explode(F.array_distinct(F.array("slug", "entry"))).alias("key")).where("key <> ''")
    arm = lambda score, left, right: left.join(gathered(right), "key").select("l", F.lit(score).alias("score"), "n", "r")
    accession = h.select("l", F.explode(F.array_distinct("accessions")).alias("key")).where("key <> ''")
    entries = arm(80, accession, _known(d, F.col("entry"), F.col("r"), F.col("loaded"))).groupBy("l", "score").agg(F.sum("n").alias("n"), F.min("r").alias("r"))
    top = _best(h, [arm(100, _known(h, F.col("dataset"), F.col("l")), _known(d, F.col("slug"), F.col("r"), F.col("loaded"))), arm(90, _known(h, F.col("study"), F.col("l")), either), entries])
    one = F.col("n") == 1
    status = F.when(F.col("score").isNull() | (one & ~F.col("r.loaded")), "pending").when(one, "ready").otherwise("ambiguous")
    ready = lambda c: F.when(one & F.col("r.loaded"), c)
    name = F.when(F.col("score") == 100, "dataset-id").when(F.col("score") == 90, "study-id").otherwise("repository-accession")
    return top.select(F.col("l").alias("handoff_id"), status.alias("status"), ready(F.col("r.r")).alias("slug"), ready(name).alias("matched_by"))


def imageset_match(files: DataFrame, imagesets: DataFrame) -> DataFrame:
    """Files (entry_id, relative_path) with the position and name of the first image set of their entry that fits.

    imagesets: entry_id, pos, name, directory. One fits whose name is the file's stem, or the end of its path without an image suffix, or whose directory holds
    the file; of an entry with a single image set, that one fits any other file. Ends and folders of a path are exploded (ends only of lengths that
    names of the entry have), so all arms are equality joins.
    """
    path = F.col("relative_path")
    keys = files.select("entry_id", "relative_path").distinct()
    base = F.substring_index(path, "/", -1)
    stem = F.when(F.rlike(base, F.lit(r"^.+\.[^.]+$")), F.regexp_replace(base, r"\.[^.]+$", "")).otherwise(base)
    bare = F.regexp_replace(path, r"(?i)(\.mrc|\.mrc\.tif|\.tif|\.tiff)$", "")
    sets = imagesets.select("entry_id", "pos", F.coalesce("name", F.lit("")).alias("name"), F.regexp_replace(F.coalesce("directory", F.lit("")), "^/+|/+$", "").alias("directory"))
    lengths = sets.where("name <> ''").groupBy("entry_id").agg(F.collect_set(F.length("name")).alias("lengths"))
    ends = keys.join(lengths, "entry_id").withColumn("bare", bare).select("entry_id", "relative_path", F.explode(F.array_distinct(F.concat(F.array(stem), F.transform(F.filter("lengths", lambda n: n <= F.length("bare")), lambda n: F.right("bare", n))))).alias("name"))
    parts = F.split(path, "/")
    folders = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    above = keys.select("entry_id", "relative_path", F.explode(folders).alias("directory")).where("directory <> ''")
    first = lambda by: sets.where(F.col(by) != "").groupBy("entry_id", by).agg(F.min("pos").alias("pos"))
    hits = ends.join(first("name"), ["entry_id", "name"]).select("entry_id", "relative_path", "pos").unionByName(above.join(first("directory"), ["entry_id", "directory"]).select("entry_id", "relative_path", "pos"))
    hits = hits.groupBy("entry_id", "relative_path").agg(F.min("pos").alias("pos"))
    only = sets.groupBy("entry_id").agg(F.count("*").alias("n"), F.min("pos").alias("only")).where("n = 1").select("entry_id", "only")
    placed = files.join(hits, ["entry_id", "relative_path"], "left").join(only, "entry_id", "left").withColumn("pos", F.coalesce("pos", "only")).drop("only")
    return placed.join(sets.select("entry_id", "pos", F.col("name").alias("imageset")), ["entry_id", "pos"], "left")

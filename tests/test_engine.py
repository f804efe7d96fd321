"""Plane source, checkpoints, job logs, chained runs, chunk journals, token table, pages, matching rules and exact ranks."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from atlasforge.operators import catalog as C
from atlasforge.operators import estate as E
from atlasforge.operators import matching as M
from atlasforge.operators import public_data as P
from atlasforge.operators import runs, search
from atlasforge.operators import volume as V
from atlasforge.scratch import read_text, replace_text
from atlasforge.sinks import writers
from atlasforge.sources import bindings, planes
from atlasforge.streaming import streams

# ---------------------------------------------------------------- S19


def put(path, name, data):
    os.makedirs(os.path.dirname(f"{path}/{name}"), exist_ok=True)
    with open(f"{path}/{name}", "wb") as f:
        f.write(data)


def cube_of(rows, name):
    rows = sorted((r for r in rows if r.relative_path == name), key=lambda r: r.plane)
    return np.stack([np.frombuffer(bytes(r.raw), r.dtype).reshape(r.height, r.width) for r in rows])


@pytest.mark.parametrize("order", ["<", ">"])
def test_planes_of_every_layout(spark, tmp_path, order):
    r = np.random.default_rng(1)
    cube = r.integers(0, 60_000, (7, 5, 4)).astype("u2")
    signed = (cube.astype("i4") - 32768).astype("i2")
    small = (cube % 256).astype("u1")
    p = str(tmp_path)
    put(p, "a/plain.mrc", planes.mrc_bytes(cube, order, extended=160))
    put(p, "a/signed.rec", planes.mrc_bytes(signed, order, axes=(0, 0, 0)))
    put(p, "a/bytes.map", planes.mrc_bytes((small.astype("i2") - 128).astype("i1"), order))
    put(p, "a/float.mrc", planes.mrc_bytes(cube.astype("f4"), order))
    put(p, "swapped.mrc", planes.mrc_bytes(np.ascontiguousarray(cube.transpose(0, 2, 1)), order, axes=(2, 1, 3)))
    put(p, "strips.tif", planes.tiff_bytes(cube, order, 2))
    put(p, "white.tiff", planes.tiff_bytes(small, order, 3, photometric=0))
    put(p, "note.txt", b"not looked at")
    df = planes.planes(spark, p, 3)
    assert df.rdd.getNumPartitions() == 7 * 3  # slabs of 3, 3 and 1 planes
    rows = df.collect()
    done = {x.relative_path: x.transform for x in rows}
    assert np.array_equal(cube_of(rows, "a/plain.mrc"), cube) and done["a/plain.mrc"] == "identity"
    assert np.array_equal(cube_of(rows, "a/signed.rec"), cube) and done["a/signed.rec"] == "integer_offset"
    assert np.array_equal(cube_of(rows, "a/bytes.map"), small)
    assert np.array_equal(cube_of(rows, "a/float.mrc"), cube.astype("f4"))
    assert np.array_equal(cube_of(rows, "swapped.mrc"), cube)
    assert np.array_equal(cube_of(rows, "strips.tif"), cube)
    assert np.array_equal(cube_of(rows, "white.tiff"), 255 - small) and done["white.tiff"] == "unsigned_inversion"
    near = df.where("plane >= 2 and plane < 4")
    assert near.rdd.getNumPartitions() == 7 * 2 and sorted({(x.relative_path, x.plane) for x in near.collect()}) == sorted((n, z) for n in done for z in (2, 3))


def test_planes_read_only_their_own_ranges():
    """A slab of a file asks for its own bytes, and a TIFF's directories, and nothing else."""
    cube = np.arange(40 * 16 * 16, dtype="u2").reshape(40, 16, 16)
    for make, name, one, whole in ((planes.mrc_bytes, "a.mrc", planes.mrc_plane, planes.mrc_slab), (planes.tiff_bytes, "a.tif", planes.tiff_plane, planes.tiff_slab)):
        data, asked = make(cube), []

        def read(at, n):
            asked.append(n)
            return data[at : at + n]  # noqa: B023

        slab = whole(name, read, len(data))
        assert sum(asked) < len(data) / 10 and slab.last == 40
        asked.clear()
        assert np.array_equal(one(slab, read, 17)[0], cube[17])
        assert sum(asked) < 2 * 16 * 16 * 2


@pytest.mark.parametrize(
    "name,data,code",
    [
        ("a.mrc", lambda c: planes.mrc_bytes(c)[:-1], "mrc_payload_truncated"),
        ("a.mrc", lambda c: planes.mrc_bytes(c)[:900], "invalid_mrc_header"),
        ("a.mrc", lambda c: planes.mrc_bytes(c, axes=(3, 2, 1)), "unsupported_mrc_axis_mapping"),
        ("a.mrc", lambda c: planes.mrc_bytes(c)[:12] + b"\4\0\0\0" + planes.mrc_bytes(c)[16:], "unsupported_mrc_mode"),
        ("a.mrc", lambda c: b"\0" * 4 + planes.mrc_bytes(c)[4:], "invalid_mrc_dimensions"),
        ("a.tif", lambda c: b"II+\0" + planes.tiff_bytes(c)[4:], "BigTIFF"),
        ("a.tif", lambda c: planes.tiff_bytes(c, extra={planes.COMPRESSION: 5}), "unsupported_tiff_compression"),
        ("a.tif", lambda c: planes.tiff_bytes(c, extra={planes.ORIENTATION: 3}), "unsupported_tiff_orientation"),
        ("a.tif", lambda c: planes.tiff_bytes(c, extra={planes.SAMPLES: 3}), "unsupported_tiff_samples"),
        ("a.tif", lambda c: planes.tiff_bytes(c, photometric=2), "unsupported_tiff_photometric"),
        ("a.tif", lambda c: planes.tiff_bytes(c, extra={planes.ROWS_PER_STRIP: 2}), "invalid_tiff_strip_layout"),
        ("a.tif", lambda c: planes.tiff_bytes(c, extra={planes.BITS: 32}), "unsupported_tiff_bits"),
        ("a.tif", lambda c: planes.tiff_bytes(c, extra={planes.HEIGHT: 9}), "strip"),
    ],
)
def test_files_that_cannot_be_read_whole_raise(spark, tmp_path, name, data, code):
    put(str(tmp_path), name, data(np.ones((3, 5, 4), dtype="u2")))
    with pytest.raises(Exception, match=code):
        planes.planes(spark, str(tmp_path)).collect()


def test_an_empty_folder_has_no_planes(spark, tmp_path):
    assert planes.planes(spark, str(tmp_path)).count() == 0


# ---------------------------------------------------------------- M3, M5


def event_files(spark, path, n=6):
    rows = spark.range(600).select(F.col("id").alias("event_id"), (F.col("id") % 7).cast("double").alias("value"))
    rows.repartitionByRange(n, "event_id").write.parquet(path)
    return rows.schema, lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def counters():
    return {"rows": F.count("*"), "total": F.sum("value")}



def test_a_run_that_is_killed_between_batches_goes_on(spark, tmp_path, monkeypatch):
    files, out, whole = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "whole")
    schema, stream = event_files(spark, files)
    want = streams.checkpointed(stream(), whole, counters())
    assert want["phase"] == "completed" and want["counters"] == {"rows": 600, "total": sum(i % 7 for i in range(600))}

    commit, calls = streams.commit_batch, []

    def failing(batch, batch_id, *rest):
        calls.append(batch_id)
        if batch_id == 2:  # rows are written, the pointer is not
            batch.write.mode("overwrite").parquet(f"{out}/rows/batch=2")
            raise RuntimeError("killed")
        return commit(batch, batch_id, *rest)

    monkeypatch.setattr(streams, "commit_batch", failing)
    with pytest.raises(Exception, match="killed"):
        streams.checkpointed(stream(), out, counters())
    record = json.loads(read_text(spark, f"{out}/latest.json"))
    assert record["phase"] == "failed" and record["batch"] == 1 and record["counters"]["rows"] == 200
    assert streams.committed(spark, out, schema).count() == 200  # the unfinished batch is not seen
    monkeypatch.setattr(streams, "commit_batch", commit)
    assert streams.checkpointed(stream(), out, counters())["counters"] == want["counters"]
    assert streams.committed(spark, out, schema).select("event_id").distinct().count() == streams.committed(spark, out, schema).count() == 600
    assert sorted(os.listdir(f"{out}/progress"))[-1].startswith("000000005")
    assert streams.checkpointed(stream(), out, counters())["counters"] == want["counters"]  # nothing new


def test_a_batch_that_is_tried_again_counts_once(spark, tmp_path):
    out = str(tmp_path)
    batch = spark.range(10).withColumn("value", F.lit(2.0))
    for _ in range(2):
        record = streams.commit_batch(batch, 0, out, counters())
    assert record["counters"] == {"rows": 10, "total": 20.0}
    assert streams.committed(spark, out, batch.schema).count() == 10
    assert streams.committed(spark, str(tmp_path / "none"), batch.schema).count() == 0


def test_job_machine_keeps_the_last_lines():
    log, status = [], "queued"
    for kind, text in [("start", "scan"), ("line", "  "), *[("line", f"l{i}") for i in range(310)], ("cancel", ""), ("cancel", ""), ("failed", "1"), ("completed", ""), ("line", "late")]:
        status = streams.advance(status, log, kind, text)
    assert status == "cancelled" and len(log) == 300 and log[-3:] == ["Cancellation requested.", "Process cancelled.", "late"]
    assert streams.advance("cancel_requested", log, "start", "x") == "cancelled" and log[-1] == "Cancelled before process start."
    assert streams.advance("running", log, "failed", "code 3") == "failed" and log[-1] == "Process exited with status code 3."
    assert streams.advance("running", log, "completed", "") == "completed"


def test_job_states_across_batches(spark, tmp_path):
    kinds = ["start", *["line"] * 400, "cancel", "completed", "line"]
    rows = [("j", i, float(i), k, f"t{i}") for i, k in enumerate(kinds)] + [("k", 1000 + i, float(i), "line", f"k{i}") for i in range(3)]
    schema = "job_id string, event_id long, seconds double, kind string, line string"
    df = spark.createDataFrame(rows, schema)
    for i in range(3):  # files in the order of their times
        df.where((F.col("event_id") % 1000 >= 150 * i) & (F.col("event_id") % 1000 < (150 * i + 150 if i < 2 else 1000))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    updates = streams.drain(streams.job_states(stream), "update")
    got = {r.job_id: r.s for r in updates.groupBy("job_id").agg(F.max_by(F.struct("status", "log"), "epoch").alias("s")).collect()}
    log, status = [], "queued"
    batches = [r.event_id for r in spark.read.parquet(str(tmp_path / "in")).collect()]
    assert len(batches) == len(rows)
    for _, _, _, kind, line in rows[: len(kinds)]:
        status = streams.advance(status, log, kind, line)
    assert got["k"]["status"] == "queued" and list(got["k"]["log"]) == ["k0", "k1", "k2"]
    assert got["j"]["status"] == status == "cancelled" and list(got["j"]["log"]) == log


# ---------------------------------------------------------------- K7, R33


def chain(seen, fail=None):
    def stage(name, *inputs, version="1"):
        def build(f):
            seen.append(name)
            if name == fail:
                raise RuntimeError(f"{name} failed")
            return f[inputs[0]].withColumn(name, F.lit(len(inputs)))

        return runs.Stage(name, inputs, build, version)

    return stage


def test_chain_goes_on_where_it_failed_and_after_what_changed(spark, tmp_path):
    a, b, root = str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "root")
    spark.range(5).write.parquet(a)
    spark.range(3).write.parquet(b)
    sources, seen = {"a": a, "b": b}, []

    def stages(fail=None, version="1"):
        s = chain(seen, fail)
        return [s("one", "a"), s("two", "one"), s("three", "b", version=version), s("four", "two", "three")]

    with pytest.raises(RuntimeError):
        runs.run_chain(spark, root, stages("three"), sources)
    assert runs.published(spark, root) == {}  # nothing of a run that failed
    report = runs.run_chain(spark, root, stages(), sources)
    assert report == {"one": "kept", "two": "kept", "three": "built", "four": "built"}
    old = runs.published(spark, root)
    assert sorted(old) == ["four", "one", "three", "two"] and old["four"].count() == 5
    seen.clear()
    spark.range(9).write.mode("overwrite").parquet(b)
    with pytest.raises(RuntimeError):
        runs.run_chain(spark, root, stages("four"), sources)
    assert runs.published(spark, root)["three"].count() == 3  # the old set as a whole
    assert runs.run_chain(spark, root, stages(), sources) == {"one": "kept", "two": "kept", "three": "kept", "four": "built"}
    assert seen == ["three", "four", "four"] and runs.published(spark, root)["three"].count() == 9
    assert runs.run_chain(spark, root, stages(version="2"), sources) == {"one": "kept", "two": "kept", "three": "built", "four": "built"}
    assert len(runs.vacuum(spark, root)) == 4 and runs.published(spark, root)["four"].count() == 5
    assert runs.run_chain(spark, root, stages(version="2"), sources) == dict.fromkeys(("one", "two", "three", "four"), "kept")


def test_small_files_are_replaced_in_one_step(spark, tmp_path):
    path = str(tmp_path / "x/current.json")
    assert read_text(spark, path) is None
    for text in ("one", "ünï two", ""):
        replace_text(spark, path, text)
        assert read_text(spark, path) == text
    assert [f for f in os.listdir(tmp_path / "x") if not f.endswith(".crc")] == ["current.json"]


def test_the_catalog_follows_its_source_files(spark, tmp_path):
    for t in bindings.CATALOG_TABLES:
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    d = str(tmp_path)
    n = bindings.catalog(spark, d).count()
    kept = bindings.catalog(spark, d)
    assert bindings.catalog(spark, d) is kept and n == spark.read.parquet(f"{d}/orders.parquet").count()
    spark.read.parquet("/root/testdata/sf0.001/orders.parquet").limit(100).write.mode("overwrite").parquet(f"{d}/orders.parquet")
    assert bindings.catalog(spark, d).count() == 100


# ---------------------------------------------------------------- K10, A28, F19, O9


def test_a_chunk_with_one_wrong_byte_is_written_again(spark, tmp_path):
    grid = V.chunk_grid(spark, (5, 4, 4), (2, 4, 4))
    rows = [(c, 0, 0, c * 2, 0, 0, min(5, c * 2 + 2), 4, 4, bytearray(range(min(5, c * 2 + 2) * 16 - c * 32))) for c in range(3)]
    chunks = spark.createDataFrame(rows, V.CHUNKS)
    path, journal = str(tmp_path / "store"), str(tmp_path / "journal")
    assert [r.name for r in writers.resume_chunks(chunks.where("cz < 2"), grid, path, journal, 1).collect()] == ["2.0.0"]
    assert writers.resume_chunks(chunks, grid, path, journal, 1).count() == 0
    before = writers.journal_rows(spark, journal).count()
    with open(f"{path}/0/1.0.0", "r+b") as f:  # same length, one byte
        f.seek(7)
        f.write(b"\xff")
    assert writers.kept_chunks(writers.journal_rows(spark, journal), path).count() == 2
    stamp = os.stat(f"{path}/0/0.0.0").st_mtime_ns
    assert writers.resume_chunks(chunks, grid, path, journal, 1).count() == 0
    with open(f"{path}/0/1.0.0", "rb") as f:
        assert f.read() == bytes(rows[1][-1])
    assert os.stat(f"{path}/0/0.0.0").st_mtime_ns == stamp and before == 3
    assert spark.read.parquet(journal).count() == 4


def test_histogram_of_strided_chunks(spark):
    r = np.random.default_rng(0)
    a, b = r.integers(0, 256, 25_001, dtype="u1"), r.integers(0, 256, 9, dtype="u1")
    rows = [(0, 0, 0, 0, 0, 0, 1, 1, len(x), bytearray(x.tobytes())) for x in (a, b)]
    got = {x.bin: x.n for x in V.chunk_histogram(spark.createDataFrame(rows, V.CHUNKS)).collect()}
    want = np.bincount(np.concatenate([a[::2], b]), minlength=256)
    assert got == {i: n for i, n in enumerate(want.tolist()) if n}
    wide = np.array([0, 1, 257, 65534, 65535], dtype="<u2")
    got = {x.bin: x.n for x in V.chunk_histogram(spark.createDataFrame([(0, 0, 0, 0, 0, 0, 1, 1, 5, bytearray(wide.tobytes())), (1, 0, 0, 0, 0, 0, 1, 1, 0, bytearray())], V.CHUNKS), "<u2").collect()}
    assert got == {0: 2, 1: 1, 254: 1, 255: 1}
    with pytest.raises(ValueError):
        V.chunk_histogram(spark.createDataFrame(rows, V.CHUNKS), "<f4")


def test_token_ranges_are_pushed_to_the_scan(spark, tmp_path):
    texts = [(1, "Archive volume-7 Ünïts"), (2, "archival of the VOLUMES"), (3, None), (4, ""), (5, "arc vol"), (6, "zz 99 a"), (7, "日本語 volume")]
    df = spark.createDataFrame([(*t, "x", "y") for t in texts], "doc_id long, text string, token string, id string")
    path = str(tmp_path / "t")
    search.write_token_table(df, "doc_id", "text", path)
    ids = lambda q: sorted(r.id for r in search.search_tokens(spark, path, q).collect())
    assert ids("arch vol") == [1, 2] and ids("ARC+vo") == [1, 2, 5] and ids("ünï") == [1] and ids("zz z9") == [] and ids("99") == [6]
    assert ids("日本") == [7] and ids("a !") == [1, 2, 5, 6, 7]
    plan = search.search_tokens(spark, path, "vol")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(token,vol)" in plan and "LessThan(token,vom)" in plan


def test_pages_by_key_join_to_the_whole_order(spark):
    rows = [(i % 5 if i % 7 else None, f"p{i // 2:03d}", i) for i in range(230)]
    df = spark.createDataFrame(rows, "size long, path string, row long")
    order, last, got = ("size", "path", "row"), None, []
    while page := E.page_after(df, order, last, 37).collect():
        got += [tuple(r) for r in page]
        last = tuple(page[-1])
    assert got == [tuple(r) for r in df.orderBy(*order).collect()]
    assert len(E.page_after(df, order, None, 1000).collect()) == 100
    assert "TakeOrderedAndProject" in E.page_after(df, order, (2, "p", 3), 10)._jdf.queryExecution().toString()


# ---------------------------------------------------------------- J14, J15, J18


def test_registry_match_guards_and_gate(spark):
    sha = "ab" * 32
    a = "asset_id string, registry_id string, root string, relative_path string, digest string, size_bytes long, project_ready boolean, can_view boolean"
    d = "derivative_id long, asset_id string, registry_id string, source_sha256 string, source_size_bytes long, source_local_path string, output_path string, source_relative_path string"
    none = (None,) * 7
    assets = spark.createDataFrame([
        ("guarded", "r1", None, "g.tif", None, None, True, True), ("open", "r1", None, "o.tif", None, None, True, True), ("sum", "r1", None, "s.tif", sha.upper() + " ", 5, True, True), ("nosize", "r1", None, "n.tif", "cd" * 32, None, True, True),
        ("short", "r1", None, "h.tif", "ef", 5, True, True), ("local", "r1", "file:///data//x/", "/a/l.tif", None, None, True, True), ("suffix", "r1", "\\\\srv", "b/f.tif", None, None, True, True), ("two", "r1", None, "t.tif", None, None, True, True),
        ("shut", "r1", None, "o.tif", None, None, False, True), ("null", "r1", None, None, None, None, None, None), ("far", "r1", None, "nothing", None, None, True, True),
    ], a)
    derivatives = spark.createDataFrame([
        (1, "guarded", "r2", *none[2:]), (2, "open", None, *none[2:]), (3, None, None, sha, 6, None, None, None), (4, None, None, sha, 5, None, None, None), (5, None, None, "cd" * 32, 9, None, None, None), (6, None, None, "ef", 5, None, None, None),
        (7, None, None, None, None, "/data/x/a/l.tif", "/data/x/a/l.tif", None), (8, None, None, None, None, None, "z\\y\\b\\f.tif/", None), (9, None, None, None, None, None, None, "/t.tif"), (10, None, None, None, None, "q/t.tif", None, None), (11, *none),
    ], d)
    got = {r.asset_id: (r.status, r.derivative_id, r.matched_by) for r in M.registry_match(assets, derivatives).collect()}
    assert got == {
        "guarded": ("not-loaded", None, None), "open": ("ready", 2, "archive-identity"), "sum": ("ready", 4, "checksum"), "nosize": ("ready", 5, "checksum"), "short": ("not-loaded", None, None), "local": ("ready", 7, "local-path"),
        "suffix": ("ready", 8, "relative-path"), "two": ("ambiguous", None, None), "shut": ("blocked", None, None), "null": ("blocked", None, None), "far": ("not-loaded", None, None),
    }
    assert M.registry_match(assets.limit(0), derivatives).count() == 0
    assert {r.status for r in M.registry_match(assets, derivatives.limit(0)).collect()} == {"not-loaded", "blocked"}


def test_handoff_match_takes_the_only_best_dataset(spark):
    h = spark.createDataFrame([(1, "Set-1", None, []), (2, "none", "S-2", ["E 9"]), (3, None, None, ["EMPIAR-7", "empiar7", ""]), (4, "twin", "", None), (5, "empty", "S-2", None), (6, None, None, None), (7, "x", "y", ["q1", "q2"])], "handoff_id long, dataset_id string, source_study_id string, accessions array<string>")
    d = spark.createDataFrame([("set_1", "e1", 1), ("other", "s2", 2), ("a7", "EMPIAR 7", 1), ("twin", "u", 1), ("Twin", "v", 1), ("empty", None, 0), ("", "", 1), ("p", "q1", 1), ("r", "q2", 1)], "slug string, entry_id string, n_derivatives long")
    got = {r.handoff_id: (r.status, r.slug, r.matched_by) for r in M.handoff_match(h, d).collect()}
    assert got == {1: ("ready", "set_1", "dataset-id"), 2: ("ready", "other", "study-id"), 3: ("ready", "a7", "repository-accession"), 4: ("ambiguous", None, None), 5: ("pending", None, None), 6: ("pending", None, None), 7: ("ambiguous", None, None)}


def test_imageset_match_takes_the_first_that_fits(spark):
    files = spark.createDataFrame([("e", "d/sub/vol.mrc.tif"), ("e", "d/x.tif"), ("e", "k/stack_07.TIFF"), ("e", "k/none.bin"), ("one", "any.txt"), ("no", "a.tif")], "entry_id string, relative_path string")
    sets = spark.createDataFrame([("e", 0, "07", None), ("e", 1, None, "/d/sub/"), ("e", 2, "vol", ""), ("e", 3, "x", "d"), ("e", 4, "stack_07", None), ("one", 0, "unlike", "")], "entry_id string, pos long, name string, directory string")
    got = {(r.entry_id, r.relative_path): (r.pos, r.imageset) for r in M.imageset_match(files, sets).collect()}
    assert got == {("e", "d/sub/vol.mrc.tif"): (1, ""), ("e", "d/x.tif"): (3, "x"), ("e", "k/stack_07.TIFF"): (0, "07"), ("e", "k/none.bin"): (None, None), ("one", "any.txt"): (0, "unlike"), ("no", "a.tif"): (None, None)}


def test_a_key_that_all_rows_share_makes_no_pairs(spark):
    left = spark.range(3000).select(F.col("id"), F.lit("same").alias("k"))
    got = M.scored_best_match(left, spark.range(3000).select(F.col("id").alias("rid"), F.lit("same").alias("k")), "id", "rid", [(10, F.col("k"), F.col("k"))])
    assert got.groupBy("status").count().collect()[0]["count"] == 3000


# ---------------------------------------------------------------- R3, R17


def test_scaffold_names_every_missing_field(spark):
    raw = spark.createDataFrame([("0", "", "t", 0, ["a"], 0.5), (None, "x", "0", 1999, [], 0.0)], "dataset_id string, id string, title string, year int, organelles array<string>, metadata_completeness_score double")
    a, b = P.scaffold(raw).orderBy("year").collect()
    common = "metric_families, modality, organelle_pairs"
    assert a.warning == f"0: Missing required fields: cell_type, {common}, paper_title, source, species, year"
    assert b.warning == f"x: Missing required fields: cell_type, metadata_completeness_score, {common}, organelles, paper_title, source, species"
    assert (a.source_type, a.public_data_status, a.modality_family, a.sample_size_bucket, a.whole_cell_boundary_confirmed, b.dataset_id) == ("repository", "none", "other", "unknown", "unclear", "x")


def test_findings_of_assets_and_report(spark):
    none = [None] * 0
    assets = spark.createDataFrame([
        ("EMPIAR", "9", "s", "a.mrc", "needs_review", ["mrc_header_physical_scale_likely_default", "tiff_parse_warning:x", "preview_warning:dim"], ["trakem2_z_spacing_suspicious:5nm", ""], none, 1, None, 1, None),
        ("", None, "my set", "b.csv", "not_applicable", none, none, none, None, None, None, None),
    ], "dataset_source string, entry_id string, dataset_slug string, relative_path string, state string, warnings array<string>, blockers array<string>, review_notes array<string>, x long, y long, z long, scale_nm double")
    texts = ["a.mrc: MRC MAP marker missing or unexpected.", "a.mrc: API reports 3 images but local file has 4 slices.", "a.mrc: header physical scale is likely default", "API; collection-level metadata", "else", None]
    report = spark.createDataFrame([("", None, "my set", t) for t in texts], "dataset_source string, entry_id string, dataset_slug string, warning string")
    got = {r.code: r for r in P.findings(assets, report).collect()}
    assert sorted(got) == ["collection_level_image_count", "image_count_mismatch", "missing_physical_voxel_size", "missing_volume_dimensions", "mrc_header_physical_scale_likely_default", "mrc_map_marker_unexpected", "tiff_parse_warning", "trakem2_z_spacing_suspicious"]
    assert got["missing_volume_dimensions"].finding_id == "empiar-9-volume-geometry-a-mrc-missing-volume-dimensions" and got["missing_volume_dimensions"].evidence[0].value == '{"x":1,"z":1}'
    assert got["collection_level_image_count"].finding_id == "source-my-set-repository-metadata-dataset-collection-level-image-count"
    assert got["tiff_parse_warning"].evidence[0].value == "tiff_parse_warning:x" and got["image_count_mismatch"].asset_relative_path == "a.mrc"


# ---------------------------------------------------------------- exact ranks


def test_ranks_of_large_groups_come_from_a_bracket(spark):
    rng = np.random.default_rng(3)
    frames = [pd.DataFrame({"g": "wide", "v": rng.normal(size=4000)}), pd.DataFrame({"g": "ties", "v": rng.integers(0, 4, 3000).astype(float)}), pd.DataFrame({"g": "few", "v": [3.0, 1.0, 2.0]})]
    df = spark.createDataFrame(pd.concat(frames))
    wanted = {"low": (0.01, F.floor((F.col("n") - 1) * 0.01) + 1), "mid": (0.5, F.ceil(F.col("n") / 2)), "top": (1.0, F.col("n"))}
    got = {r.g: r for r in C.values_at_ranks(df, "g", "v", wanted, accuracy=100).collect()}
    for f in frames:
        v = np.sort(f["v"].to_numpy())
        n = len(v)
        r = got[f["g"].iloc[0]]
        assert (r.low, r.mid, r.top) == (v[int((n - 1) * 0.01)], v[-(-n // 2) - 1], v[-1])


def test_many_small_volumes_share_partitions(spark, tmp_path, monkeypatch):
    """Beyond PARTITIONS, neighbouring slabs are read by one task, and the headers of small files by their tasks alone; the planes are the same."""
    cube = np.arange(6 * 4 * 3, dtype="u2").reshape(6, 4, 3)
    for i in range(planes.PARTITIONS + 60):
        put(str(tmp_path), f"{i % 3}/{i}" + (".mrc", ".tif")[i % 2], (planes.mrc_bytes, planes.tiff_bytes)[i % 2](cube + np.uint16(i)))
    big = np.arange(400 * 64 * 64, dtype="u2").reshape(400, 64, 64)
    put(str(tmp_path), "big.mrc", planes.mrc_bytes(big))
    df = planes.planes(spark, str(tmp_path), 2)
    assert df.rdd.getNumPartitions() <= planes.PARTITIONS + 1
    got = df.where("relative_path <> 'big.mrc'").collect()
    assert len(got) == (planes.PARTITIONS + 60) * 6
    for r in got:
        i = int(r.relative_path.split("/")[1].split(".")[0])
        assert bytes(r.raw) == (cube + np.uint16(i))[r.plane].tobytes()
    assert df.where("relative_path = 'big.mrc'").count() == 400 and df.where("plane = 5").count() == planes.PARTITIONS + 61
    reader, asked = planes.PlaneReader(str(tmp_path), 2), []
    monkeypatch.setattr(reader, "_headers", lambda name, old=reader._headers: asked.append(name) or old(name))
    parts = reader.partitions()
    assert asked == ["big.mrc"] and len({s.name for p in parts for s in p.slabs}) == planes.PARTITIONS + 61
    assert len([s for p in parts for s in p.slabs if s.name == "big.mrc"]) == 200

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasforge.operators import estate as E
from atlasforge.operators import matching
from atlasforge.operators import volume as V
from atlasforge.plans.source_queries import mrc_bytes, tiff_bytes
from atlasforge.sources import readers, volumes
from atlasforge.streaming import streams


def files(spark, *rows):
    return spark.createDataFrame(rows, "walk_pos long, relative_path string, digest string, size_bytes long")


def test_duplicates_point_to_the_first_in_walk_order(spark):
    df = files(spark, (3, "a/z", "x", 1), (1, "b/y", "x", 1), (2, "c", "y", 1))
    assert [(r.relative_path, r.duplicate_of) for r in E.duplicates(df).collect()] == [("a/z", "b/y")]


def test_copy_rules_in_order(spark):
    s = files(spark, (1, "same", "d", 1), (2, "size", "d", 1), (3, "gone", "d", 1), (4, "sum", "d", 1), (5, "none", None, 1))
    t = files(spark, (1, "same", "d", 1), (2, "size", "e", 2), (4, "sum", "e", 1), (6, "new", "d", 1), (5, "none", None, 1))
    got = sorted((r.relative_path, r["rank"], r.issue_type) for r in E.copy_verification(s, t, True).collect())
    assert got == [("gone", 0, "missing_in_target"), ("new", 0, "unexpected_in_target"), ("none", 0, "missing_source_checksum"), ("none", 1, "missing_target_checksum"), ("size", 0, "size_mismatch"), ("size", 1, "checksum_mismatch"), ("sum", 0, "checksum_mismatch")]


def test_prefix_rollup_respects_separators(spark):
    df = files(spark, (1, "a/b/c", "x", 5), (2, "a/bc/d", "x", 7), (3, "top", "x", 1))
    p = spark.createDataFrame([("a/b",), ("a",), ("q",)], "prefix string")
    assert {r.prefix: (r.n_files, r.bytes) for r in E.prefix_rollup(p, df).collect()} == {"a/b": (1, 5), "a": (2, 12), "q": (0, 0)}


def test_latest_by_rank_takes_the_later_of_equals(spark):
    df = spark.createDataFrame([("k", 1, 1, "a"), ("k", 2, 2, "b"), ("k", 2, 3, "c"), ("k", 1, 9, "d")], "key string, rank int, pos int, v string")
    assert E.latest_by_rank(df, ["key"], "rank", "pos").first().v == "c"


def test_workset_limits_before_it_sorts_and_reports_after(spark):
    df = spark.createDataFrame([(i, f"p{9 - i}", f"a{i}", i % 2 == 0, False, False) for i in range(6)], "walk_pos long, relative_path string, asset_id string, is_candidate boolean, project_ready boolean, conversion_ready boolean")
    assert [r.asset_id for r in E.workset(df, F.lit(True), 3).collect()] == ["a2", "a0", "a1"]
    assert [r.asset_id for r in E.report_order(df, F.lit(True), 3).collect()] == ["a4", "a2", "a0"]
    with pytest.raises(ValueError):
        E.workset(df, F.lit(True), 10_001)


def test_scored_match_needs_a_unique_best(spark):
    left = spark.createDataFrame([(1, "A", "x"), (2, None, "y"), (3, "", "q")], "id long, ident string, path string")
    right = spark.createDataFrame([(10, "A", "z"), (11, "B", "x"), (12, None, "y"), (13, None, "y")], "rid long, ident string, path string")
    got = matching.scored_best_match(left, right, "id", "rid", [(400, F.col("ident"), F.col("ident")), (100, F.col("path"), F.col("path"))])
    assert {r.id: (r.status, r.match_id, r.score) for r in got.collect()} == {1: ("matched", 10, 400), 2: ("ambiguous", None, 100), 3: ("unmatched", None, None)}


def test_exact_segmentation_metrics(spark):
    rows = [(1, 1)] * 7 + [(1, 0)] + [(0, 1)] + [(0, 0)] * 15
    df = spark.createDataFrame(rows, "p int, t int")
    m = V.confusion(df, F.col("p"), F.col("t")).first()
    assert (m.tp, m.fp, m.fn, m.tn, m.dice, m.recall, m.false_positive_rate) == (7, 1, 1, 15, 0.875, 0.875, 1 / 16) and m.iou == pytest.approx(7 / 9)
    empty = V.confusion(df.limit(0), F.col("p"), F.col("t")).first()
    assert empty.tp == 0 and empty.dice is None
    assert V.acceptance(V.confusion(df, F.col("p"), F.col("t")), {"dice": 0.9}).first().acceptance == "failed"


def test_chunk_labels_and_grid(spark):
    vox = spark.createDataFrame([(r, c, float(r * 4 + c)) for r in range(5) for c in range(4)], "row long, position int, value double")
    chunks = V.to_chunks(vox, 2, 4)
    assert sorted((c.z0, c.z1, len(c.raw)) for c in chunks.collect()) == [(0, 2, 32), (2, 4, 32), (4, 5, 16)]
    labels = V.threshold_chunks(chunks, "ge", 10.0)
    got = V.evaluate_chunks(labels, V.threshold_chunks(chunks, "gt", 10.0)).first()
    assert (got.tp, got.fp, got.fn, got.tn) == (9, 1, 0, 10)
    grid = V.chunk_grid(spark, (3, 4, 5), (2, 2, 2))
    assert grid.count() == 2 * 2 * 3 and grid.agg(F.sum("voxels")).first()[0] == 60
    stored = spark.createDataFrame([("0.0.0", 8), ("0.0.1", 7)], "name string, length long")
    assert V.missing_chunks(grid, stored, 1).count() == 11


def test_reversible_transforms():
    a = np.array([-128, 0, 127], dtype=np.int8)
    assert V.reversible(a, "int8").tolist() == [0, 128, 255]
    assert V.reversible(np.array([-32768, 32767], dtype=np.int16), "int16").tolist() == [0, 65535]
    assert V.reversible(V.reversible(np.array([0, 9], dtype=np.uint8), "inverted"), "inverted").tolist() == [0, 9]


def test_headers(spark):
    big = tiff_bytes(30, 20, 20.0)
    rows = [("a.tif", big), ("b.mrc", mrc_bytes(4, 3, 2)), ("c.h5", volumes.HDF5_MAGIC), ("d.tif", big[:60]), ("e.bin", b"xx"), ("f.tif", b"II+\0" + b"\0" * 12), ("g.tif", b"")]
    got = {r.relative_path: r for r in volumes.headers(spark.createDataFrame([(p, bytearray(b)) for p, b in rows], "relative_path string, content binary")).collect()}
    assert (got["a.tif"].x, got["a.tif"].y, got["a.tif"].z, got["a.tif"].voxel_x_nm, got["a.tif"].voxel_z_nm) == (30, 20, 7, 20.0, 20.0)
    assert (got["b.mrc"].dtype, got["b.mrc"].voxel_y_nm) == ("uint16", 2.0)
    assert got["c.h5"].status == "detected" and got["d.tif"].status == got["f.tif"].status == "unreadable" and got["e.bin"].status == "unsupported"
    loop = struct.pack("<2sHIHI", b"II", 42, 8, 0, 8)
    with pytest.raises(ValueError):
        volumes.tiff_directories(loop)


def test_zarr_scale_of_the_nearest_ancestor(spark):
    attrs = lambda path, scale: json.dumps({"multiscales": [{"axes": [{"name": n, "unit": "micrometer"} for n in "zyx"], "datasets": [{"path": path, "coordinateTransformations": [{"type": "scale", "scale": scale}]}]}]})
    arrays = spark.createDataFrame([("a/b/0/.zarray", '{"shape": [6, 5, 4], "chunks": [3, 2, 2], "dtype": "<u2"}'), ("q/.zarray", '{"shape": [1], "chunks": [1], "dtype": "|u1"}')], "relative_path string, text string")
    zattrs = spark.createDataFrame([("a/.zattrs", attrs("b/0", [9.0, 9.0, 9.0])), ("a/b/.zattrs", attrs("0", [0.03, 0.02, 0.01]))], "relative_path string, text string")
    got = {r.array_path: r for r in volumes.array_report(volumes.zarr_scale(arrays, zattrs)).collect()}
    assert got["a/b/0"].z_nm == pytest.approx(30) and got["a/b/0"].x_nm == pytest.approx(10) and got["a/b/0"].report == "ready"
    assert got["q"].z_nm is None and got["q"].report == "unsupported"


def test_readers(spark, tmp_path):
    assert readers.unique_headers(["a", None, "a", " "]) == ["a", "unnamed_2", "a_2", "unnamed_4"]
    (tmp_path / "m.tsv").write_text("path\turl\tsize\na\thttp://x\t12\nb\t\t3\nc\thttp://y\tbig\n")
    assert [tuple(r) for r in readers.download_manifest(spark, str(tmp_path / "m.tsv")).orderBy("path").collect()] == [("a", "http://x", 12), ("c", "http://y", None)]
    (tmp_path / "t.csv").write_text('a,b\n"x\ny","q ""z"""\n')
    assert tuple(readers.csv_strings(spark, str(tmp_path / "t.csv"), ["a", "b"]).first()) == ("x\ny", 'q "z"')
    (tmp_path / "deep/er").mkdir(parents=True)
    (tmp_path / "deep/er/f.bin").write_bytes(b"abc")
    assert ("deep/er/f.bin", 3) in [(r.relative_path, r.size_bytes) for r in readers.archive_files(spark, str(tmp_path)).collect()]


def test_rate_limit_drops_rejected_hits(spark):
    assert streams.admit([0, 1, 2, 3600, 3601], [], 2)[0] == [True, True, False, False, True]
    got = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    from atlasforge.plans.source_queries import rate_limited_events

    rows = {r.event_id: r.admitted for r in rate_limited_events(spark, "/root/testdata/sf0.001").collect()}
    by_user: dict = {}
    for r in got.select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s")).orderBy("s", "event_id").collect():
        by_user.setdefault(r.user_id, []).append((r.s, r.event_id))
    for events in by_user.values():
        ok, _ = streams.admit([float(s) for s, _ in events], [], 5, 6 * 3600)
        assert [rows[e] for _, e in events] == ok


def test_headers_that_are_partly_readable():
    import struct

    from atlasforge.plans.source_queries import mrc_bytes, tiff_bytes
    from atlasforge.sources import volumes

    big = bytearray(tiff_bytes(9, 8, 2.0))
    (n,) = struct.unpack_from("<H", big, 8)
    struct.pack_into("<I", big, 10 + 12 * n, 10_000)  # the next directory would lie outside the file
    assert volumes.header("a.tif", bytes(big))[1] == "readable" and len(volumes.tiff_directories(bytes(big))) == 1
    odd = bytearray(mrc_bytes(4, 3, 2))
    struct.pack_into("<i", odd, 12, 12)
    assert volumes.header("a.mrc", bytes(odd))[1:7] == ("readable", "MRC", 4, 3, 2, "mrc-mode-12")
    struct.pack_into("<i", odd, 8, 0)
    assert volumes.header("a.mrc", bytes(odd))[1:6] == ("partial", "MRC", None, None, None)
    struct.pack_into("<f", odd, 44, 0.0)
    assert volumes.header("a.mrc", bytes(odd))[7:] == (None, None, None)


def test_chunks_are_packed_as_a_stream(spark):
    """Voxels arrive in order in batches of a few rows; no group of them is gathered, and chunks cut by batches are whole."""
    rows = [(r, p, float(r * 4 + p) if (r, p) != (5, 2) else None) for r in range(0, 23) for p in range(4) if r not in (8, 9)]
    vox = spark.createDataFrame(rows[::-1], "row long, position int, value double")
    chunks = V.to_chunks(vox, 2, 4)
    assert "collect_list" not in chunks._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {c.cz: c for c in chunks.collect()}
        with pytest.raises(Exception, match="whole type"):
            V.to_chunks(vox.withColumn("value", F.col("value").cast("int")), 2, 4, "<u2").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got) == [0, 1, 2, 3, *range(5, 12)]
    for cz, c in got.items():
        want = np.array([np.nan if v is None else v for r, p, v in rows if r // 2 == cz], "<f4")
        assert np.array_equal(np.frombuffer(c.raw, "<f4"), want, equal_nan=True)
        assert (c.cy, c.cx, c.z0, c.y0, c.x0, c.z1, c.y1, c.x1) == (0, 0, 2 * cz, 0, 0, 2 * cz + len(want) // 4, 1, 4)

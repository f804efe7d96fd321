import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasforge.operators import catalog, public_data, registry
from atlasforge.operators import volume as V
from atlasforge.sinks import writers
from atlasforge.sources import readers


def test_catalog_from_manifests(spark):
    locators = spark.createDataFrame([("L1", "S1", "Homo sapiens, HeLa", "human", "FIB-SEM", "4", "4 x 4", "", "ER;Golgi", "er", "12", "short", "a; b", "included", "2020", "J"), ("L2", "S2", "x", "y", "z", "", "", "", "", "", "", "", "", "included", "2020", "")], "dataset_locator_id string, study_id string, cell_type string, organism_type string, imaging_modality string, xy_nm string, z_nm string, unused string, organelles_common string, organelles_specialized string, min_sample_size string, sample_size_notes string, public_locator_urls string, included_status string, year string, journal_published string")
    studies = spark.createDataFrame([("S1", 1, "Old", "1", "volume", "", "included"), ("S1", 2, "New", " 77 ", "volume; #", "stress", "included"), ("S2", 3, "No", "", "", "", "borderline")], "study_id string, pos int, title string, pmid string, quantifications string, comparators_conditions string, included_status string")
    public = spark.createDataFrame([("S1", 1, "Full dataset provided")], "study_id string, pos int, availability_scope_note string")
    rows = public_data.build_catalog(locators, studies, public).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.paper_title, r.public_data_status, r.species, r.modality_family, r.organelles, r.organelle_pairs, r.metric_families) == ("New", "complete", "Homo sapiens", "EM", ["er", "golgi"], ["er:golgi"], ["volume", "count"])
    assert (r.isotropic, r.sample_size_bucket, r.notes, r.publication_pmid, r.public_locator_urls, r.metadata_completeness_score) == (True, "11-50", "Public data available. short", "77", ["a", "b"], 1.0)


def test_warnings_and_readiness(spark):
    cols = "relative_path string, size_bytes long, sha256 string, format string, nx long, mx long, cell_x long, tiff_error string, trakem2_z_nm long, preview_warning string, scale_source string, x int, y int, z int, scale_nm double, preview string"
    base = ("a", 10, "s", "MRC", 4, 4, 4, None, None, None, "citation_details", 1, 1, 1, 5.0, "p")
    rows = [base, ("b", *base[1:10], "header", *base[11:]), ("c", *base[1:3], "CSV", *base[4:]), ("d", *base[1:4], 1, *base[5:8], 20, *base[9:14], None, "p")]
    df = public_data.conversion(public_data.asset_states(public_data.split_warnings(spark.createDataFrame(rows, cols).withColumn("warnings", public_data.warnings()))))
    got = {r.relative_path: (r.state, r.readiness, r.conversion_blockers) for r in df.collect()}
    assert got["a"] == ("validated", "ready_with_review_notes", [])
    assert got["b"][:2] == ("needs_review", "blocked") and got["c"] == ("not_applicable", "not_a_volume", [])
    assert got["d"][2] == ["missing_physical_voxel_size", "trakem2_z_spacing_suspicious:20nm"]
    found = public_data.asset_findings(df.withColumns({"dataset_source": F.lit("s"), "entry_id": F.lit("1"), "dataset_slug": F.lit("d")}))
    assert sorted((r.asset_relative_path, r.code) for r in found.collect()) == [("a", "mrc_header_physical_scale_likely_default"), ("b", "mrc_header_physical_scale_likely_default"), ("d", "missing_physical_voxel_size"), ("d", "trakem2_z_spacing_suspicious")]


def test_repository_identity(spark):
    urls = ["https://www.ebi.ac.uk/empiar/EMPIAR-123/", "https://figshare.com/articles/dataset/name/456?x=1", "https://zenodo.org/records/789", "https://Other.org/x", "not a url", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    got = [tuple(r.r) for r in df.select("i", public_data.repository_identity(F.col("u")).alias("r")).orderBy("i").collect()]
    assert got == [("EMPIAR", "123"), ("Figshare", "456"), ("Zenodo", "789"), ("other.org", None), (None, None), (None, None)]


def test_series_and_imagesets(spark):
    df = spark.createDataFrame([("d/p2_a.tif", 1, 5, 5, 1), ("d/p10_a.TIF", 2, 5, 5, 1), ("d/p3_a.tif", 4, 6, 5, 1), ("q.tif", 1, 5, 5, 1), ("p7_a.tif", 1, 5, 5, 2)], "relative_path string, size_bytes long, x int, y int, z int").withColumn("format", F.lit("TIFF"))
    assert [tuple(r) for r in public_data.tiff_series(df).collect()] == [("d/p2-10_a.tiff-series", 2, 3, "d/p2_a.tif", "d/p10_a.TIF")]


def test_upserts(spark):
    old = spark.createDataFrame([("a", 2, 1, "x"), ("b", 1, 1, "y")], "k string, rank int, pos int, v string")
    new = spark.createDataFrame([("a", 1, 2, "low"), ("b", 1, 2, "same"), ("c", 0, 3, "new")], "k string, rank int, pos int, v string")
    assert {r.k: r.v for r in registry.upsert_if_ranked(old, new, ["k"], "rank", "pos").collect()} == {"a": "x", "b": "same", "c": "new"}
    assert {r.k: r.v for r in public_data.upsert(old, new, ["k"]).collect()} == {"a": "low", "b": "same", "c": "new"}


def test_overlay_words(spark):
    df = spark.createDataFrame([(w,) for w in (None, "", "Yes", "0", "none", "a; b,")], "w string")
    assert [r[0] for r in df.select(registry.overlay_list(F.col("w"))).collect()] == [None, None, ["Yes"], ["0"], [], ["a", "b"]]
    words = spark.createDataFrame([(w,) for w in (None, "", "Yes", "0")], "w string")
    assert [r[0] for r in words.select(registry.overlay_flag(F.col("w"))).collect()] == [None, None, True, False]
    with pytest.raises(Exception, match="not a yes or no"):
        df.where("w = 'none'").select(registry.overlay_flag(F.col("w"))).collect()


def test_selection_and_labels(spark):
    df = spark.createDataFrame([("M1",), ("M12",), ("X3",)], "label string")
    assert registry.next_label(df).first().label == "M13" and registry.next_label(df.limit(0)).first().label == "M1"
    with pytest.raises(ValueError, match="ambiguous"):
        registry.exactly_one(df, F.lit(True))
    with pytest.raises(ValueError, match="no asset"):
        registry.exactly_one(df, F.lit(False))
    pairs = spark.createDataFrame([(1, "a", "x", "s", "c"), (2, "b", "y", "s", "c"), (3, "c", "x", "t", None)], "pos int, dataset_id string, cell_type string, species string, comparator_class string")
    assert tuple(registry.example_pair(pairs).first()) == ("a", "c")
    assert tuple(registry.example_pair(pairs.where("pos < 3")).first()) == ("a", "b")


def test_chunk_store_is_resumable(spark, tmp_path):
    vox = spark.createDataFrame([(r, c, float(r + c)) for r in range(6) for c in range(4)], "row long, position int, value double")
    chunks, path = V.to_chunks(vox, 2, 4), str(tmp_path / "store")
    writers.store_chunks(chunks.where("cz < 2"), path)
    writers.store_chunks(chunks, path)
    assert sorted(r.cz for r in writers.load_chunks(spark, path).collect()) == [0, 1, 2] and writers.load_chunks(spark, path, 1).count() == 1
    meta = writers.array_metadata((6, 1, 4), (2, 1, 4), "<f4", (1.0, 2.0, 3.0))
    assert json.loads(meta["0/.zarray"])["chunks"] == [2, 1, 4]
    image = writers.slice_images(chunks, 3, 1).orderBy("cz").first()
    assert bytes(image.png[:8]) == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", image.png[16:24]) == (2, 1)


def test_image_helpers():
    a = np.array([[0.0, 1.0], [np.nan, 3.0]])
    assert writers.stretch(a, 0, 100).tolist() == [[0, 85], [0, 255]] and writers.stretch(np.full((2, 2), 7.0)).tolist() == [[0, 0], [0, 0]]
    data = writers.png(np.array([[1, 2], [3, 4]], dtype=np.uint8))
    assert zlib.decompress(data[41:-16]) == bytes([0, 1, 2, 0, 3, 4])


def test_exports_and_publication(spark, tmp_path):
    rows = spark.createDataFrame([("=1+1", 1), ("b", 2)], "t string, n int")
    writers.write_csv(rows, str(tmp_path / "csv"))
    assert {r.t for r in readers.csv_strings(spark, str(tmp_path / "csv"), ["t", "n"]).collect()} == {"'=1+1", "b"}
    writers.refresh(rows, str(tmp_path / "table"))
    writers.refresh(rows.limit(1), str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1
    with pytest.raises(FileNotFoundError):
        writers.publish(spark, {str(tmp_path / "nowhere"): str(tmp_path / "table")})
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1
    text = writers.markdown_report("R", spark.createDataFrame([("ready", 2)], "name string, n long"), spark.createDataFrame([("p", "blocked")], "relative_path string, readiness string"))
    assert "| ready | 2 |" in text and "`p` (blocked)" in text


def test_volume_planes(spark):
    rows = [(0, 0, 0, 0, 0, 0, 1, 2, 2, bytearray([1, 0, 0, 1])), (1, 0, 0, 1, 0, 0, 2, 2, 2, bytearray([0, 0, 0, 0]))]
    chunks = spark.createDataFrame(rows, V.CHUNKS)
    assert sorted((r.u, r.v) for r in V.slice_plane(chunks, "x", 1).where("value = 1").collect()) == [(0, 1)]
    got = V.label_report(chunks).first()
    assert (got.foreground, got.z_max, got.usable) == (2, 0, True)
    assert V.probe(chunks, 0, 1, 1, (1000.0, 1.0, 1.0)).first().value == 1
    data = bytes(4) + bytes(range(8))
    planes = V.read_planes(spark.createDataFrame([("v", bytearray(data))], "relative_path string, content binary"), 2, 2, "u1", 4)
    assert [bytes(r.raw) for r in planes.orderBy("plane").collect()] == [bytes(range(4)), bytes(range(4, 8))]


def test_plan_is_one_scan_and_pruned(spark):
    from atlasforge.sources import bindings

    shown = lambda rows: catalog.toolkit_matrix(rows)._jdf.queryExecution().executedPlan().toString()
    loading = shown(bindings.catalog_rows(spark, "/root/testdata/sf0.001"))
    assert loading.count("lineitem.parquet") == 1 and "l_extendedprice" not in loading
    table = bindings.catalog(spark, "/root/testdata/sf0.001")
    plan = shown(table)
    assert plan.count("FileScan parquet") == 1 and "title" not in plan
    assert table is bindings.catalog(spark, "/root/testdata/sf0.001")  # loaded once
    year = table.where("year = 1995")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in year


def tiff_file(planes, order="<", rows_per_strip=2):
    """A classic TIFF of uint16 planes in strips."""
    import struct

    body, at, directories = bytearray(b"II*\0" if order == "<" else b"MM\0*") + bytes(4), None, []
    for a in planes:
        h, w = a.shape
        offsets, sizes = [], []
        for y in range(0, h, rows_per_strip):
            raw = a[y : y + rows_per_strip].astype(order + "u2").tobytes()
            offsets.append(len(body))
            sizes.append(len(raw))
            body += raw
        lists = []
        for values in (offsets, sizes):
            lists.append(len(body))
            body += struct.pack(f"{order}{len(values)}I", *values)
        entries = [(256, 4, 1, w), (257, 4, 1, h), (258, 4, 1, 16), (259, 4, 1, 1), (273, 4, len(offsets), lists[0] if len(offsets) > 1 else offsets[0]), (277, 4, 1, 1), (279, 4, len(sizes), lists[1] if len(sizes) > 1 else sizes[0])]
        directories.append(len(body))
        body += struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHII", *e) for e in entries) + bytes(4)
    for n, at in enumerate(directories):
        link = 4 if n == 0 else directories[n - 1] + 2 + 12 * 7
        struct.pack_into(order + "I", body, link, at)
    return bytes(body)


def test_tiff_planes_become_a_published_chunk_store(spark, tmp_path):
    import json

    import numpy as np

    from atlasforge.sinks import writers

    cube = np.random.default_rng(3).integers(0, 60_000, (5, 7, 6)).astype(np.uint16)
    files = spark.createDataFrame([("a.tif", bytearray(tiff_file(cube))), ("b.tif", bytearray(tiff_file(cube, ">", 3)))], "relative_path string, content binary")
    planes = V.tiff_planes(files)
    for p in ("a.tif", "b.tif"):
        got = planes.where(f"relative_path = '{p}'").orderBy("plane").collect()
        assert [(r.height, r.width, r.dtype) for r in got] == [(7, 6, "<u2")] * 5 and b"".join(bytes(r.raw) for r in got) == cube.tobytes()
    shape, sizes = cube.shape, (2, 4, 4)
    chunks = V.chunked(planes.where("relative_path = 'b.tif'"), shape, sizes, 2)
    out = str(tmp_path / "store")
    convert = lambda gate="ready", digest="d", rows=chunks: writers.convert_asset(rows, gate, digest, "d", shape, sizes, "<u2", (30.0, 4.0, 4.0), out)
    for bad in (dict(gate="blocked"), dict(digest="x"), dict(rows=chunks.where("cz = 0"))):
        with pytest.raises(ValueError):
            convert(**bad)
    assert not (tmp_path / "store").exists()
    recipe = convert()  # the chunks of the run that stopped are kept
    assert recipe == convert(rows=chunks.limit(0)) and json.loads((tmp_path / "store" / "recipe.json").read_text())["recipe"] == recipe
    back = np.zeros_like(cube)
    for f in (tmp_path / "store" / "0").iterdir():
        if not f.name.startswith("."):
            at = tuple(slice(int(c) * n, min((int(c) + 1) * n, m)) for c, n, m in zip(f.name.split("."), sizes, shape, strict=True))
            back[at] = np.frombuffer(f.read_bytes(), "<u2").reshape(back[at].shape)
    assert np.array_equal(back, cube)
    with pytest.raises(Exception, match="truncated|outside|early"):
        V.tiff_planes(spark.createDataFrame([("c.tif", bytearray(tiff_file(cube)[:-40]))], "relative_path string, content binary")).collect()


def test_curated_lookup_broadcasts_no_keys(spark):
    """Keys are many times the rows: only the pairs of lengths are broadcast, and rows are found by any ending and beginning, as by contains()."""
    from atlasforge.sources import readers

    texts = ["see abc-123 and xabc45", "ABC1234; Q-7", "zabc-12", "bc12 abc", "abc - 12", "", None, "A1B22C333"]
    ids = ["ABC-12", "abc123", "BC-1", "Q7", "q-77", "ABC", "12", "", None, "C-33", "B2", "A-9"]
    curated = spark.createDataFrame([(len(texts) - i, t) for i, t in enumerate(texts)], "pos int, text string")
    entries = spark.createDataFrame([(i, e) for i, e in enumerate(ids)], "n int, entry_id string")
    got = readers.curated_lookup(entries, curated, "entry_id", "pos")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("BroadcastExchange") == 1
    for r in got.collect():
        name = (r.entry_id or "").upper().replace("-", "")
        whole = name.isalnum() and name[0].isalpha() and name[-1].isdigit()
        cut = len(name.rstrip("0123456789"))
        wanted = [(len(texts) - i, t) for i, t in enumerate(texts) if whole and t and (name in t.upper() or f"{name[:cut]}-{name[cut:]}" in t.upper())]
        assert (tuple(r.curated) if r.curated else None) == (min(wanted) if wanted else None), r.entry_id

import pytest
from pyspark.sql import functions as F

from atlasforge.functions import normalize as N


def value(spark, column, **kw):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in kw.items()]) if kw else spark.range(1)
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "want"),
    [("10.6019/EMPIAR-10392", ["https://www.ebi.ac.uk/empiar/EMPIAR-10392/"]), ("see https://x.org/a). and empiar-1", ["https://x.org/a", "https://www.ebi.ac.uk/empiar/EMPIAR-1/"]), ("10.5281/zenodo.12", ["https://doi.org/10.5281/zenodo.12"]), ("", [])],
)
def test_urls(spark, text, want):
    assert value(spark, N.extract_urls(F.col("t")), t=text) == want


def test_text_helpers(spark):
    assert value(spark, N.clean(F.lit(" a  b\n"))) == "a b"
    assert value(spark, N.slug(F.lit("Ünï Code!"))) == "n-code"
    assert value(spark, N.slug(F.lit("Ünï Code!"), unicode=True)) == "ünï-code"
    assert value(spark, N.split_terms(F.lit('ER; "Golgi", er'), F.lit(None).cast("string"))) == ["er", "golgi"]
    assert value(spark, N.pairs(F.array(F.lit("c"), F.lit("a"), F.lit("b"), F.lit("a")))) == ["a:b", "a:c", "b:c"]
    assert value(spark, N.pairs(F.array().cast("array<string>"))) == []
    assert value(spark, N.mean_numeric(F.lit("3 x 4.5 nm"))) == 3.75
    assert value(spark, N.mean_numeric(F.lit("none"))) is None
    assert value(spark, N.first_int(F.lit("about 1,234 and 5"))) == 1234


def test_normalised_traits(spark):
    assert value(spark, N.modality_family(F.lit("FIB-SEM"))) == "EM"
    assert value(spark, N.modality_family(F.lit("soft X-ray"))) == "X-ray"
    assert value(spark, N.metric_families(F.lit("Volume fraction; # of cells, volume, volume"))) == ["volume_fraction", "count", "volume"]
    assert value(spark, N.comparator_class(F.lit(" "))) is None
    assert value(spark, N.comparator_class(F.lit("drug treatment"))) == "treatment"
    assert value(spark, N.species(F.lit("Homo sapiens"), F.lit("x"))) == "Homo sapiens"
    assert value(spark, N.species(F.lit("T. brucei"), F.lit("x"))) == "T. brucei"
    assert value(spark, N.species(F.lit("yeast"), F.lit(""))) == "yeast"
    assert [value(spark, N.sample_size_bucket(F.lit(n).cast("int"))) for n in (None, 0, 1, 2, 10, 11, 50, 51)] == ["unknown", "1", "1", "2-10", "2-10", "11-50", "11-50", "51+"]
    assert value(spark, N.isotropic(F.lit(10.0), F.lit(11.0))) is True
    assert value(spark, N.isotropic(F.lit(None).cast("double"), F.lit(11.0))) is None


@pytest.mark.parametrize(
    ("raw", "files", "want"),
    [("12.5", "", (12_500_000_000, 12_500_000_000)), ("1-2 GB each", "4 files", (4_000_000_000, 8_000_000_000)), ("1 GB + 500 MB", "", (1_500_000_000, 1_500_000_000)), ("big", "", (None, None)), (None, "", (None, None))],
)
def test_sizes(spark, raw, files, want):
    got = spark.range(1).select(N.size_range(F.lit(raw).cast("string"), F.lit(files)).alias("v")).first().v
    assert (got.lo, got.hi) == want


def test_paths_and_units(spark):
    assert [value(spark, N.extension(F.lit(p))) for p in ("a/b.OME.TIF", "a/.zarray", "x.nii.gz", "x", ".hidden", "a.b/c.mrc")] == [".ome.tif", ".zarray", ".nii.gz", "", "", ".mrc"]
    assert value(spark, N.unit_nm(F.lit("Micron"))) == 1000.0
    assert value(spark, N.unit_nm(F.lit("parsec"))) is None
    assert value(spark, N.scale_from_text(F.lit("about 4 x 4 x 30 nm"))) == (4.0, 4.0, 30.0)
    assert value(spark, N.scale_from_text(F.lit("8 nm isotropic"))) == (8.0, 8.0, 8.0)
    assert value(spark, N.human_bytes(F.lit(1536))) == "1.5 KiB"
    assert value(spark, N.escape_formula(F.lit("=1+1"))) == "'=1+1"


def test_slice_indices():
    assert N.slice_indices(10, 4) == [0, 3, 6, 9]
    assert N.slice_indices(3, 5) == [0, 1, 2]
    assert N.slice_indices(0, 5) == []
    for depth in range(1, 30):
        for count in range(1, 12):
            got = N.slice_indices(depth, count)
            assert len(got) == len(set(got)) == min(depth, count)


def test_hash_bar_and_roles(spark):
    from atlasforge.operators import manifests as M

    assert [value(spark, M.fnv1a(F.lit(t))) for t in ("", "a", "foobar")] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"]
    assert [value(spark, M.scale_bar(F.lit(t))) for t in (1.0, 3.0, 80.0, 1e9)] == [1, 2, 100, 500000]
    assert value(spark, M.roi_center(F.lit(3), F.lit(4), F.lit(100))) == 4 and value(spark, M.roi_center(F.lit(50), F.lit(60), F.lit(10))) == 9
    role = lambda p: value(spark, M.likely_role(F.lit(p), F.lit(False)))
    assert [role(p) for p in ("a/masks/x.tif", "a/x.OME.TIFF", "x.lif", "x", "x.zzz")] == ["derived_or_analysis_output", "raw_volume_candidate", "imaging_candidate", "no_extension", "unknown"]

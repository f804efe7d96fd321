import pytest
from pyspark.sql import functions as F

from atlasforge.operators import catalog as C
from atlasforge.operators import filters
from atlasforge.operators.filters import FilterSpec, condition

COLUMNS = "dataset_id string, title string, paper_title string, year int, source string, public_data_status string, species string, cell_type string, comparator_class string, modality string, modality_family string, lateral_resolution_nm double, organelles array<string>, metric_families array<string>, sample_size int, included_status string, source_study_id string, publication_pmid string, organelle_pairs array<string>, sample_size_bucket string, metadata_completeness_score double, axial_resolution_nm double, source_publication_url string, public_locator_urls array<string>, notes string, whole_cell_boundary_confirmed string, comparator_detail string"


def record(i, **kw):
    base = dict(
        dataset_id=f"d{i}", title=f"t{i}", paper_title="p", year=2000 + i, source="j", public_data_status="none", species="s", cell_type="beta", comparator_class=None, modality="m", modality_family="EM",
        lateral_resolution_nm=None, organelles=[], metric_families=[], sample_size=None, included_status="included", source_study_id=None, publication_pmid=None, organelle_pairs=[], sample_size_bucket="unknown", metadata_completeness_score=0.5, axial_resolution_nm=None, source_publication_url=None, public_locator_urls=[], notes=None, whole_cell_boundary_confirmed="no", comparator_detail=None,
    )
    assert set(kw) <= set(base)
    return tuple((base | kw).values())


def frame(spark, *records):
    return spark.createDataFrame(list(records), COLUMNS)


def test_wildcards_in_the_query_act_as_wildcards(spark):
    df = frame(spark, record(1, title="axb"), record(2, title="a_b"), record(3, title="ab"))
    assert {r.dataset_id for r in df.where(condition(FilterSpec(query="a_b"))).collect()} == {"d1", "d2"}


def test_array_filters_are_case_sensitive_and_empty_overlap_finds_nothing(spark):
    df = frame(spark, record(1, organelles=["Golgi"]), record(2, organelles=["golgi"]), record(3))
    assert [r.dataset_id for r in df.where(condition(FilterSpec(organelle="golgi"))).collect()] == ["d2"]
    assert df.where(filters.contains_ci("organelles", "GOLGI")).count() == 2
    assert df.where(filters.overlaps("organelles", [])).count() == 0


def test_unknown_status_and_dimension_are_refused():
    with pytest.raises(ValueError):
        condition(FilterSpec(public_data_status="maybe"))
    with pytest.raises(ValueError):
        C.dimension("nope")


def test_cross_tab_margins_equal_the_rows(spark):
    df = frame(spark, record(1, organelles=["a", "b"]), record(2), record(3, comparator_class=" "), record(4, included_status="excluded"))
    rows = C.cross_tab(df, "organelles", "comparator_class").collect()
    assert sum(r.n for r in rows if r.row_value and r.col_value) == 3
    assert [r.n for r in rows if r.row_value is None and r.col_value is None] == [3]
    assert {(r.row_value, r.col_value, r.n) for r in rows if r.row_value and r.col_value} == {("a", "none", 1), ("none", "none", 2)}


def test_median_is_the_lower_and_upper_middle(spark):
    df = frame(spark, *[record(i, sample_size=v) for i, v in enumerate((1, 2, 3, 4))])
    assert C.benchmarks(df).first().sample_median == 2
    assert C.upper_median(df, "modality_family", "sample_size").first().upper_median == 3


def test_similar_leaves_out_the_target_and_breaks_ties_by_year(spark):
    df = frame(spark, record(1), record(2), record(3), record(4, cell_type="x"), record(5, included_status="borderline"))
    assert [r.dataset_id for r in C.similar(df, "d1").collect()] == ["d3", "d2", "d4"]


def test_requested_order_repeats_and_omissions(spark):
    df = frame(spark, record(1), record(2))
    assert [r.dataset_id for r in C.in_request_order(df, ["d2", "zz", "d1", "d2"]).collect()] == ["d2", "d1", "d2"]


def test_plan_treats_zero_as_unknown_and_reports_status(spark):
    df = frame(spark, record(1, organelles=["a"], lateral_resolution_nm=0.0, sample_size=10, metric_families=["v", "c"]), record(2, organelles=["a"], metric_families=["c"]))
    got = C.plan_status(df, ["a"], 10.0, None).first()
    assert (got.matched, got.meeting, got.status, got.standard_metrics) == (2, 0, "high-risk", "c,v")
    assert C.plan_status(df, ["zz"], None, None).first().status == "frontier"
    assert C.plan_precedents(df, ["a"], 10.0, None).count() == 2


def test_compare_scores(spark):
    df = frame(spark, record(1, organelles=["a", "b"], organelle_pairs=["a:b"], metric_families=["v"], metadata_completeness_score=0.9), record(2, organelles=["b", "a"], organelle_pairs=["a:b"], metric_families=["v"], metadata_completeness_score=0.8))
    got = C.compare(df.withColumn("group_id", F.lit(1))).first()
    assert got.comparability_score == 25 + 10 + 5 + 3 + 10 + 10 and got.band == "moderate" and got.shared_organelles == "a,b"


def test_empty_catalog_and_guard(spark):
    df = frame(spark, record(1)).limit(0)
    assert C.facets(df).count() == C.timeline(df).count() == C.coverage_totals(df).count() == 0
    assert C.total(df, FilterSpec()).first().total == 0
    with pytest.raises(ValueError):
        C.guarded(frame(spark, record(1), record(2)), 1)
    with pytest.raises(ValueError):
        C.search(df, FilterSpec(), 501)


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select(F.col("o_orderstatus").alias("public_data_status"), "o_orderkey")
    plan = df.where(F.col("public_data_status") == "F").groupBy("public_data_status").count()._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan and "o_orderkey" not in plan.split("ReadSchema")[1]


def test_text_fields_are_those_of_the_catalog_search(spark):
    hits = {"title": "qq1", "paper_title": "qq2", "source_study_id": "qq3", "publication_pmid": "qq4", "source": "qq5", "species": "qq6", "cell_type": "qq7", "notes": "qq8"}
    others = {"modality": "qq9", "comparator_class": "qq9", "comparator_detail": "qq9"}
    df = frame(spark, *[record(i, **{k: v}) for i, (k, v) in enumerate((hits | others).items())], record(99, dataset_id="dqq"))
    assert {r.dataset_id for r in df.where(condition(FilterSpec(query="QQ"))).collect()} == {f"d{i}" for i in range(8)}


def test_handoff_fingerprint_is_the_digest_of_its_lines(spark):
    import hashlib

    df = frame(spark, record(1, source_publication_url="https://p", public_locator_urls=[" https://b ", "https://a", "https://b", " "], public_data_status="partial", publication_pmid="9"))
    want = hashlib.sha256("\n".join(["d1", "t1", "p", "2001", "", "9", "https://p", "partial", "https://a", "https://b"]).encode()).hexdigest()
    assert C.handoff_fingerprint(df).first().fingerprint == want
    from atlasforge.operators import public_data

    got = public_data.handoff(df).first()
    assert got.fingerprint == want and [c.locator_url for c in got.candidates] == ["https://b", "https://a"]


def test_plan_messages_and_baselines(spark):
    df = frame(spark, *[record(i, organelles=["a"], public_data_status="complete" if i % 2 else "none", modality="m1" if i < 3 else "m2") for i in range(8)])
    got = C.plan_status(df, ["a"], None, None).first()
    assert got.status_message == "8 records in the current corpus meet the active filters for this target." and got.suggested_baselines == "d7,d5,d3"
    assert got.modality_recommendation == "In the current corpus, m2 is the most common modality for this target (8 matching records)." and got.biological_target == "a"
    assert C.plan_status(df, ["zz"], None, None).first().status_message == "No records in the current corpus capture this organelle target."
    assert C.plan_status(df, ["a", "b"], None, 5).first().status_message == "8 matching records exist in the current corpus, but none meet the active threshold filters."


def test_ranks_are_exact_for_ties_groups_and_single_values(spark):
    import random

    r = random.Random(2)
    rows = [(g, v) for g in "abc" for v in [r.choice([1.0, 2.0, 2.5, r.random() * 9]) for _ in range(r.randint(1, 300))]] + [("one", 4.0), ("none", None), (None, 7.0)]
    got = {x.g: x.m for x in C.values_at_ranks(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"m": (0.5, F.ceil(F.col("n") / 2))}, accuracy=50).collect()}
    for g in {x[0] for x in rows if x[1] is not None}:
        v = sorted(x[1] for x in rows if x[0] == g)
        assert got[g] == v[(len(v) + 1) // 2 - 1], g
    assert "none" not in got


def test_repeated_studies(spark):
    df = frame(spark, record(1, source_study_id="A et al."), record(2, source_study_id="A et al."), record(3, source_study_id=" "), record(4)).withColumn("group_id", F.lit(1))
    assert [(r.study, r.n) for r in C.repeated_studies(df).collect()] == [("A et al.", 2)]


def test_compare_copies_no_records(spark):
    """One aggregation: records are not repeated once a trait that is counted; unknown values of a trait count neither for nor against it."""
    df = frame(
        spark, record(1, cell_type="a", species=None, modality_family="EM", comparator_class="", organelles=["x", "y"]), record(2, cell_type="a", species=None, modality_family="LM", comparator_class="t", organelles=["y"]),
        record(3, cell_type="a", species=None, modality_family=None, comparator_class=None, organelles=["z", "y"]),
    ).selectExpr("*", "1 as group_id")
    got = C.compare(df)
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    r = got.first()
    assert (r.shared_cell_types, r.shared_species, r.shared_modality_families, r.shared_comparator_classes, r.shared_organelles) == ("a", "", "", "t", "y")
    assert r.comparability_score == 25 + 10


def test_catalog_load_makes_each_set_once(spark):
    """The load moves line items as they are and packs no sets before the shuffle, sorts no terms that are sorted, and gives a row for each order."""
    from atlasforge.sources import bindings

    rows = bindings.catalog_rows(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("partial_collect_set") :]
    assert "REPARTITION_BY_COL" in below and below.index("Exchange hashpartitioning(k") < below.index("lineitem.parquet")
    assert "lambdafunction(CASE" not in plan and "array_sort" not in plan
    assert rows.count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()

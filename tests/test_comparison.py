"""Many samples against their cohorts in one plan."""

import math
import re
import statistics

import pytest
from pyspark.sql import functions as F

from abundara.functions import numeric as N
from abundara.functions import text as T
from abundara.operators import deviation
from abundara.plans import queries as Q
from abundara.sources import tables


def compared(spark, d, targets):
    p = tables.patients(spark, d)
    return deviation.compared_samples(p, tables.healthy(p), tables.abundance(spark, d), targets)


def scans(df):
    """Scans of the facts in the plan that ran; shuffles that are used again aren't scanned again."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len(re.findall(r"FileScan parquet[^\n]*l_quantity|FileScan parquet[^\n]*lineitem", plan))


def test_one_plan_for_one_sample_and_for_many(spark, sf_dir):
    facts = tables.abundance(spark, sf_dir)
    some = [(r.patient_id, r.sample_id) for r in facts.select("patient_id", "sample_id").distinct().orderBy("patient_id", "sample_id").limit(500).collect()]
    frames = [compared(spark, sf_dir, spark.createDataFrame(some[:n], "patient_id long, sample_id string")) for n in (1, 500)]
    lines = [len(f._jdf.queryExecution().optimizedPlan().toString().split("\n")) for f in frames]
    assert lines[0] == lines[1] and max(map(scans, frames)) <= 4
    assert [f.count() for f in frames] == [1, len(some)]


def test_each_sample_is_compared_as_if_alone(spark, sf_dir):
    facts = tables.abundance(spark, sf_dir)
    targets = facts.select("patient_id", "sample_id").distinct().orderBy(F.desc("sample_id")).limit(3)
    together = {r.sample_id: r for r in compared(spark, sf_dir, targets).collect()}
    for r in targets.collect():
        alone = compared(spark, sf_dir, spark.createDataFrame([r])).first()
        other = together[r.sample_id]
        assert [c.taxon for c in alone.comparisons] == [c.taxon for c in other.comparisons] and alone.missing == other.missing
        assert alone.current_distance == pytest.approx(other.current_distance) and alone.distance_percentile == pytest.approx(other.distance_percentile)


def test_nothing_runs_before_an_action(spark, sf_dir):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    try:
        Q.QUERIES["healthy_insight"](spark, sf_dir)
        assert len(tracker.getJobIdsForGroup("plan")) <= 8  # schemas of files, no data
        plan = Q.QUERIES["healthy_insight"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "index-" not in plan and "cohort-" not in plan
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_edges(spark):
    patients = spark.createDataFrame([(1, "gut"), (2, None), (3, "gut")], "patient_id long, body_site string")
    facts = spark.createDataFrame([(1, "s1", "a", 2.0, 1), (1, "s1", "a", 4.0, 2), (1, "s1", None, 1.0, 3), (1, "s1", "b", 0.0, 4), (3, "s3", "a", 4.0, 5), (2, "s2", "z", None, 6)], "patient_id long, sample_id string, taxon string, value double, pos long")
    targets = spark.createDataFrame([(1, "s1"), (1, "s1"), (2, "s2"), (9, "none"), (None, None)], "patient_id long, sample_id string")
    rows = {r.sample_id: r for r in deviation.compared_samples(patients, patients.filter("patient_id = 3"), facts, targets).collect()}
    assert set(rows) == {"s1", "s2"}  # samples without values have nothing to compare
    one = rows["s1"]
    assert one.reference_scope == "all_healthy" and (one.healthy_sample_count, one.healthy_patient_count) == (1, 1)
    assert [(c.taxon, c.value) for c in one.comparisons] == [("a", 2.0), ("a", 4.0)] or [(c.taxon, c.value) for c in one.comparisons] == [("a", 4.0), ("a", 2.0)]
    assert one.current_distance == 0.0 and one.healthy_samples == 1 and one.distance_percentile == 100.0 and one.missing == []
    assert rows["s2"].comparisons == [] and rows["s2"].missing == ["a"] and rows["s2"].distance_percentile == 50.0
    none = deviation.compared_samples(patients, patients.filter("false"), facts, targets)
    assert {r.sample_id: r.healthy_samples for r in none.collect()} == {"s1": 0, "s2": 0}
    assert deviation.compared_samples(patients, patients, facts.filter("false"), targets).count() == 0


def test_sparse_distances_are_the_dense_ones(spark):
    """Distances to the centre with zeros filled in, of samples that share a taxon with it."""
    patients = spark.createDataFrame([(i, None) for i in range(1, 5)], "patient_id long, body_site string")
    rows = [(1, "a", "t1", 2.0), (1, "a", "t2", 3.0), (1, "a", "new", 1.0), (2, "b", "t2", 1.0), (2, "b", "zz", 9.0), (3, "c", "t1", 4.0), (3, "c", "t2", 2.0), (4, "d", "zz", 1.0)]
    facts = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "patient_id long, sample_id string, taxon string, value double, pos long")
    row = deviation.compared_samples(patients, patients.filter("patient_id > 1"), facts, spark.createDataFrame([(1, "a")], "patient_id long, sample_id string")).first()
    centre = {"t1": 4.0, "t2": 1.5, "new": 0.0}
    far = lambda v: math.sqrt(sum((v.get(t, 0) - c) ** 2 for t, c in centre.items()) / 3)
    dense = [far({"t2": 1.0}), far({"t1": 4.0, "t2": 2.0})]  # sample d shares nothing
    assert row.healthy_samples == 2 and row.current_distance == pytest.approx(far({"t1": 2.0, "t2": 3.0, "new": 1.0}))
    assert row.distance_mean == pytest.approx(statistics.mean(dense)) and row.distance_std == pytest.approx(statistics.pstdev(dense))


def test_samples_are_gathered_once_for_a_ranking(spark):
    """The greatest value and the ranks of a sample share a shuffle, which comes after the join by taxon."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        samples = spark.createDataFrame([(1, "s", "a", 2.0, 1), (1, "s", "b", 4.0, 2), (2, "t", "a", 1.0, 3)], "patient_id long, sample_id string, taxon string, value double, pos long")
        rows = deviation.ranked(deviation.scored(samples, deviation.taxon_stats(samples.filter("patient_id = 2"))), 8)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning\(patient_id#\d+L, sample_id#\d+, \d+\)", plan)) == 1
        got = {(r.sample_id, r.taxon): r for r in rows.collect()}
        assert {k: r.avg_abundance for k, r in got.items()} == {("s", "a"): 1.0, ("s", "b"): 0.0, ("t", "a"): 1.0}
        assert got["s", "b"]["rank"] == 1 and got["s", "b"].combined_score == pytest.approx(0.40 + 0.45)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["difference_lines", "deviation_insight"])
def test_a_ranking_shuffles_numbers(spark, sf_dir, name):
    """Samples and taxa get their texts once the most telling ones are found: all shuffles and joins go by numbers, and a sample's rows are gathered once."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Q.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        keys = [k for ks in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan) for k in ks.split(", ")]
        taxa = [k for k in keys if k.startswith("taxon")]
        assert taxa and all(k.endswith("L") for k in taxa)
        assert sum(k.startswith("sample_id") for k in keys) == 1
        below = plan.split("Exchange hashpartitioning(patient_id", 1)[1]
        assert "k__life" not in below and "concat(" not in below
        assert name != "difference_lines" or "ObjectHashAggregate" not in plan  # lists, which are hashed and sorted anew
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_numbers_stand_for_the_same_samples(spark):
    """Coded values are the named ones, also without a patient, a date or a part; values without a patient are one sample whatever their year."""
    orders = spark.sql("SELECT * FROM VALUES (1, 7, timestamp'1995-01-01 00:00:00'), (2, 7, timestamp'1996-12-31 23:59:59'), (3, NULL, timestamp'1995-05-05'), (4, NULL, timestamp'1996-05-05'), (5, 8, NULL) AS t(o_orderkey, o_custkey, o_orderdate)")
    orders = orders.select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderdate")
    lines = spark.createDataFrame([(o, p, n, float(p or 3)) for o in range(1, 6) for n, p in enumerate([2, 10, 9, None])], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double")
    coded, plain = tables.facts(lines, orders, coded=True), tables.facts(lines, orders)
    assert sorted(map(str, tables.named(coded).collect())) == sorted(map(str, plain.collect()))
    assert tables.named(coded).columns == plain.columns
    texts = deviation.ranked(deviation.scored(plain, deviation.taxon_stats(plain.filter("patient_id = 7"))), 3)
    numbers = deviation.ranked(deviation.scored(coded, deviation.taxon_stats(coded.filter("patient_id = 7"))), 3, F.col("taxon").cast("string"))
    assert sorted(map(str, tables.named(numbers).collect())) == sorted(map(str, texts.collect()))
    assert texts.filter("patient_id IS NULL").count() == 3


def test_equal_scores_are_ordered_by_name(spark):
    """Part 10 comes before part 9, as their names do, and scores that differ by less than nine digits are equal."""
    rows = [(1, 1, t, 1.0 + e, p) for p, (t, e) in enumerate([(9, 1e-12), (10, 0.0), (100, -1e-12)])]
    facts = spark.createDataFrame(rows, "patient_id long, sample_id int, taxon long, value double, pos long").withColumn("value", F.lit(1.0))
    got = deviation.ranked(deviation.scored(facts, deviation.taxon_stats(facts)), 3, F.col("taxon").cast("string")).collect()
    assert [r.taxon for r in sorted(got, key=lambda r: r["rank"])] == [10, 100, 9]
    scores = spark.createDataFrame([(1, "s", n, v, f, 1.0, i) for i, (n, v, f) in enumerate([("b", 0.5, 2.0), ("a", 0.5 + 3e-10, -2.0 - 4e-10), ("c", 0.5 + 2e-9, 0.0), ("d", math.nan, 0.0)])],
        "patient_id long, sample_id string, taxon string, combined_score double, log2_fold double, value double, pos long")
    assert [r.taxon for r in sorted(deviation.ranked(scores, 4).collect(), key=lambda r: r["rank"])] == ["d", "c", "a", "b"]


def test_texts_of_numbers_and_names(spark):
    """Put together without a formatter or patterns, and the same as with them."""
    numbers = [0.0, -0.0, 0.01, -0.01, 0.005, -0.004, 0.29, 1.0, -1.1, 2.675, 9.995, -12.34, 100.05, 999999.99, -1e11 - 0.25, 1e12, 1e15, -1e300, math.inf, -math.inf, math.nan, None, *[i / 100 for i in range(-250, 250)], *[i / 1000 for i in range(-30, 30)]]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    for plus in ("", "+"):
        assert df.filter(~N.hundredths_text(F.col("x"), plus).eqNullSafe(F.format_string(f"%{plus}.2f", "x"))).collect() == []
    names = ["k__life.g__part_7", "g___a_b__", "G__X", "\u212a__x", "k__a|p__", "k__a;p__unclassified", "a b\tc__D e", "x_", "___", "k____", "1__a", "ab__c", "", " ", ".", "Unknown", "s__Unknown.|;", "\u00e9__x", "g__" + "y" * 30, "a\x0bb__q", "a__b.c__ UNKNOWN", None]
    tidy = lambda x: re.sub("^_+|_+$", "", re.sub("(?i)^[a-z]__+", "", x, flags=re.ASCII), flags=re.ASCII).strip(" ")
    def brute(c):
        levels = [tidy(x) for x in reversed(re.split(r"[|;.\s]", c, flags=re.ASCII)) if x]
        return next((x for x in levels if x and x.lower() not in ("unclassified", "unknown")), c)[:20]
    got = spark.createDataFrame([(x,) for x in names], "c string").select("c", T.clean_taxon_name(F.col("c")).alias("n")).collect()
    assert [r.n for r in got] == [None if c is None else brute(c) for c in names]


def test_what_waits_and_what_is_shared(spark, sf_dir):
    """Of a sample only keys, taxa and numbers go through the product, the facts' lines are shuffled once for samples and cohort, and the cohort's values once for all their uses."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = Q.QUERIES["compared_samples"](spark, sf_dir)
        assert scans(df) <= 2
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        shuffles = re.findall(r"(?m)^[^\nA-Za-z]*Exchange hashpartitioning\(([^)]*)\)", plan)
        assert not any("of_" in s or "struct" in s for s in shuffles)
        assert sum(s.startswith("scope") and "taxon" in s for s in shuffles) == 3  # the cohort's values, samples, cells
        assert sum(s.startswith("patient_id") and "sample_id" in s for s in shuffles) == 2  # a sample's rows, its products
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_every_sample_without_targets(spark):
    """As with all of them asked for, also for patients of two sites or none, values without a taxon and samples without a known patient."""
    patients = spark.createDataFrame([(i, "gut" if i % 2 else None) for i in range(1, 31)] + [(3, "skin"), (40, " ")], "patient_id long, body_site string")
    rows = [(i, f"{i}-{i * j % 4}", [None, "a", "b", "c", " "][(i + j) % 5], float((i * j) % 7), 100 * i + j) for i in [*range(1, 31), 40, 99] for j in range(12)] + [(5, None, "a", 1.0, 1)]
    facts = spark.createDataFrame(rows, "patient_id long, sample_id string, taxon string, value double, pos long")
    healthy = patients.filter("patient_id < 28")
    frames = [deviation.compared_samples(patients, healthy, facts, t) for t in (None, facts.select("patient_id", "sample_id"))]
    text = lambda r: re.sub(r"\d+\.\d+(e-\d+)?", lambda m: f"{float(m[0]):.9f}", str(r))  # noqa: E731 sums in another order
    got = [sorted(map(text, f.collect())) for f in frames]
    assert got[0] == got[1] and len(got[0]) == len({r[:2] for r in rows if r[1]})
    scopes = {r.patient_id: r.reference_scope for r in frames[0].collect()}
    assert scopes[3] == scopes[29] == "same_body_site_healthy" and scopes[2] == scopes[40] == scopes[99] == "all_healthy"
    for r in frames[0].collect():
        assert all(m is not None and "\x00" not in m for m in r.missing)


def test_patients_join_orders(spark, sf_dir):
    """The cohort's facts are those of a join by patient; lines are shuffled by order alone."""
    p = tables.healthy(tables.patients(spark, sf_dir))
    joined = Q.H(spark, sf_dir)
    other = deviation.cohort_facts(p, tables.abundance(spark, sf_dir), ("body_site",))
    assert joined.columns == other.columns and sorted(map(str, joined.collect())) == sorted(map(str, other.collect()))

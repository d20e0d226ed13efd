"""Edge rows that the tables don't have, and properties."""

import math
import re
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from abundara.functions import numeric as N
from abundara.functions import text as T
from abundara.operators import cohort, deviation, ingest, retrieval, rules, search_index, structure, traces, vectors
from abundara.plans import queries as Q
from abundara.sources import files, sinks, tables


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"]).select(column.alias("x")).first().x


def test_limits():
    assert [N.clamp_limit(n, 8, 30) for n in (None, -1, 0, 1, 30, 31, 1000)] == [8, 8, 8, 1, 30, 30, 30]


def test_erf_is_close(spark):
    for x in (-3.0, -0.7, 0.0, 0.2, 2.5):
        assert one(spark, N.erf(F.lit(x))) == pytest.approx(math.erf(x), abs=2e-7)
    assert one(spark, N.percentile_of_z(F.lit(0.0))) == 50.0
    assert one(spark, N.percentile_of_z(F.lit(99.0))) == pytest.approx(100.0)


def test_ratio_of_zero(spark):
    assert one(spark, N.ratio_to(F.lit(2.0), F.lit(0.0))) == math.inf
    assert one(spark, N.z_score(F.lit(2.0), F.lit(1.0), F.lit(0.0))) == 0.0


def test_safe_casts(spark):
    df = spark.createDataFrame([("1,234.5",), ("x",), (None,), (" 7 ",)], "s string")
    assert [r[0] for r in df.select(N.to_double(F.col("s"))).collect()] == [1234.5, 0.0, 0.0, 7.0]
    assert [r[0] for r in df.select(N.to_long(F.col("s"))).collect()] == [1234, 0, 0, 7]


def test_age_brackets(spark):
    ages = [None, 0, 10, 11, 60, 61, -1]
    df = spark.createDataFrame([(a,) for a in ages], "age int")
    assert [r[0] for r in df.select(N.bucketize(F.col("age"), N.AGE_BRACKETS, N.AGE_REST)).collect()] == ["60+", "0-10", "0-10", "11-20", "51-60", "60+", "60+"]


def test_clr_sums_to_zero(spark):
    row = one(spark, N.clr(F.array(F.lit(1.0), F.lit(0.0), F.lit(-2.0), F.lit(5.0))))
    assert sum(row) == pytest.approx(0, abs=1e-9) and row[1] == row[2]


def test_taxon_names(spark):
    names = ["k__a.p__unclassified", "k__a.p__" + "x" * 26, "p__" + "x" * 27, "", None, "c__a_b-c"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(T.short_taxon_name(F.col("n"))).collect()] == ["a", "x" * 26, "x" * 23 + "...", "unnamed", "unnamed", "a b c"]


def test_search_wildcards(spark):
    df = spark.createDataFrame([(1, "a%b", "x"), (2, "axb", "x"), (3, "a_b", "x")], "patient_id long, patient_name string, disease string")
    assert cohort.search(df, "name", "a%b").count() == 3
    assert cohort.search(df, "name", "a%b", escaped=True).count() == 1
    assert cohort.search(df, "shoe", "a").count() == 3


def test_pages_partition_the_result(spark):
    df = spark.range(23)
    pages = [r.id for p in range(1, 6) for r in cohort.page(df, [F.asc("id")], p, 5).collect()]
    assert pages == list(range(23))
    assert cohort.page_totals(df, 5).first() == (23, 5)


@pytest.mark.parametrize(("samples", "scope"), [(19, "all_healthy"), (20, "same_body_site_healthy")])
def test_scope_needs_twenty_samples(spark, samples, scope):
    rows = [(i, f"s{i}", "gut") for i in range(samples)] + [(100, "x", "skin")]
    facts = spark.createDataFrame(rows, "patient_id long, sample_id string, body_site string")
    patients = facts.select("patient_id", "body_site").distinct()
    found = {r.body_site: r for r in deviation.scopes(patients, facts).collect()}
    assert found["gut"].reference_scope == scope
    assert found["gut"].healthy_sample_count == (20 if scope != "all_healthy" else samples + 1)


def test_taxon_absent_from_the_cohort(spark):
    facts = spark.createDataFrame([(1, "a", "t", 2.0, 1)], "patient_id long, sample_id string, taxon string, value double, pos long")
    stats = deviation.taxon_stats(facts.filter("false"))
    row = deviation.scored(facts, stats).first()
    assert row.ratio == math.inf and row.direction == "higher" and row.z == 0


def test_missing_signature(spark):
    many = [(3, "c", f"x{k:03d}", 1000.0 - k, k) for k in range(120)] + [(3, "c", "t1", 1.0, 500), (3, "c", "t2", 2000.0, 501)]
    samples = spark.createDataFrame([(1, "a", "t1", 1.0, 1), (1, "a", "t3", 2.0, 2), (2, "b", "zz", 1.0, 3), *many], "patient_id long, sample_id string, taxon string, value double, pos long")
    signature = spark.createDataFrame([(i, f"t{i}") for i in range(1, 6)], "position int, taxon string")
    got = sorted((r.sample_id, r.position, r.taxon) for r in deviation.missing_signature(samples, signature).collect())
    # t1 of c is stored, but not among its 120 largest
    assert got == [("a", 1, "t2"), ("a", 2, "t4"), ("a", 3, "t5"), ("b", 1, "t1"), ("b", 2, "t2"), ("b", 3, "t3"), ("c", 1, "t1"), ("c", 2, "t3"), ("c", 3, "t4")]


def test_share_counts_all_groups(spark, tmp_path):
    rows = [(i * 100 + k, i) for i in range(12) for k in range(20 - i)]
    d = sf_of(tmp_path, spark, "orders", [(c, f"p{i:02d}") for c, i in rows], "o_custkey long, o_orderpriority string")
    got = Q.disease_distribution(spark, d).collect()
    assert len(got) == 10 and got[0].share == pytest.approx(100 * 20 / len(rows), abs=1e-6)


def test_kwic_window(spark):
    text = "a" * 40 + " `token` " + "b |" * 60
    flat = re.sub(r"\s+", " ", text.replace("`", " ").replace("|", " ").replace("- ", "")).strip()
    at = flat.index("token")
    assert one(spark, T.kwic(F.lit(text), F.array(F.lit("absent"), F.lit("TOKEN")))) == "..." + flat[at - 28 : at + 88].strip() + "..."
    assert one(spark, T.kwic(F.lit("x" * 130), F.array(F.lit("y")))) == "x" * 120 + "..."


def test_spatial_level_raises_the_label(spark):
    rows = spark.createDataFrame([(1, "a", 1, "g__x", "similar"), (2, "b", 1, "g__x", "similar"), (3, "c", 1, "g__x", "similar")], "patient_id long, sample_id string, rank int, taxon string, direction string")
    levels = spark.createDataFrame([(1, "a", "high"), (2, "b", "moderate")], "patient_id long, sample_id string, level string")
    got = {r.sample_id: (r.deviation_label, r.recommendation) for r in structure.deviation_insight(rows, levels).collect()}
    assert got == {"a": ("clear_deviation", "look_at_top_scores"), "b": ("some_deviation", "check_against_prediction"), "c": ("near_healthy", "follow_up")}


def test_dominance_labels(spark):
    assert [one(spark, structure.dominance_label(F.lit(a), F.lit(b))) for a, b in ((0.5, 0.6), (0.1, 0.8), (0.1, 0.3), (0.3, 0.6))] == ["concentrated", "concentrated", "dispersed", "medium"]


def test_matrix(spark):
    lines = spark.createDataFrame([("t1,1,,3",), ("  ",), (",1,2,3",), ("t2,abc,0,5",)], "value string")
    cells = files.matrix_cells(lines, header="﻿taxon,s1,s2,s3")
    assert sorted((r.taxon, r["sample"], r.cell) for r in cells.collect()) == [("t1", "s1", "1"), ("t1", "s2", ""), ("t1", "s3", "3"), ("t2", "s1", "abc"), ("t2", "s2", "0"), ("t2", "s3", "5")]
    lookup = spark.createDataFrame([("s1", 1), ("s2", 2)], "sample string, patient_id long")
    assert ingest.metrics(cells, lookup).first().asDict() == {"taxa": 2, "inserted": 1, "skipped_missing": 2, "skipped_zero": 3}
    assert [r[0] for r in ingest.missing_samples(cells, lookup).collect()] == ["s3"]
    with pytest.raises(ValueError):
        files.matrix_cells(lines, header="taxon")
    with pytest.raises(Exception, match="ragged"):
        files.matrix_cells(spark.createDataFrame([("t1,1",)], "value string"), header="taxon,s1,s2").collect()


def test_matrix_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿taxon,a,b\n\nx,1,2\n", encoding="utf-8")
    assert sorted((r.taxon, r["sample"], r.cell) for r in files.read_matrix(spark, str(tmp_path / "m.csv")).collect()) == [("x", "a", "1"), ("x", "b", "2")]


def test_upsert_twice_changes_nothing_more(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, keep string, v long")
    new = spark.createDataFrame([(2, "x", 5, 1), (2, "y", 6, 2), (3, "z", 7, 3)], "k long, keep string, v long, pos long")
    once = sinks.upsert(old, new, ["k"], ["v"], order="pos")
    want = [(1, "a", 1), (2, "b", 6), (3, "z", 7)]
    assert sorted(map(tuple, once.collect())) == want
    assert sorted(map(tuple, sinks.upsert(once, new, ["k"], ["v"], order="pos").collect())) == want


def test_point_update_writes_nulls(spark):
    rows = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double")
    new = spark.createDataFrame([(1, None)], "k long, v double")
    assert sorted(sinks.point_update(rows, new, "k").collect()) == [(1, None), (2, 2.0)]


def test_dry_run_and_writers(spark, tmp_path):
    df = spark.range(5)
    assert sinks.dry_run(df, top=F.max("id")) == {"rows": 5, "top": 4}
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert files.read_json_lines(spark, str(tmp_path / "j"), "id long").count() == 5
    sinks.write_sorted_csv(df, str(tmp_path / "c"), "id")
    assert files.read_metadata(spark, str(tmp_path / "c"), "id long").count() == 5
    sinks.versioned_overwrite(df, str(tmp_path / "v"), "five")
    assert spark.table("five").count() == 5


def test_cache_expires(spark):
    now = [0.0]
    cache = sinks.ResultCache(10, lambda: now[0])
    made = []
    make = lambda n: made.append(n) or spark.range(n)
    cache.get("search", make, n=3)
    cache.get("search", make, n=3)
    now[0] = 11
    cache.get("search", make, n=3)
    assert made == [3, 3] and cache.invalidate("search:") == 1 and not cache.kept


def test_index_keeps_the_last_line(spark, tmp_path):
    (tmp_path / "i.jsonl").write_text('{"pmcid":"a","topic":"x"}\n\nnot json\n{"pmcid":"a","topic":"y"}\n{"pmcid":"","topic":"z"}\n')
    rows = files.read_index(spark, str(tmp_path / "i.jsonl"), "pmcid string, topic string").collect()
    assert [(r.pmcid, r.topic) for r in rows] == [("a", "y")]


def test_markdown(spark, tmp_path):
    (tmp_path / "PMCID-1.md").write_text("﻿# Title\n## Metadata\n- Year: 2020\n- year: 2021\n## Abstract\nShort.\n## Full Text\n### Intro\nText a.\n### References\nNo.\n", encoding="utf-8")
    docs = files.read_markdown(spark, str(tmp_path), "PMCID-*.md")
    row = retrieval.paper(docs).first()
    assert (row.key, row.title, row.metadata["year"], row.abstract) == ("PMCID-1", "Title", "2021", "Short.")  # the last of a key wins
    parts = retrieval.sections(retrieval.paper(docs).select("key", "body"), "body").collect()
    assert [(p.heading, p.content) for p in parts] == [("Intro", "Text a.")]


def test_markdown_in_folders(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for path in ("top.md", "a/one.md", "a/b/two.md", "a/b/no.txt"):
        (tmp_path / path).write_text(path, encoding="utf-8")
    read = lambda recursive: [(r.key, r.text) for r in files.read_markdown(spark, str(tmp_path), recursive=recursive).orderBy("path").collect()]
    assert read(True) == [("two", "a/b/two.md"), ("one", "a/one.md"), ("top", "top.md")] and read(False) == [("top", "top.md")]


def test_rolled_up(spark):
    rows = lambda names: {r.name: r.n for r in cohort.rolled_up(spark.createDataFrame([(x,) for x in names], "c string"), "c", 2, 3).collect()}
    assert rows([]) == {} and rows([None, " "]) == {}
    assert rows(["a", "b", "b", "c"]) == {"a": 1, "b": 2, "c": 1}  # three groups stay
    assert rows(["a", "b", "b", "c", "d", "d", "d"]) == {"d": 3, "b": 2, "other": 2}
    assert rows(["other", "other", "b", "b", "c", "d"]) == {"b": 2, "other": 4}  # a group of that name joins the rest


def test_bundles_of_nothing(spark):
    people = spark.createDataFrame([], "patient_id long, age int, gender string, country string, disease string")
    row = cohort.dashboard_bundle(people, people.select("patient_id", "disease")).first()
    assert (row.diseases, row.origins, row.male_counts, row.total_patients, row.most_common_disease, row.most_common_count) == ([], [], [0] * 7, 0, "N/A", 0)
    facts = spark.createDataFrame([], "patient_id long, sample_id string, taxon string, value double, sample_date date, pos long")
    assert structure.compared(structure.richest_two(structure.profiles(facts))).count() == 0 and cohort.overview(people, facts, event=people.select("patient_id")).count() == 0


def test_composed(spark):
    none = F.lit(None)
    layered = F.array(F.lit("x"))
    got = one(spark, rules.composed(F.lit("OTHER"), layered, F.array().cast("array<string>"), none.cast("string"), none.cast("array<struct<type:string,title:string,content:string>>"), none.cast("array<string>")))
    assert (got.summary, [tuple(c) for c in got.cards], got.actions) == ("layered answer", [("hybrid_orchestration", "layered patient analysis", "combined: data; layers: 1")], list(rules.LAYERED_ACTIONS))


def chunks_brute(text, most, overlap, least):
    """The rule by single steps: positions of boundaries found one after another, no regular expression."""
    text, out, at = text.strip(), [], 0
    if len(text) <= most:
        return [text] if len(text) >= least else []
    while at < len(text):
        hard, found, i = min(len(text), at + most), None, at
        while i < hard - 1:
            two = text[i : i + 2]
            if (two[0] in "。！？.!?;；" and two[1].isspace()) or two == "\n\n":
                found, i = i, i + 2
            else:
                i += 1
        end = hard if found is None or found + 1 < min(len(text), at + int(most * 0.62)) else found + 1
        chunk = text[at:end].strip()
        if len(chunk) >= least:
            out.append(chunk)
        if end >= len(text):
            return out
        at = max(0, end - overlap)
    return out


@pytest.mark.parametrize("n", [0, 239, 240, 1800, 1801, 5000])
def test_chunks_of_sizes(n):
    for text in ("x" * n, ("Some words here. " * 400)[:n], ("one; two\n\nthree ！ four。 five" * 300)[:n]):
        assert retrieval.cut_texts(text.strip()) == chunks_brute(text, retrieval.MOST, retrieval.OVERLAP, retrieval.LEAST)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bc", " ", ". ", ".", "; ", "；", "\n", "\n\n", "。 "]), max_size=80).map("".join))
def test_chunks_equal_the_rule(text):
    text = T.normalised(text)
    assert retrieval.cut_texts(text, 20, 5, 4) == chunks_brute(text, 20, 5, 4)


def test_chunk_overlap_must_advance():
    with pytest.raises(ValueError):
        retrieval.cut_texts("x" * 5000, 1000, 700)


def test_knowledge_sections(spark):
    rows = [("Model/a.md", "# Top\nintro `x`\n## One\n# Instead\ntext | more\n# late\n- item\n### Two\n\n"), ("b.md", "just text"), ("c/d.md", "# Only\n## Empty\n"), ("e.md", " "), ("f.md", None)]
    got = [(r.id, r.library, r.title, r.content) for r in retrieval.knowledge_sections(spark.createDataFrame(rows, "path string, text string")).orderBy("id").collect()]
    assert got == [("Model/a.md#1", "model", "Top", "intro x"), ("Model/a.md#2", "model", "Instead", "text more item"), ("b.md#1", "general", "b", "just text"), ("c/d.md#1", "c", "Only", "# Only ## Empty")]


def test_bm25_repeats_and_stop_words(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, "the and of")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "beta"), (2, "beta beta"), (3, "the of")], "item_id long, text string")
    got = {(r.item_id, r.doc_id): r.score for r in search_index.top_hits(q, search_index.built(docs, "doc_id"), "item_id", 5).collect()}
    idf = math.log(1 + (2 - 1 + 0.5) / (1 + 0.5))
    want = idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2.5))
    assert got == {(1, 1): pytest.approx(want), (2, 1): pytest.approx(2 * want)}


def test_documents_are_tokenised_once(spark, sf_dir):
    plan = Q.bm25_search(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan


def test_chinese_runs(spark):
    assert one(spark, T.tokens(F.lit("菌群 the a-b 菌 X1"))) == ["菌群", "a-b", "x1"]


def test_evidence_keys(spark):
    rows = [(1, 1, "P1", None, "a"), (1, 2, "p1", "u", "b"), (1, 3, None, "U", "c"), (1, 4, "", "u", "d"), (1, 5, None, None, "T")]
    df = spark.createDataFrame(rows, "q long, position int, pmcid string, url string, title string")
    got = retrieval.merged_evidence([df.filter("position = 2"), df], "q", 8).orderBy("rank").collect()
    assert [(r.key, r.position) for r in got] == [("pmcid:p1", 2), ("url:u", 3), ("title:t", 5)]


def test_domains(spark):
    label = lambda h: one(spark, T.source_label(F.lit(h)))
    assert [label(h) for h in ("pubmed.ncbi.nlm.nih.gov", "pmc.ncbi.nlm.nih.gov", "x.nih.gov", "other.org")] == ["PubMed", "PubMed Central", "NIH", "other.org"]
    allowed = lambda h: one(spark, T.allowed_domain(F.lit(h), T.TRUSTED_DOMAINS))
    assert allowed("a.who.int") and allowed("who.int") and not allowed("notwho.int")


def test_rules(spark):
    assert one(spark, rules.quality_gate(F.lit("pass but fail"))) == "FAIL"
    assert one(spark, rules.intent(F.lit("风险 risk"), F.lit(""))) == "PREDICTION_ASSISTANT"
    assert one(spark, rules.intent(F.lit("hello"), F.lit("index"))) == "DASHBOARD_QA"
    assert one(spark, rules.risk_level(F.lit("如何治疗"), F.lit("PATIENT_ANALYSIS"), F.lit(None).cast("string"), F.lit(None).cast("string"))) == "high"
    strings = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    none = F.lit(None).cast("string")
    assert one(spark, rules.severity(none, strings(), strings(), strings(), strings("missing_trace"))) == "P0"
    assert one(spark, rules.severity(none, strings(), strings(), strings(), strings("missing_step:workflow"))) == "P1"
    assert one(spark, rules.severity(none, strings(), strings(), strings("a"), strings())) == "P2"
    assert one(spark, rules.severity(none, strings(), strings(), strings(), strings())) == "PASS"
    assert one(spark, rules.fix_layers(none, strings("x"), strings("y"), strings(), strings("prediction_layer_not_used"))) == ["prediction-pipeline", "workflow-orchestration", "prompt-policy", "review-loop", "response-synthesis"]


def sf_of(folder, spark, name, rows, schema):
    """Folder of tables with one table of these rows."""
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_query_expansion_takes_all_rows_and_rules(spark, tmp_path):
    texts = [None, "", "  ", "x", "A decade of T2D", "academic", "IBD or crc", "NAFLD, Cirrhosis ", "obesity cad", "糖尿病", "研究 ms", *[w for words, _ in T.EXPANSIONS for w in words]]

    def brute(text):
        low = (text or "").lower()
        adds = [more for words, more in T.EXPANSIONS if any(w in low for w in words)]
        adds += [] if any("a" <= c <= "z" for c in low) else [T.NO_LATIN]
        return ((text or "").strip() + "".join(adds)).strip()

    d = sf_of(tmp_path, spark, "benchmark", list(enumerate(texts)), "item_id long, text string")
    got = {r.item_id: r.expanded for r in Q.query_expansion(spark, d).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_staged_gate_takes_all_rows(spark, tmp_path):
    texts = {"fail, then warn": "FAIL", "WARN": "OPTIMIZE", "optimize": "OPTIMIZE", "Optimize or fail": "FAIL", "warn optimize": "OPTIMIZE", "fine": "PASS", "": "PASS", None: "PASS"}
    d = sf_of(tmp_path, spark, "documents", list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.gate for r in Q.staged_gate(spark, d).collect()} == dict(enumerate(texts.values()))


def test_query_builder_takes_all_rows(spark, tmp_path):
    rows = [("user", "user asks"), ("user", "hello all"), ("user", None), ("user", ""), ("user", " led by a blank"), ("bot", "bot"), (None, "hello"), (None, None)]
    built = ["user user asks", "user hello all", "user", "user", "user  led by a blank", "bot", "hello", ""]
    d = sf_of(tmp_path, spark, "conversations", [(i, 0, *r) for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string")
    assert [r.built for r in Q.query_builder(spark, d).orderBy("conv_id").collect()] == built


@pytest.mark.parametrize("name", ["patient_nested_detail", "prediction_payload", "sample_rows_in_order", "trace_completeness"])
def test_no_array_of_a_whole_group(spark, sf_dir, name):
    assert "collect_list" not in Q.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_staged_fold(spark):
    step = lambda k, o: F.struct(F.lit(k).alias("kind"), F.lit(o).alias("output"))
    row = one(spark, rules.staged_fold(F.array(step("assistant", "a1"), step("quality", "WARN: b"), step("coordinator", "")), F.lit("start")))
    assert (row.rolling, row.answer, row.gate) == ("WARN: b", "WARN: b", "OPTIMIZE")


def test_traces(spark):
    assert {r.name: r.n for r in traces.zero_filled(spark.createDataFrame([("a",)], "k string"), "k", ["a", "b"]).collect()} == {"a": 1, "b": 0}
    assert one(spark, traces.merged_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("3")))) == {"a": "3", "b": "2"}


def test_variance_with_zeros(spark):
    long = spark.createDataFrame([(0, 2.0), (0, 4.0)], "feature int, value double")
    assert vectors.variance(long, 3).first().variance == pytest.approx(statistics.pvariance([2, 4, 0]))


def test_ellipse_needs_three_points(spark):
    two = spark.createDataFrame([(0.0, 1.0), (1.0, 0.0)], "pc1 double, pc2 double")
    assert vectors.ellipse(two).count() == 0
    assert vectors.ellipse(two.unionByName(spark.createDataFrame([(2.0, 2.0)], "pc1 double, pc2 double"))).count() == vectors.ELLIPSE_POINTS


def test_jdbc_reads_by_predicates(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(10).write.jdbc(url, "numbers", properties={"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})
    rows = tables.jdbc(spark, url, "numbers", ['"id" < 4', '"id" >= 4'], driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert rows.rdd.getNumPartitions() == 2 and sorted(r.id for r in rows.collect()) == list(range(10))


def test_empty_tables(spark):
    facts = spark.createDataFrame([], "patient_id long, sample_id string, taxon string, value double, pos long")
    assert deviation.cohort_counts(facts).first() == (0, 0)


def test_rounding_is_that_of_the_sql(spark):
    import duckdb

    values = [1.005, 0.0015625, 2.675, 1.0000005, -1.005, 0.0390625, 25.0078125, float("inf"), 0.0, 123456.7890125] + [k / 640 for k in range(1, 400)] + [k / 64 for k in range(1, 300)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 5, 6):
        got = [r.r for r in rows.select(N.rounded(F.col("v"), digits).alias("r")).collect()]
        assert got == [duckdb.execute(f"SELECT round(?::DOUBLE, {digits})", [v]).fetchone()[0] for v in values]


def test_chunks_read_texts_once(spark, sf_dir):
    """One scan of the texts, cleaned in the task that cuts them; the plan cleans nothing twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = retrieval.chunks(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "regexp_replace" not in plan
    papers = docs.select(F.col("doc_id").cast("string").alias("pmcid"), "text")
    index = spark.createDataFrame([("1", True, "p", "t", "u")], "pmcid string, ingested boolean, pmid string, topic string, source_url string")
    assert retrieval.paper_chunks(papers, index)._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_ends_are_trimmed_alike_in_both_places(spark):
    texts = [f"{c}{c}a{c}b.{c}\n{c}" for c in T.BLANKS] + ["", " \n\t", "　 x\r\n\r\n\r\n\r\ny\xa0", "x" + " " * 50_000 + "y"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.normalise(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in rows} == {i: T.normalised(t) for i, t in enumerate(texts)}
    assert {T.normalised(f"{c}a{c}") for c in T.BLANKS} == {"a"}

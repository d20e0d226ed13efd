"""Registered queries over the given tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import numeric as N
from ..functions import text as T
from ..operators import boosting, cohort, deviation, ingest, ordination, retrieval, rules, search_index, structure, substrings, traces, vectors
from ..sources import sinks, tables
from ..streaming import queue

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
WITH = "WITH " + tables.SQL


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


P, A, t = tables.patients, tables.abundance, tables.table

# --- search and paging -----------------------------------------------------------------


@query(WITH + "SELECT * FROM v_patients WHERE CAST(patient_id AS VARCHAR) = '42'")
def patient_search_id(spark, d):
    return cohort.search(P(spark, d), "id", "42")


@query(WITH + "SELECT * FROM v_patients WHERE patient_name LIKE '%000000_7%'")
def patient_search_name(spark, d):
    return cohort.search(P(spark, d), "name", "000000_7")


@query(WITH + "SELECT * FROM v_patients WHERE lower(disease) LIKE '%auto%'")
def patient_search_disease(spark, d):
    return cohort.search(P(spark, d), "disease", "AUTO", case_sensitive=False)


@query(WITH + "SELECT * FROM v_patients")
def patient_search_unknown(spark, d):
    return cohort.search(P(spark, d), "shoe_size", "44")


@query(WITH + "SELECT * FROM v_patients WHERE disease LIKE '%BUILDING%' ORDER BY patient_id LIMIT 10 OFFSET 20")
def patient_page(spark, d):
    return cohort.page(cohort.search(P(spark, d), "disease", "BUILDING"), [F.asc("patient_id")], 3, 10)


@query(WITH + "SELECT count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages FROM v_patients WHERE disease LIKE '%BUILDING%'")
def patient_page_totals(spark, d):
    return cohort.page_totals(cohort.search(P(spark, d), "disease", "BUILDING"), 10)


@query(WITH + """SELECT p.patient_id, p.patient_name, coalesce(n, 0) AS n_features, coalesce(total, 0) AS total FROM v_patients p
LEFT JOIN (SELECT patient_id, count(*) AS n, sum(value) AS total FROM v_abundance GROUP BY 1) a USING (patient_id)""")
def patient_nested_detail(spark, d):
    n = A(spark, d).groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("sum"))
    return P(spark, d).join(n, "patient_id", "left").select("patient_id", "patient_name", F.coalesce("n", F.lit(0)).alias("n_features"), F.coalesce("sum", F.lit(0.0)).alias("total"))


@query(WITH + "SELECT patient_id, count(DISTINCT sample_id) AS sample_count, count(taxon) AS value_count FROM v_patients LEFT JOIN v_abundance USING (patient_id) GROUP BY 1")
def patient_overview(spark, d):
    return cohort.overview(P(spark, d), A(spark, d))


@query("SELECT DISTINCT c_custkey AS patient_id, c_name AS patient_name FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT'")
def ids_by_disease(spark, d):
    bridge = t(spark, d, "orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderpriority").alias("disease")).filter("disease = '1-URGENT'")
    return P(spark, d).select("patient_id", "patient_name").join(bridge, "patient_id", "left_semi")


_FIELDS = ("patient_name", "age", "gender", "country", "body_site", "disease", "bmi")


@query(WITH + f"""SELECT p.patient_id, {", ".join(_FIELDS)}, coalesce(sample_count, 0) AS sample_count, coalesce(value_count, 0) AS value_count, coalesce(event_count, 0) AS event_count FROM v_patients p
 LEFT JOIN (SELECT patient_id, count(DISTINCT sample_id) AS sample_count, count(*) AS value_count FROM v_abundance GROUP BY 1) a USING (patient_id) LEFT JOIN (SELECT user_id AS patient_id, count(*) AS event_count FROM events GROUP BY 1) e USING (patient_id)""")
def patient_overview_full(spark, d):
    """All fields of a patient, with counts of samples, values and events."""
    return cohort.overview(P(spark, d), A(spark, d), _FIELDS, event=t(spark, d, "events").select(F.col("user_id").alias("patient_id")))


@query("SELECT DISTINCT c_custkey AS patient_id, c_name AS patient_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#2'")
def patients_by_link(spark, d):
    """Patients that a table of links leads to through a target's name."""
    sold = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    links = sold.select(F.col("o_custkey").alias("patient_id"), F.col("l_partkey").alias("target_id"))
    targets = t(spark, d, "part").select(F.col("p_partkey").alias("target_id"), "p_brand")
    return cohort.linked(P(spark, d).select("patient_id", "patient_name"), links, targets, "p_brand", "Brand#2")


@query(WITH + "SELECT patient_id, sample_id, taxon, value FROM v_abundance WHERE patient_id = 7 ORDER BY value DESC, taxon")
def patient_features(spark, d):
    return A(spark, d).filter("patient_id = 7").select("patient_id", "sample_id", "taxon", "value")


# --- dashboards ------------------------------------------------------------------------


@query("SELECT o_orderpriority AS disease, count(*) AS count, count(*) AS percentage, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def disease_distribution(spark, d):
    bridge = t(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("disease")).distinct()
    top = cohort.top_groups(bridge, "disease", 10)
    total = bridge.filter(T.present(F.col("disease"))).agg(F.count(F.lit(1)).alias("total"))
    share = F.round(100.0 * F.col("count") / F.col("total"), 6)
    return top.join(F.broadcast(total)).select("disease", "count", F.col("count").alias("percentage"), share.alias("share"))  # one row


@query(WITH + "SELECT disease, count(*) AS count FROM v_patients WHERE trim(disease) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def most_common_disease(spark, d):
    return cohort.top_groups(P(spark, d), "disease", 1)


@query(WITH + "SELECT country, count(*) AS count FROM v_patients WHERE trim(country) <> '' GROUP BY 1")
def patient_origin(spark, d):
    return P(spark, d).filter(T.present(F.col("country"))).groupBy("country").agg(F.count(F.lit(1)).alias("count"))


@query(WITH + "SELECT min(age) AS min_age, max(age) AS max_age FROM v_patients")
def age_range(spark, d):
    return P(spark, d).agg(F.min("age").alias("min_age"), F.max("age").alias("max_age"))


@query(WITH + "SELECT count(patient_id) AS total FROM v_patients")
def total_patients(spark, d):
    return P(spark, d).agg(F.count("patient_id").alias("total"))


AGE_SQL = "CASE " + " ".join(f"WHEN age BETWEEN {a} AND {b} THEN '{c}'" for a, b, c in N.AGE_BRACKETS) + f" ELSE '{N.AGE_REST}' END"


@query(WITH + f"SELECT {AGE_SQL} AS age_group, gender, count(*) AS count FROM v_patients WHERE gender IS NOT NULL GROUP BY 1, 2")
def age_gender_groups(spark, d):
    return cohort.age_gender(P(spark, d))


_BRACKETS = ", ".join(f"('{b}')" for b in [*(x[2] for x in N.AGE_BRACKETS), N.AGE_REST])


@query(WITH + f", g AS (SELECT {AGE_SQL} AS age_group, gender FROM v_patients) SELECT b.age_group, count(*) FILTER (gender = 'male') AS male, count(*) FILTER (gender = 'female') AS female FROM (VALUES {_BRACKETS}) b(age_group) LEFT JOIN g USING (age_group) GROUP BY 1")
def age_gender_pivot(spark, d):
    return cohort.age_gender_pivot(P(spark, d)).select("age_group", "male", "female")


@query(WITH + ", c AS (SELECT country AS name, count(*) AS n FROM v_patients GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS k, count(*) OVER () AS g FROM c) SELECT CASE WHEN g <= 6 OR k <= 5 THEN name ELSE 'other' END AS name, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1")
def top5_other_rollup(spark, d):
    return cohort.rolled_up(P(spark, d), "country")


@query(WITH + "SELECT round(100.0 * count(*) FILTER (lower(trim(disease)) = 'building') / greatest(count(*), 1), 2) AS healthy_percent, count(DISTINCT disease) AS kinds, count(DISTINCT country) AS regions FROM v_patients")
def healthy_ratio(spark, d):
    n = F.count_if(F.lower(F.trim("disease")) == tables.HEALTHY)
    return P(spark, d).agg(F.round(100.0 * n / F.greatest(F.count(F.lit(1)), F.lit(1)), 2).alias("healthy_percent"), F.count_distinct("disease").alias("kinds"), F.count_distinct("country").alias("regions"))


@query(WITH + ", c AS (SELECT disease, count(*) AS n FROM v_patients GROUP BY 1) SELECT (SELECT count(*) FROM v_patients) AS total_patients, (SELECT min(age) FROM v_patients) AS min_age, (SELECT max(age) FROM v_patients) AS max_age, (SELECT count(DISTINCT country) FROM v_patients) AS regions, (SELECT disease FROM c ORDER BY n DESC, disease DESC LIMIT 1) AS most_common_disease, (SELECT max(n) FROM c) AS most_common_count")
def dashboard_summary(spark, d):
    return cohort.dashboard(P(spark, d))


@query(WITH + f""", b AS (SELECT DISTINCT o_custkey, o_orderpriority AS name FROM orders), dd AS (SELECT name, count(*) AS n FROM b WHERE trim(name) <> '' GROUP BY 1 ORDER BY n DESC, name LIMIT 10),
oo AS (SELECT country AS name, count(*) AS n FROM v_patients WHERE trim(country) <> '' GROUP BY 1), c AS (SELECT disease, count(*) AS n FROM v_patients WHERE trim(disease) <> '' GROUP BY 1), g AS (SELECT {AGE_SQL} AS age_group, gender FROM v_patients),
ag AS (SELECT b.age_group, count(*) FILTER (gender = 'male') AS male, count(*) FILTER (gender = 'female') AS female FROM (VALUES {_BRACKETS}) b(age_group) LEFT JOIN g USING (age_group) GROUP BY 1)
SELECT (SELECT string_agg(name || '=' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, name) FROM dd) AS diseases, (SELECT string_agg(name || '=' || CAST(n AS VARCHAR), ',' ORDER BY n DESC, name) FROM oo) AS origins,
 (SELECT string_agg(age_group || '=' || CAST(male AS VARCHAR) || '/' || CAST(female AS VARCHAR), ',' ORDER BY age_group) FROM ag) AS ages, (SELECT count(*) FROM v_patients) AS total_patients,
 (SELECT min(age) FROM v_patients) AS min_age, (SELECT max(age) FROM v_patients) AS max_age, (SELECT disease FROM c ORDER BY n DESC, disease DESC LIMIT 1) AS most_common_disease, (SELECT max(n) FROM c) AS most_common_count""")
def dashboard_bundle(spark, d):
    """The dashboard's one row, its lists as text."""
    diseases = t(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("disease")).distinct()
    named = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x["name"], x["count"].cast("string"))), ",").alias(c)
    ages = F.array_join(F.transform(F.arrays_zip("age_brackets", "male_counts", "female_counts"), lambda x: F.concat(x["age_brackets"], F.lit("="), x["male_counts"].cast("string"), F.lit("/"), x["female_counts"].cast("string"))), ",")
    return cohort.dashboard_bundle(P(spark, d), diseases).select(named("diseases"), named("origins"), ages.alias("ages"), "total_patients", "min_age", "max_age", "most_common_disease", "most_common_count")


# --- samples ---------------------------------------------------------------------------

SUMMARY = ", s AS (SELECT patient_id, sample_id, max(sample_date) AS sample_date, count(*) AS feature_count, sum(value) AS abundance_total FROM v_abundance GROUP BY 1, 2)"
TOP = ", top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, sample_id ORDER BY value DESC, taxon, pos) AS rank FROM v_abundance) WHERE rank <= 8)"


@query(WITH + SUMMARY + " SELECT * FROM s")
def sample_summaries(spark, d):
    return cohort.sample_summaries(A(spark, d))


@query(WITH + TOP + " SELECT patient_id, sample_id, taxon, value, CAST(rank AS INTEGER) AS rank FROM top")
def sample_top_features(spark, d):
    return cohort.top_features(A(spark, d), 8).select("patient_id", "sample_id", "taxon", "value", "rank")


@query(WITH + "SELECT patient_id, sample_id, count(*) AS feature_count, first(sample_date ORDER BY value DESC, pos, taxon) AS top_date, first(taxon ORDER BY value DESC, pos, taxon) AS top_taxon FROM v_abundance GROUP BY 1, 2")
def sample_detail(spark, d):
    return cohort.sample_detail(A(spark, d))


@query(WITH + f""", u AS (SELECT o_custkey AS patient_id, CAST(o_custkey AS VARCHAR) || '-' || CAST(year(o_orderdate) AS VARCHAR) AS sample_id, 'k__life.g__part_' || CAST(l_partkey AS VARCHAR) AS taxon, l_quantity AS value,
 CAST(o_orderdate AS DATE) AS sample_date, l_orderkey * 100 + l_linenumber AS pos, l_linestatus AS unit FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT patient_id, sample_id, count(*) AS feature_count, first(sample_date ORDER BY value DESC, pos, taxon, unit) AS top_date, first(taxon ORDER BY value DESC, pos, taxon, unit) AS top_taxon, first(unit ORDER BY value DESC, pos, taxon, unit) AS unit FROM u GROUP BY 1, 2)
SELECT s.*, {", ".join(_FIELDS)} FROM s LEFT JOIN v_patients USING (patient_id)""")
def sample_detail_full(spark, d):
    """A sample with date, name and unit of its largest value, beside its patient."""
    return cohort.sample_detail(A(spark, d, "l_linestatus"), P(spark, d))


@query(WITH + "SELECT patient_id, sample_id, 'standard_abundance' AS source, taxon AS name, value, 'count' AS meta FROM v_abundance")
def prediction_payload(spark, d):
    return A(spark, d).select("patient_id", "sample_id", F.lit("standard_abundance").alias("source"), F.col("taxon").alias("name"), "value", F.lit("count").alias("meta"))


# --- healthy cohort --------------------------------------------------------------------

COHORT = ", h AS (SELECT a.*, p.body_site FROM v_abundance a JOIN v_healthy p USING (patient_id))"
STATS = COHORT + ", st AS (SELECT taxon, avg(value) AS avg_abundance, stddev_pop(value) AS std_abundance, count(DISTINCT sample_id) AS sample_hits FROM h GROUP BY 1)"


def H(spark, d, coded: bool = False) -> DataFrame:
    return A(spark, d, of=tables.healthy(P(spark, d)).select("patient_id", "body_site"), coded=coded)


def _scored(spark, d) -> DataFrame:
    """All values against the healthy cohort, by numbers; `tables.named` gives the texts."""
    return deviation.scored(A(spark, d, coded=True), deviation.taxon_stats(H(spark, d, coded=True)))


def _ranked(spark, d, k: int) -> DataFrame:
    """The k most telling taxa of every sample, which are named once they are found; samples stay numbers, so a grouping of theirs needs no shuffle. Names end in the part: its digits order equal ones."""
    rows = deviation.ranked(_scored(spark, d), k, F.col("taxon").cast("string"))
    return rows.withColumn("taxon", tables.taxon_name(F.col("taxon")))


@query(WITH + COHORT + " SELECT count(DISTINCT patient_id) AS patient_count, count(DISTINCT sample_id) AS sample_count FROM h")
def healthy_counts(spark, d):
    return deviation.cohort_counts(H(spark, d))


@query(WITH + STATS + " SELECT taxon, round(avg_abundance, 6) AS avg_abundance, round(std_abundance, 6) AS std_abundance, sample_hits FROM st")
def healthy_taxon_stats(spark, d):
    return rounded(deviation.taxon_stats(H(spark, d)), "avg_abundance", "std_abundance")


@query(WITH + STATS + " SELECT taxon, round(avg_abundance, 6) AS avg_abundance, round(std_abundance, 6) AS std_abundance, sample_hits FROM st ORDER BY st.avg_abundance DESC, sample_hits DESC, taxon LIMIT 12")
def healthy_top_taxa(spark, d):
    return rounded(deviation.top_taxa(deviation.taxon_stats(H(spark, d)), 12), "avg_abundance", "std_abundance")


@query(WITH + STATS + " SELECT patient_id, sample_id, taxon, value FROM h WHERE taxon IN (SELECT taxon FROM st ORDER BY avg_abundance DESC, sample_hits DESC, taxon LIMIT 40)")
def healthy_feature_matrix(spark, d):
    rows = H(spark, d)
    wanted = deviation.top_taxa(deviation.taxon_stats(rows), 40).select("taxon")
    return rows.join(F.broadcast(wanted), "taxon", "left_semi").select("patient_id", "sample_id", "taxon", "value")  # forty rows


@query(WITH + STATS + """, sig AS (SELECT taxon, row_number() OVER (ORDER BY avg_abundance DESC, sample_hits DESC, taxon) AS p FROM st QUALIFY p <= 12),
ids AS (SELECT DISTINCT patient_id, sample_id FROM v_abundance),
big AS (SELECT *, row_number() OVER (PARTITION BY patient_id, sample_id ORDER BY value DESC, taxon, pos) AS r FROM v_abundance QUALIFY r <= 120),
m AS (SELECT i.patient_id, i.sample_id, g.taxon, row_number() OVER (PARTITION BY i.patient_id, i.sample_id ORDER BY g.p) AS k FROM ids i CROSS JOIN sig g
      WHERE NOT EXISTS (SELECT 1 FROM big a WHERE a.sample_id = i.sample_id AND a.taxon = g.taxon))
SELECT patient_id, sample_id, CAST(k AS INTEGER) AS position, taxon FROM m WHERE k <= 3""")
def healthy_signature_missing(spark, d):
    top = deviation.top_taxa(deviation.taxon_stats(H(spark, d)), 12)
    signature = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("avg_abundance"), F.desc("sample_hits"), "taxon")))  # twelve rows
    return deviation.missing_signature(A(spark, d), signature)


@query(WITH + COHORT + ", n AS (SELECT body_site, count(DISTINCT sample_id) AS n FROM h GROUP BY 1) SELECT s.body_site, CASE WHEN coalesce(n, 0) >= 20 THEN 'same_body_site_healthy' ELSE 'all_healthy' END AS reference_scope, CASE WHEN coalesce(n, 0) >= 20 THEN n ELSE (SELECT count(DISTINCT sample_id) FROM h) END AS healthy_sample_count FROM (SELECT DISTINCT body_site FROM v_patients) s LEFT JOIN n USING (body_site)")
def reference_scope(spark, d):
    return deviation.scopes(P(spark, d), H(spark, d))


def _erf_sql(x: str) -> str:
    k = f"(1.0::DOUBLE / (1.0::DOUBLE + {N.ERF_P}::DOUBLE * abs({x})))"
    poly = "0.0::DOUBLE"
    for a in reversed(N.ERF_A):
        poly = f"(({poly} + ({a})::DOUBLE) * {k})"
    return f"(sign({x}) * (1.0::DOUBLE - {poly} * exp(-({x}) * ({x}))))"


_Z = "greatest(-8.0::DOUBLE, least(8.0::DOUBLE, z)) / 1.4142135623730951::DOUBLE"


def _scored_sql(facts: str, stats: str, tag: str = "") -> str:
    return f""", f{tag} AS (SELECT *, max(value) OVER (PARTITION BY patient_id, sample_id) AS top FROM {facts} WHERE value > 0),
d1{tag} AS (SELECT f{tag}.*, coalesce(avg_abundance, 0.0::DOUBLE) AS m, coalesce(std_abundance, 0.0::DOUBLE) AS sd, coalesce(sample_hits, 0) AS hits FROM f{tag} LEFT JOIN {stats} USING (taxon)),
d2{tag} AS (SELECT *, value - m AS delta, CASE WHEN m > 0 THEN value / m ELSE 'inf'::DOUBLE END AS ratio, ln((value + 1e-9::DOUBLE) / (m + 1e-9::DOUBLE)) / ln(2.0::DOUBLE) AS fold, CASE WHEN sd > 0 THEN (value - m) / sd ELSE 0.0::DOUBLE END AS z FROM d1{tag}),
d3{tag} AS (SELECT *, 50.0::DOUBLE * (1.0::DOUBLE + {_erf_sql(_Z)}) AS percentile FROM d2{tag}),
sc{tag} AS (SELECT *, 0.40::DOUBLE * (value / top) + 0.45::DOUBLE * least(abs(fold) / 4.0::DOUBLE, 1.0::DOUBLE) + 0.15::DOUBLE * (abs(percentile - 50.0::DOUBLE) / 50.0::DOUBLE) AS score,
  CASE WHEN m <= 0 AND value > 0 THEN 'higher' WHEN fold >= 0.58 THEN 'higher' WHEN fold <= -0.58 THEN 'lower' ELSE 'similar' END AS direction FROM d3{tag})"""


RANKED = "row_number() OVER (PARTITION BY patient_id, sample_id ORDER BY round(score, 9) DESC, round(abs(fold), 9) DESC, value DESC, taxon, pos)"


@query(WITH + STATS + _scored_sql("v_abundance", "st") + " SELECT patient_id, sample_id, taxon, pos, value, round(m, 6) AS avg_abundance, round(delta, 6) AS delta, round(ratio, 6) AS ratio, round(fold, 6) AS log2_fold, round(z, 5) AS z, round(percentile, 5) AS percentile, round(score, 5) AS combined_score, hits AS sample_hits, direction FROM sc")
def feature_deviation(spark, d):
    rows = tables.named(_scored(spark, d))
    rows = rows.withColumns({c: N.rounded(F.col(c), 6) for c in ("avg_abundance", "delta", "ratio", "log2_fold")} | {c: N.rounded(F.col(c), 5) for c in ("z", "percentile", "combined_score")})
    return rows.select("patient_id", "sample_id", "taxon", "pos", "value", "avg_abundance", "delta", "ratio", "log2_fold", "z", "percentile", "combined_score", "sample_hits", "direction")


@query(WITH + STATS + _scored_sql("v_abundance", "st") + " SELECT sample_id, direction, count(*) AS n FROM sc GROUP BY 1, 2")
def feature_direction(spark, d):
    return tables.named(_scored(spark, d)).groupBy("sample_id", "direction").agg(F.count(F.lit(1)).alias("n"))


#: The richest sample stands for the one a user asks about.
TARGET = ", tg AS (SELECT patient_id, sample_id FROM v_abundance GROUP BY 1, 2 ORDER BY count(*) DESC, sum(value) DESC, sample_id LIMIT 1), cur AS (SELECT * FROM v_abundance WHERE sample_id = (SELECT sample_id FROM tg))"
SCOPED = TARGET + COHORT + """, site AS (SELECT body_site FROM v_patients WHERE patient_id = (SELECT patient_id FROM tg)),
own AS (SELECT count(DISTINCT sample_id) >= 20 AS own FROM h WHERE body_site = (SELECT body_site FROM site)),
hs AS (SELECT * FROM h WHERE NOT (SELECT own FROM own) OR body_site = (SELECT body_site FROM site)),
st AS (SELECT taxon, avg(value) AS avg_abundance, stddev_pop(value) AS std_abundance, count(DISTINCT sample_id) AS sample_hits FROM hs GROUP BY 1)"""
SPATIAL = _scored_sql("cur", "st") + f""", ce AS (SELECT DISTINCT taxon, m AS c FROM (SELECT *, {RANKED} AS rank FROM sc) WHERE rank <= 64),
base AS (SELECT sum(c * c) AS base, count(*) AS dims FROM ce),
lastv AS (SELECT 0 AS side, sample_id, taxon, arg_max(value, pos) AS value FROM hs GROUP BY 1, 2, 3 UNION ALL SELECT 1, sample_id, taxon, arg_max(value, pos) FROM cur GROUP BY 1, 2, 3),
dist AS (SELECT side, sample_id, sqrt(greatest(0.0::DOUBLE, (max(base) + sum(value * value - 2 * value * c)) / max(dims))) AS distance FROM lastv JOIN ce USING (taxon) CROSS JOIN base GROUP BY 1, 2)"""


def _target(spark, d) -> DataFrame:
    return cohort.sample_summaries(A(spark, d)).orderBy(F.desc("feature_count"), F.desc("abundance_total"), "sample_id").select("patient_id", "sample_id").limit(1)


def _compared(spark, d, targets: DataFrame | None) -> DataFrame:
    patients, line, orders = P(spark, d), t(spark, d, "lineitem"), t(spark, d, "orders")
    healthy, sites = tables.healthy(patients), deviation.sites_of(patients)
    facts = tables.facts(line, orders) if targets is not None else tables.facts(line, orders, of=sites, how="left")
    return deviation.compared_samples(patients, healthy, facts, targets, cohort=tables.facts(line, orders, of=healthy.select("patient_id", "body_site")))


@query(WITH + SCOPED + SPATIAL + " SELECT (SELECT coalesce(max(distance), 0) FROM dist WHERE side = 1) AS current_distance, count(*) AS healthy_samples FROM dist WHERE side = 0".replace("(SELECT coalesce", "(SELECT round(coalesce").replace("0) FROM dist WHERE side = 1)", "0), 6) FROM dist WHERE side = 1)"))
def spatial_distance(spark, d):
    return rounded(_compared(spark, d, _target(spark, d)).select("current_distance", "healthy_samples"), "current_distance")


@query(WITH + SCOPED + SPATIAL + """, agg AS (SELECT (SELECT max(distance) FROM dist WHERE side = 1) AS cd, avg(distance) AS mean, stddev_pop(distance) AS sd, 100.0 * count(*) FILTER (distance <= (SELECT max(distance) FROM dist WHERE side = 1)) / count(*) AS pct FROM dist WHERE side = 0),
z AS (SELECT *, CASE WHEN sd > 0 THEN (cd - mean) / sd ELSE 0 END AS z FROM agg)
SELECT round(mean, 6) AS distance_mean, round(sd, 6) AS distance_std, round(z, 5) AS distance_z, round(pct, 5) AS distance_percentile, CASE WHEN z >= 2 OR pct >= 97.5 THEN 'high' WHEN z >= 1 OR pct >= 85 THEN 'moderate' WHEN z <= -1 OR pct <= 35 THEN 'close_to_healthy' ELSE 'mild' END AS deviation_level FROM z""")
def spatial_level(spark, d):
    rows = rounded(_compared(spark, d, _target(spark, d)), "distance_mean", "distance_std")
    return rows.select("distance_mean", "distance_std", F.round("distance_z", 5).alias("distance_z"), F.round("distance_percentile", 5).alias("distance_percentile"), "deviation_level")


@query(WITH + SCOPED + _scored_sql("cur", "st") + f", r AS (SELECT *, {RANKED} AS rank FROM sc) SELECT CAST(rank AS INTEGER) AS rank, sample_id, taxon, value, round(m, 6) AS avg_abundance, round(fold, 6) AS log2_fold, round(percentile, 5) AS percentile, round(score, 5) AS combined_score, direction, CASE WHEN (SELECT own FROM own) THEN 'same_body_site_healthy' ELSE 'all_healthy' END AS reference_scope FROM r WHERE rank <= 8")
def healthy_reference(spark, d):
    rows = _compared(spark, d, _target(spark, d)).select("sample_id", "reference_scope", F.inline("comparisons"))
    return rows.select("rank", "sample_id", "taxon", "value", F.round("avg_abundance", 6).alias("avg_abundance"), F.round("log2_fold", 6).alias("log2_fold"), F.round("percentile", 5).alias("percentile"), F.round("combined_score", 5).alias("combined_score"), "direction", "reference_scope")


@query(WITH + COHORT + """, n AS (SELECT body_site, count(DISTINCT sample_id) AS n FROM h GROUP BY 1),
sco AS (SELECT DISTINCT a.patient_id, a.sample_id, CASE WHEN coalesce(n, 0) >= 20 THEN p.body_site ELSE 'all' END AS scope FROM v_abundance a JOIN v_patients p USING (patient_id) LEFT JOIN n ON n.body_site = p.body_site),
hs AS (SELECT *, body_site AS scope FROM h UNION ALL SELECT *, 'all' FROM h),
sst AS (SELECT scope, taxon, avg(value) AS avg_abundance, stddev_pop(value) AS std_abundance, count(DISTINCT sample_id) AS sample_hits FROM hs GROUP BY 1, 2),
va AS (SELECT v.patient_id, v.sample_id, v.pos, v.value, v.taxon AS name, scope || '|' || v.taxon AS taxon FROM v_abundance v JOIN sco USING (patient_id, sample_id)), st AS (SELECT scope || '|' || taxon AS taxon, avg_abundance, std_abundance, sample_hits FROM sst)""" + _scored_sql("va", "st") + f""", ce AS (SELECT DISTINCT patient_id, sample_id, taxon, m AS c FROM (SELECT *, {RANKED} AS rank FROM sc) WHERE rank <= 64),
base AS (SELECT patient_id, sample_id, sum(c * c) AS base, count(*) AS dims FROM ce GROUP BY 1, 2),
lv AS (SELECT scope || '|' || taxon AS taxon, sample_id AS other, arg_max(value, (pos, value)) AS v FROM hs GROUP BY scope, taxon, sample_id),
di AS (SELECT patient_id, sample_id, other, sqrt(greatest(0.0::DOUBLE, (max(base) + sum(v * v - 2 * v * c)) / max(dims))) AS distance FROM ce JOIN lv USING (taxon) JOIN base USING (patient_id, sample_id) GROUP BY 1, 2, 3),
ow AS (SELECT patient_id, sample_id, sqrt(greatest(0.0::DOUBLE, (max(base) + sum(v * v - 2 * v * c)) / max(dims))) AS distance FROM ce JOIN (SELECT patient_id, sample_id, taxon, arg_max(value, (pos, value)) AS v FROM va GROUP BY 1, 2, 3) USING (patient_id, sample_id, taxon) JOIN base USING (patient_id, sample_id) GROUP BY 1, 2),
ag AS (SELECT patient_id, sample_id, count(*) AS n, avg(di.distance) AS mean, 100.0 * count(*) FILTER (di.distance <= ow.distance + 1e-9::DOUBLE) / count(*) AS pct FROM di JOIN ow USING (patient_id, sample_id) GROUP BY 1, 2)
SELECT patient_id, sample_id, CASE scope WHEN 'all' THEN 'all_healthy' ELSE 'same_body_site_healthy' END AS reference_scope, round(ow.distance, 5) AS current_distance, coalesce(n, 0) AS healthy_samples, round(coalesce(mean, 0), 5) AS distance_mean, round(coalesce(pct, 50), 3) AS distance_percentile,
 (SELECT max(combined) FROM (SELECT round(score, 4) AS combined FROM sc WHERE sc.patient_id = sco.patient_id AND sc.sample_id = sco.sample_id)) AS best_score FROM sco LEFT JOIN ow USING (patient_id, sample_id) LEFT JOIN ag USING (patient_id, sample_id)""".replace("\n", "\n"))
def compared_samples(spark, d):
    """All samples against their cohorts, in the plan that one sample has."""
    rows = _compared(spark, d, None)
    return rows.select("patient_id", "sample_id", "reference_scope", F.round("current_distance", 5).alias("current_distance"), "healthy_samples", F.round("distance_mean", 5).alias("distance_mean"), F.round("distance_percentile", 3).alias("distance_percentile"), F.round(F.get("comparisons", F.lit(0))["combined_score"], 4).alias("best_score"))


# --- structure -------------------------------------------------------------------------

RICH = SUMMARY + ", rk AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY feature_count DESC, abundance_total DESC, sample_id) AS rank FROM s)"
SHARES = """, dm AS (SELECT patient_id, sample_id, feature_count, abundance_total, rk.rank, coalesce(sum(t.value) FILTER (t.rank = 1), 0) / abundance_total AS top1_ratio, coalesce(sum(t.value) FILTER (t.rank <= 3), 0) / abundance_total AS top3_ratio
 FROM rk JOIN top t USING (patient_id, sample_id) GROUP BY 1, 2, 3, 4, 5)"""


@query(WITH + RICH + " SELECT patient_id, sample_id, CAST(rank AS INTEGER) AS rank FROM rk")
def richness_rank(spark, d):
    return structure.richness_rank(cohort.sample_summaries(A(spark, d))).select("patient_id", "sample_id", "rank")


@query(WITH + RICH + ", asked AS (SELECT patient_id, min(sample_id) AS asked FROM s WHERE patient_id % 3 = 0 GROUP BY 1) SELECT rk.patient_id, rk.sample_id FROM rk LEFT JOIN asked USING (patient_id) WHERE (asked IS NULL AND rank = 1) OR sample_id = asked")
def current_sample(spark, d):
    s = cohort.sample_summaries(A(spark, d))
    asked = s.filter("patient_id % 3 = 0").groupBy("patient_id").agg(F.min("sample_id").alias("sample_id"))
    return structure.current_sample(s, asked).select("patient_id", "sample_id")


@query(WITH + RICH + " SELECT patient_id, sample_id FROM rk WHERE rank = 2")
def comparison_sample(spark, d):
    s = cohort.sample_summaries(A(spark, d))
    return structure.comparison_sample(s, structure.current_sample(s)).select("patient_id", "sample_id")


@query(WITH + RICH + TOP + SHARES + " SELECT patient_id, sample_id, round(top1_ratio, 6) AS top1_ratio, round(top3_ratio, 6) AS top3_ratio, CASE WHEN top1_ratio >= 0.45 OR top3_ratio >= 0.75 THEN 'concentrated' WHEN top1_ratio <= 0.20 AND top3_ratio <= 0.50 THEN 'dispersed' ELSE 'medium' END AS dominance FROM dm")
def dominance_profile(spark, d):
    facts = A(spark, d)
    rows = structure.dominance(cohort.top_features(facts, 8), cohort.sample_summaries(facts))
    return rounded(rows.select("patient_id", "sample_id", "top1_ratio", "top3_ratio", "dominance"), "top1_ratio", "top3_ratio")


OVERLAP = """, ka AS (SELECT DISTINCT patient_id, taxon FROM top JOIN rk USING (patient_id, sample_id) WHERE rk.rank = 1), kb AS (SELECT DISTINCT patient_id, taxon FROM top JOIN rk USING (patient_id, sample_id) WHERE rk.rank = 2),
ov AS (SELECT patient_id, count(*) FILTER (a AND b) AS overlap, count(*) FILTER (a AND NOT b) AS only_current, count(*) FILTER (b AND NOT a) AS only_other
 FROM (SELECT patient_id, taxon, bool_or(side = 0) AS a, bool_or(side = 1) AS b FROM (SELECT *, 0 AS side FROM ka UNION ALL SELECT *, 1 FROM kb) GROUP BY 1, 2) WHERE patient_id IN (SELECT patient_id FROM kb) GROUP BY 1)"""


def _two_samples(spark, d):
    return structure.richest_two(structure.profiles(A(spark, d)))


@query(WITH + RICH + TOP + OVERLAP + " SELECT patient_id, CAST(overlap AS INTEGER) AS overlap, CAST(only_current AS INTEGER) AS only_current, CAST(only_other AS INTEGER) AS only_other FROM ov")
def sample_overlap(spark, d):
    return _two_samples(spark, d).select("patient_id", "overlap", "only_current", "only_other")


@query(WITH + RICH + TOP + SHARES + OVERLAP + """ SELECT a.patient_id, a.sample_id, b.sample_id AS other_sample_id, a.feature_count - b.feature_count AS feature_delta, CAST(overlap AS INTEGER) AS overlap,
 CASE WHEN a.feature_count - b.feature_count >= 80 AND a.top3_ratio + 0.10 < b.top3_ratio THEN 'prefer_current' WHEN a.feature_count - b.feature_count <= -80 AND b.rank < a.rank THEN 'prefer_other'
  WHEN a.top1_ratio > b.top1_ratio + 0.10 AND overlap <= 2 THEN 'current_shift' WHEN overlap >= 4 THEN 'stable_heads' ELSE 'visible_difference' END AS advice
 FROM dm a JOIN dm b ON a.patient_id = b.patient_id AND a.rank = 1 AND b.rank = 2 JOIN ov ON ov.patient_id = a.patient_id""")
def comparison_recommendation(spark, d):
    return structure.compared(_two_samples(spark, d))


@query(WITH + STATS + _scored_sql("v_abundance", "st") + f""", r AS (SELECT *, {RANKED} AS rank FROM sc),
i AS (SELECT patient_id, sample_id, least(5, count(DISTINCT taxon)) AS n_top, least(3, count(DISTINCT taxon) FILTER (direction = 'higher')) AS n_raised, least(3, count(DISTINCT taxon) FILTER (direction = 'lower')) AS n_lowered FROM r WHERE rank <= 8 GROUP BY 1, 2)
SELECT patient_id, sample_id, CAST(n_top AS INTEGER) AS n_top, CAST(n_raised AS INTEGER) AS n_raised, CAST(n_lowered AS INTEGER) AS n_lowered, CASE WHEN n_raised >= 2 AND n_lowered >= 1 THEN 'clear_deviation' WHEN n_raised > 0 OR n_lowered > 0 THEN 'some_deviation' ELSE 'near_healthy' END AS deviation_label FROM i""")
def deviation_insight(spark, d):
    rows = tables.named(structure.deviation_insight(_ranked(spark, d, 8)))
    return rows.select("patient_id", "sample_id", *[F.size(c).alias(f"n_{c}") for c in ("top", "raised", "lowered")], "deviation_label")


@query("""WITH raw AS (SELECT p_partkey, 'k__' || p_type || '.p__' || p_brand || CASE p_partkey % 3 WHEN 0 THEN '|c__unclassified' WHEN 1 THEN ';c__' || p_name || '_long-tail_of_name' ELSE '' END AS raw FROM part),
s AS (SELECT p_partkey, list_filter(list_transform(list_reverse(regexp_split_to_array(raw, '[|;.]')), lambda x: trim(translate(regexp_replace(trim(x), '^[a-z]__', ''), '_-', '  '))), lambda x: x <> '' AND lower(x) NOT IN ('unclassified', 'unknown'))[1] AS name FROM raw)
SELECT p_partkey, CASE WHEN length(name) > 26 THEN substring(name, 1, 23) || '...' ELSE name END AS name FROM s""")
def short_taxon_name(spark, d):
    tail = F.when(F.col("p_partkey") % 3 == 0, "|c__unclassified").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(";c__"), "p_name", F.lit("_long-tail_of_name"))).otherwise("")
    raw = F.concat(F.lit("k__"), "p_type", F.lit(".p__"), "p_brand", tail)
    return t(spark, d, "part").select("p_partkey", T.short_taxon_name(raw).alias("name"))


@query("SELECT c_custkey, CASE WHEN lower(c_mktsegment) = lower(n) THEN 'consistent' WHEN n = 'healthy' THEN 'inconsistent' ELSE 'both_unhealthy' END AS label FROM (SELECT *, CASE c_custkey % 3 WHEN 0 THEN 'healthy' WHEN 1 THEN 'BUILDING' ELSE 'MACHINERY' END AS n FROM customer)")
def prediction_consistency(spark, d):
    guess = F.when(F.col("c_custkey") % 3 == 0, "healthy").when(F.col("c_custkey") % 3 == 1, "BUILDING").otherwise("MACHINERY")
    return t(spark, d, "customer").select("c_custkey", structure.consistency_label(F.col("c_mktsegment"), guess).alias("label"))


# --- vectors ---------------------------------------------------------------------------

LONG = "WITH l AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS feature, unnest(embedding)::DOUBLE AS value FROM embeddings)"


def E(spark, d) -> DataFrame:
    return t(spark, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))


@query(LONG + ", s AS (SELECT *, greatest(value, 0) + 1e-6 AS x FROM l), c AS (SELECT *, ln(x / sum(x) OVER (PARTITION BY vec_id)) AS y FROM s) SELECT vec_id, CAST(feature AS INTEGER) AS feature, round(y - avg(y) OVER (PARTITION BY vec_id), 6) AS clr FROM c")
def clr(spark, d):
    return vectors.clr_rows(E(spark, d), "embedding").select("vec_id", F.posexplode("clr").alias("feature", "clr")).withColumn("clr", F.round("clr", 6))


@query("SELECT label, count(*) AS n, round((SELECT count(*) FROM embeddings) / ((SELECT count(DISTINCT label) FROM embeddings) * count(*)), 6) AS weight FROM embeddings GROUP BY 1")
def class_weights(spark, d):
    return rounded(vectors.class_weights(E(spark, d)), "weight")


@query(LONG + ", v AS (SELECT feature, var_pop(value) AS variance FROM l GROUP BY 1) SELECT CAST(feature AS INTEGER) AS feature, round(variance, 6) AS variance FROM v WHERE variance >= (SELECT quantile_cont(variance, 0.2) FROM v)")
def variance_filter(spark, d):
    return rounded(vectors.variance_filter(vectors.variance(vectors.long_form(E(spark, d), "vec_id", "embedding"))), "variance")


@query(LONG + ", r AS (SELECT value, row_number() OVER (PARTITION BY vec_id ORDER BY value DESC) - 1 AS rank FROM l WHERE label = 0) SELECT CAST(rank AS INTEGER) AS rank, round(avg(value), 6) AS mean FROM r WHERE rank < 100 GROUP BY 1")
def healthy_curve(spark, d):
    return rounded(vectors.mean_curve(E(spark, d).filter("label = 0"), "embedding"), "mean")


@query(LONG + ", r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY value DESC, feature) AS rank FROM l) SELECT vec_id, 'f' || CAST(feature AS VARCHAR) AS name, CAST(rank AS INTEGER) AS rank, round(value * 100, 2) AS percent FROM r WHERE rank <= 3")
def vector_topk(spark, d):
    names = F.transform("embedding", lambda x, i: F.concat(F.lit("f"), F.lpad(i.cast("string"), 3, "0")))
    top = E(spark, d).select("vec_id", F.posexplode(vectors.top_classes(names, F.col("embedding"))).alias("at", "x"))
    return top.select("vec_id", F.concat(F.lit("f"), F.substring("x.label", 2, 3).cast("int").cast("string")).alias("name"), (F.col("at") + 1).alias("rank"), F.col("x.percent").alias("percent"))


@query("""WITH f AS (SELECT DISTINCT p_brand AS name FROM part), last AS (SELECT p_brand AS name, arg_max(p_retailprice - 1000, p_partkey) AS value FROM part WHERE p_partkey % 2 = 0 GROUP BY 1)
SELECT f.name, round(greatest(coalesce(value, 0), 0), 6) AS value FROM f LEFT JOIN last USING (name)""")
def feature_align(spark, d):
    part = t(spark, d, "part")
    given = part.filter("p_partkey % 2 = 0").select(F.col("p_brand").alias("name"), (F.col("p_retailprice") - 1000).alias("value"), F.col("p_partkey").alias("pos"))
    return rounded(vectors.align(part.select(F.col("p_brand").alias("name")).distinct(), given), "value")


@query("""WITH p AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings WHERE label = 0),
s AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b FROM p HAVING count(*) >= 3),
e AS (SELECT *, sqrt(greatest((a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b), 0) * 5.991) AS r1, sqrt(greatest((a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b), 0) * 5.991) AS r2, 0.5 * atan2(2 * b, a - c) AS g FROM s),
i AS (SELECT unnest(range(0, 120)) AS i)
SELECT CAST(i AS INTEGER) AS i, round(mx + r1 * cos(i * 2 * pi() / 119) * cos(g) - r2 * sin(i * 2 * pi() / 119) * sin(g), 6) AS x, round(my + r1 * cos(i * 2 * pi() / 119) * sin(g) + r2 * sin(i * 2 * pi() / 119) * cos(g), 6) AS y FROM e, i""")
def cov_ellipse(spark, d):
    points = E(spark, d).filter("label = 0").select(F.get("embedding", F.lit(0)).alias("pc1"), F.get("embedding", F.lit(1)).alias("pc2"))
    return rounded(vectors.ellipse(points), "x", "y")


@query()
def pca_project(spark, d):
    rows = ordination.dense_rows(E(spark, d), "vec_id", "embedding")
    return rounded(ordination.coordinates(rows, ordination.fitted(rows), "vec_id"), "pc1", "pc2")


@query()
def ordination_ellipse(spark, d):
    """The confidence ellipse of a group in the coordinates of all rows."""
    rows = E(spark, d)
    sparse = ordination.dense_rows(rows, "vec_id", "embedding")
    points = ordination.coordinates(sparse, ordination.fitted(sparse), "vec_id")
    return rounded(vectors.ellipse(points.join(rows.filter("label = 0").select("vec_id"), "vec_id", "left_semi")), "x", "y")


@query(LONG + """, sp AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM l GROUP BY 1),
b AS (SELECT l.feature, label, CASE WHEN hi > lo THEN least(7, floor((value - lo) / (hi - lo) * 8)) ELSE 0 END AS bin FROM l JOIN sp USING (feature)),
n AS (SELECT feature, bin, label, count(*) AS n FROM b GROUP BY 1, 2, 3),
w AS (SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS nb, sum(n) OVER (PARTITION BY feature, label) AS nl, sum(n) OVER (PARTITION BY feature) AS na FROM n)
SELECT CAST(feature AS INTEGER) AS feature, round(sum(n / na * ln(n::DOUBLE * na / (nb * nl))), 6) AS information FROM w GROUP BY 1""")
def mi_rank(spark, d):
    rows = E(spark, d)
    return rounded(vectors.mutual_information(vectors.long_form(rows, "vec_id", "embedding"), rows.select("vec_id", "label"), "vec_id", "label"), "information")


@query("SELECT CAST(q AS VARCHAR) AS label, support, round(coalesce(hit / nullif(named, 0), 0), 6) AS precision, round(coalesce(hit / nullif(support, 0), 0), 6) AS recall FROM (SELECT q, (SELECT count(*) FROM x WHERE quality = q) AS support, (SELECT count(*) FROM x WHERE guess = q) AS named, (SELECT count(*) FROM x WHERE quality = q AND guess = q) AS hit FROM (VALUES (0), (1)) v(q))".replace("SELECT CAST(q", "WITH x AS (SELECT quality, CASE WHEN n_chars >= 600 THEN 1 ELSE 0 END AS guess FROM labels JOIN documents USING (doc_id)) SELECT CAST(q", 1))
def classification_report(spark, d):
    rows = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").cast("string").alias("truth"), F.when(F.col("n_chars") >= 600, "1").otherwise("0").alias("guess"))
    return rounded(vectors.report(rows, "truth", "guess").select("label", "support", "precision", "recall"), "precision", "recall")


# --- text and retrieval ----------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_EXPANSIONS = "".join(" || CASE WHEN " + " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in words) + f" THEN '{more}' ELSE '' END" for words, more in T.EXPANSIONS)
EXPANDED = f"SELECT item_id, trim(trim(coalesce(text, '')){_EXPANSIONS} || CASE WHEN regexp_matches(lower(coalesce(text, '')), '[a-z]') THEN '' ELSE '{T.NO_LATIN}' END) AS expanded FROM benchmark"
TOKENS = f"WITH tk AS (SELECT doc_id, lang, list_filter(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z0-9_-]+|[\\x{{4e00}}-\\x{{9fff}}]+'), lambda x: length(x) > 1 AND x NOT IN ({_STOP})) AS tokens FROM documents), dl AS (SELECT doc_id, len(tokens) AS length FROM tk WHERE len(tokens) > 0), po AS (SELECT token, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS token FROM tk) GROUP BY 1, 2)"
BM25 = TOKENS + f""", df AS (SELECT token, count(*) AS df FROM po GROUP BY 1), cs AS (SELECT count(*) AS n, round(avg(length), 6) AS avgdl FROM dl),
q AS (SELECT item_id, token, count(*) AS times FROM (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z0-9_-]+|[\\x{{4e00}}-\\x{{9fff}}]+'), lambda x: length(x) > 1 AND x NOT IN ({_STOP}))) AS token FROM benchmark) GROUP BY 1, 2),
hit AS (SELECT item_id, doc_id, sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * length / avgdl))) AS score FROM q JOIN po USING (token) JOIN df USING (token) JOIN dl USING (doc_id) CROSS JOIN cs GROUP BY 1, 2)"""


def _tokens(spark, d) -> DataFrame:
    return retrieval.tokenized(t(spark, d, "documents").select("doc_id", "lang", "text"))


def _index(spark, d) -> search_index.Index:
    """The one index that all BM25 queries share."""
    return search_index.kept(t(spark, d, "documents"), "doc_id", topic="lang")


def _top(spark, d, k: int, **kind) -> DataFrame:
    asked = t(spark, d, "benchmark").withColumn("expanded", T.expanded_query(F.col("text")))
    return search_index.top_hits(asked, _index(spark, d), "item_id", k, **kind)


@query(TOKENS + " SELECT doc_id, CAST(len(tokens) AS INTEGER) AS length, CAST(len(list_distinct(tokens)) AS INTEGER) AS n_distinct FROM tk WHERE len(tokens) > 0")
def tokenize(spark, d):
    return _tokens(spark, d).select("doc_id", "length", F.size(F.array_distinct("tokens")).alias("n_distinct"))


@query(TOKENS + " SELECT token, count(*) AS df FROM po GROUP BY 1")
def doc_freq(spark, d):
    return retrieval.document_frequency(retrieval.postings(_tokens(spark, d), "doc_id"))


@query(TOKENS + " SELECT count(*) AS n_docs, round(avg(length), 6) AS avgdl FROM dl")
def corpus_stats(spark, d):
    return retrieval.corpus_stats(_tokens(spark, d))


@query("SELECT lang AS topic, count(*) AS papers FROM documents GROUP BY 1")
def topic_counts(spark, d):
    return t(spark, d, "documents").groupBy(F.col("lang").alias("topic")).agg(F.count(F.lit(1)).alias("papers"))


@query(BM25 + ", r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM hit WHERE score > 0) SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def bm25_search(spark, d):
    return rounded(_top(spark, d, 10), "score")


@query(BM25.replace("lower(text), '[A-Za-z][A-Za-z0-9_-]+|[\\x{4e00}-\\x{9fff}]+'), lambda x: length(x) > 1 AND x NOT IN (" + _STOP + "))) AS token FROM benchmark)", "lower(expanded), '[A-Za-z][A-Za-z0-9_-]+|[\\x{4e00}-\\x{9fff}]+'), lambda x: length(x) > 1 AND x NOT IN (" + _STOP + "))) AS token FROM (" + EXPANDED + "))") + """, nm AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_-]+')) AS topic FROM benchmark),
ev AS (SELECT b.item_id, dd.doc_id, coalesce(h.score, 0) + CASE WHEN nm.topic IS NOT NULL THEN 0.20::DOUBLE ELSE 0 END AS score FROM benchmark b CROSS JOIN documents dd LEFT JOIN hit h ON h.item_id = b.item_id AND h.doc_id = dd.doc_id LEFT JOIN nm ON nm.item_id = b.item_id AND nm.topic = lower(dd.lang)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ev WHERE score >= 0.20::DOUBLE)
SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def bm25_search_boosted(spark, d):
    limit = N.clamp_limit(50, 10, 10)  # asked for too many
    return rounded(_top(spark, d, limit, text="expanded", least=0.20, strict=False, bonus=0.20, named="text"), "score")


_KB = "license version token released"
_kb_points = " + ".join(f"CASE WHEN contains(lower(title), '{w}') THEN 1.8::DOUBLE WHEN contains(lower(content), '{w}') THEN 1.0::DOUBLE ELSE 0 END" for w in _KB.split())


def _library(spark, d) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("library"), F.split(text, "\n")[0].alias("title"), text.alias("content"))


@query(f"WITH k AS (SELECT doc_id AS id, source AS library, split_part(coalesce(text, ''), chr(10), 1) AS title, coalesce(text, '') AS content FROM documents), s AS (SELECT *, round(CASE WHEN library = 'src1' THEN 0.35::DOUBLE ELSE 0 END + {_kb_points}, 2) AS score FROM k) SELECT id, library, score FROM s WHERE score > 0 ORDER BY score DESC, library, title, id LIMIT 10")
def kb_search(spark, d):
    return retrieval.keyword_search(_library(spark, d), _KB, ["src1"], 10).select("id", "library", "score")


_KB_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r,.;:!?()\\[\\]\"''/|，。；：！？、（）]+'), lambda x: length(x) >= 2))"


KB_ALL = f"""k AS (SELECT doc_id AS id, source AS library, split_part(coalesce(text, ''), chr(10), 1) AS title, coalesce(text, '') AS content FROM documents),
q AS (SELECT item_id, unnest({_KB_TOKENS}) AS token FROM benchmark),
h AS (SELECT item_id, id, sum(CASE WHEN contains(lower(title), token) THEN 1.8::DOUBLE WHEN contains(lower(content), token) THEN 1.0::DOUBLE ELSE 0 END) AS points FROM q CROSS JOIN k GROUP BY 1, 2),
s AS (SELECT item_id, id, library, title, round(coalesce(points, 0) + CASE WHEN library = 'src1' THEN 0.35::DOUBLE ELSE 0 END, 2) AS score FROM benchmark CROSS JOIN k LEFT JOIN h USING (item_id, id))"""


@query("WITH " + KB_ALL + """
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, library, title, id) AS INTEGER) AS rank, id, library, score FROM s WHERE score > 0 QUALIFY rank <= 10""")
def kb_search_all(spark, d):
    """Every item as a query at once."""
    asked = t(spark, d, "benchmark").withColumn("liked", F.array(F.lit("src1")))
    return substrings.keyword_top(asked, substrings.built(_library(spark, d)), "item_id", 10, preferred="liked").drop("title")


def collapsed(text: str) -> str:
    return f"trim(regexp_replace(replace(translate(coalesce({text}, ''), '`|', '  '), '- ', ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query(f"""WITH f AS (SELECT doc_id, {collapsed("text")} AS flat FROM documents),
k AS (SELECT *, CASE WHEN contains(lower(flat), 'license') THEN strpos(lower(flat), 'license') WHEN contains(lower(flat), 'token') THEN strpos(lower(flat), 'token') END AS hit FROM f)
SELECT doc_id, CASE WHEN hit IS NULL THEN CASE WHEN length(flat) > 120 THEN trim(flat[1:120]) || '...' ELSE flat END
 ELSE CASE WHEN hit > 29 THEN '...' ELSE '' END || trim(flat[greatest(1, hit - 28):hit + 87]) || CASE WHEN hit + 87 < length(flat) THEN '...' ELSE '' END END AS snippet FROM k""")
def kwic_snippet(spark, d):
    words = F.array(F.lit("license"), F.lit("token"))
    return t(spark, d, "documents").select("doc_id", T.kwic(F.coalesce("text", F.lit("")), words).alias("snippet"))


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1))"
_LABEL = "CASE WHEN contains(h, 'pubmed') THEN 'PubMed' WHEN contains(h, 'pmc') THEN 'PubMed Central' " + " ".join(f"WHEN h LIKE '%{e}' THEN '{n}'" for k, e, n, _ in T.DOMAIN_RULES[2:]) + " ELSE h END"


@query(f"SELECT page_id, 'page: ' || CAST(page_id AS VARCHAR) || CASE WHEN trim(coalesce(h, '')) <> '' THEN ' | host: ' || h ELSE '' END AS citation FROM (SELECT page_id, {_HOST} AS h FROM pages)")
def citation(spark, d):
    return t(spark, d, "pages").select("page_id", T.citation(page=F.col("page_id").cast("string"), host=T.host(F.col("url")), note=F.lit(" ")).alias("citation"))


@query(f"SELECT page_id, h AS host, {_LABEL} AS label, CASE WHEN contains(h, 'pubmed') THEN 'literature_index' WHEN contains(h, 'pmc') THEN 'literature_fulltext' WHEN h LIKE '%nih.gov' THEN 'government_research' WHEN h LIKE '%who.int' THEN 'global_guidance' WHEN h LIKE '%cdc.gov' THEN 'public_health_guidance' ELSE 'clinical_reference' END AS kind FROM (SELECT page_id, {_HOST} AS h FROM pages)")
def domain_label(spark, d):
    h = T.host(F.col("url"))
    return t(spark, d, "pages").select("page_id", h.alias("host"), T.source_label(h).alias("label"), T.evidence_type(h).alias("kind"))


@query(f"SELECT page_id, h = 'example.com' OR h LIKE '%.example.com' OR h = 'example.org' OR h LIKE '%.example.org' AS allowed FROM (SELECT page_id, {_HOST} AS h FROM pages)")
def domain_whitelist(spark, d):
    return t(spark, d, "pages").select("page_id", T.allowed_domain(T.host(F.col("url")), ["example.com", "example.org"]).alias("allowed"))


def normalised(text: str) -> str:
    unified = f"regexp_replace(regexp_replace(coalesce({text}, ''), '\\r\\n?', chr(10), 'g'), '[\\x{{2009}}\\x{{2002}}\\x{{2003}}\\x{{a0}}]', ' ', 'g')"
    return f"regexp_replace(regexp_replace({unified}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"""WITH n AS (SELECT doc_id, {normalised("text")} AS body, trim(source) AS source FROM documents)
SELECT doc_id, 0 AS position, 'One' AS heading, length(body) AS n FROM n WHERE body <> '' UNION ALL SELECT doc_id, 2, '正文', length(source) FROM n WHERE source <> ''""")
def md_sections(spark, d):
    parts = [F.lit("### One\n"), F.coalesce("text", F.lit("")), F.lit("\n### References of all\n"), "lang", F.lit("\n### \n"), "source"]
    docs = t(spark, d, "documents").select("doc_id", F.concat(*parts).alias("text"))
    return retrieval.sections(docs, "text").select("doc_id", "position", "heading", F.length("content").alias("n"))


_END = "CASE WHEN marked = 0 THEN least(total, s + 1800) WHEN s + p - marked + 1 < least(total, s + 1116) THEN least(total, s + 1800) ELSE s + p - marked + 1 END"
_MARKED = """SELECT *, length(m) - length(w) AS marked, length(m) - strpos(reverse(m), chr(1)) + 1 AS p FROM (
 SELECT *, regexp_replace(w, '([。！？.!?;；]\\s|\\n\\n)', chr(1) || '\\1', 'g') AS m FROM (SELECT *, substring(body, s + 1, 1800) AS w FROM {rows}))"""
#: The chunker as a recursion over the places where chunks begin.
CHUNKS = f"""WITH RECURSIVE n AS (SELECT doc_id, {normalised("text")} AS body FROM documents),
r AS (SELECT doc_id, body, length(body) AS total, CAST(0 AS BIGINT) AS s FROM n WHERE length(body) > 1800
 UNION ALL SELECT doc_id, body, total, e - 250 FROM (SELECT *, {_END} AS e FROM ({_MARKED.format(rows="r")})) WHERE e < total),
z AS (SELECT doc_id, s, {normalised(f"substring(body, s + 1, {_END} - s)")} AS chunk FROM ({_MARKED.format(rows="r")})),
ch AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS number, chunk FROM z WHERE length(chunk) >= 240
 UNION ALL SELECT doc_id, 1, body FROM n WHERE length(body) BETWEEN 240 AND 1800)"""


@query(CHUNKS + " SELECT doc_id, CAST(number AS INTEGER) AS number, length(chunk) AS n_chars, md5(chunk) AS digest FROM ch")
def chunk_documents(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text")
    return retrieval.chunks(docs, "doc_id", "text").select("doc_id", "number", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


@query(BM25 + """, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS position FROM hit WHERE score > 0),
a AS (SELECT item_id, 0 AS source_rank, position, 'D' || CAST(doc_id AS VARCHAR) AS k FROM r WHERE position <= 5),
b AS (SELECT item_id, 1 AS source_rank, row_number() OVER (PARTITION BY item_id ORDER BY doc_id DESC) AS position, 'd' || CAST(doc_id AS VARCHAR) AS k FROM r WHERE position <= 10 AND position >= 4),
u AS (SELECT item_id, 'pmcid:' || lower(k) AS key, source_rank, position FROM (SELECT * FROM a UNION ALL SELECT * FROM b)),
f AS (SELECT item_id, key, min(source_rank * 1000 + position) AS o FROM u GROUP BY 1, 2),
z AS (SELECT item_id, key, row_number() OVER (PARTITION BY item_id ORDER BY o, key) AS rank FROM f)
SELECT item_id, key, CAST(rank AS INTEGER) AS rank FROM z WHERE rank <= 8""")
def evidence_merge(spark, d):
    top = sinks.written(_top(spark, d, 10), "top")  # both lists read it
    none = F.lit(None).cast("string")
    shape = lambda df, prefix, position: df.select("item_id", position.alias("position"), F.concat(F.lit(prefix), F.col("doc_id").cast("string")).alias("pmcid"), none.alias("url"), none.alias("title"))
    second = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("doc_id")))
    lists = [shape(top.filter("rank <= 5"), "D", F.col("rank")), shape(top.filter("rank >= 4"), "d", second)]
    return retrieval.merged_evidence(lists, "item_id", 8).select("item_id", "key", "rank")


@query("SELECT conv_id, turn, concat_ws(' ', CASE WHEN trim(role) <> '' THEN role END, CASE WHEN trim(text) <> '' AND (role IS NULL OR text <> role) THEN text END) AS built FROM conversations")
def query_builder(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", T.distinct_words(F.col("role"), F.col("text"), F.col("role"), F.lit(" ")).alias("built"))


@query(EXPANDED)
def query_expansion(spark, d):
    return t(spark, d, "benchmark").select("item_id", T.expanded_query(F.col("text")).alias("expanded"))


# --- rules and evaluation --------------------------------------------------------------

_RISKY = "CASE WHEN contains(lower(text), 'pred') OR contains(lower(text), 'risk') OR contains(role, 'prediction') THEN 'PREDICTION_ASSISTANT' WHEN contains(lower(text), 'dashboard') OR contains(role, 'index') THEN 'DASHBOARD_QA' ELSE 'PATIENT_ANALYSIS' END"


@query(f"SELECT conv_id, turn, {_RISKY} AS intent FROM conversations")
def intent_route(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", rules.intent(F.col("text"), F.col("role")).alias("intent"))


@query(f"SELECT conv_id, turn, CASE WHEN {_RISKY} = 'PREDICTION_ASSISTANT' OR conv_id % 2 = 0 THEN 'medium' ELSE 'low' END AS risk FROM conversations")
def risk_level(spark, d):
    pid = F.when(F.col("conv_id") % 2 == 0, F.col("conv_id").cast("string"))
    return t(spark, d, "conversations").select("conv_id", "turn", rules.risk_level(F.col("text"), rules.intent(F.col("text"), F.col("role")), pid, F.lit(None).cast("string")).alias("risk"))


_CASE = """WITH c AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
k AS (SELECT doc_id, lang, contains(text, 'token') AS forbidden, CASE WHEN contains(text, ' ') THEN 0 ELSE 1 END AS miss_must, CASE WHEN contains(text, 'License') THEN 0 ELSE 1 END AS miss_should FROM c),
v AS (SELECT doc_id, lang, CASE WHEN forbidden THEN 'P0' WHEN miss_must > 0 THEN 'P1' WHEN miss_should > 0 THEN 'P2' ELSE 'PASS' END AS severity,
 CASE WHEN forbidden THEN 'prompt-policy' WHEN miss_must > 0 THEN 'response-synthesis' WHEN miss_should > 0 THEN 'prompt-tuning' ELSE 'manual-review' END AS primary_layer FROM k)"""


def _cases(spark, d) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    words = lambda *x: F.array(*[F.lit(w) for w in x])
    must, should, bad = rules.missing(words(" "), text), rules.missing(words("License"), text), rules.hits(words("token"), text)
    none, error = F.array().cast("array<string>"), F.lit(None).cast("string")
    return t(spark, d, "documents").select("doc_id", "lang", rules.severity(error, bad, must, should, none).alias("severity"), F.get(rules.fix_layers(error, bad, must, should, none), F.lit(0)).alias("primary_layer"))


@query(_CASE + " SELECT doc_id, severity, primary_layer FROM v")
def severity(spark, d):
    return _cases(spark, d).select("doc_id", "severity", "primary_layer")


@query(_CASE + " SELECT lang AS suite, severity, count(*) AS n FROM v GROUP BY 1, 2 UNION ALL SELECT 'all', severity, count(*) FROM v GROUP BY 2")
def suite_counters(spark, d):
    return traces.suite_counters(_cases(spark, d), "lang", "severity")


@query("SELECT doc_id, CASE WHEN contains(upper(text), 'FAIL') THEN 'FAIL' WHEN contains(upper(text), 'OPTIMIZE') OR contains(upper(text), 'WARN') THEN 'OPTIMIZE' ELSE 'PASS' END AS gate FROM documents")
def quality_gate(spark, d):
    return t(spark, d, "documents").select("doc_id", rules.quality_gate(F.col("text")).alias("gate"))


# --- ingest ----------------------------------------------------------------------------

_MATRIX = """WITH n AS (SELECT max(c_custkey) AS n FROM customer), e AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, CAST(round(unnest(embedding)::DOUBLE * 20) AS BIGINT) AS value FROM embeddings),
cells AS (SELECT 't' || CAST(vec_id AS VARCHAR) AS taxon, (vec_id * 64 + i - 1) % (n + 4) + 1 AS k, n, value FROM e CROSS JOIN n)"""


def _matrix(spark, d) -> tuple[DataFrame, DataFrame]:
    """Cells of a matrix from the embeddings, dealt over all patients and four samples that are nobody's."""
    customers = t(spark, d, "customer")
    n = F.broadcast(customers.agg(F.max("c_custkey").alias("n")))  # one row
    long = E(spark, d).select("vec_id", F.posexplode("embedding").alias("i", "x")).join(n)
    long = long.select(F.concat(F.lit("t"), F.col("vec_id").cast("string")).alias("taxon"), ((F.col("vec_id") * 64 + F.col("i")) % (F.col("n") + 4) + 1).alias("k"), "n", F.round(F.col("x") * 20).cast("long").cast("string").alias("cell"))
    named = long.join(customers.select(F.col("c_custkey").alias("k"), "c_name"), "k", "left")
    nobody = F.concat(F.lit("nobody-"), (F.col("k") - F.col("n") - 1).cast("string"))
    return named.select("taxon", F.coalesce("c_name", nobody).alias("sample"), "cell"), ingest.patient_lookup(P(spark, d))


@query(_MATRIX + " SELECT c_custkey AS patient_id, c_name AS sample_id, taxon, md5(taxon) AS taxon_hash, value::DOUBLE AS value FROM cells JOIN customer ON c_custkey = k WHERE value <> 0")
def matrix_ingest(spark, d):
    return ingest.facts(*_matrix(spark, d), "v1", "b1").select("patient_id", "sample_id", "taxon", "taxon_hash", "value")


@query(_MATRIX + " SELECT count(DISTINCT taxon) AS taxa, count(*) FILTER (k <= n AND value <> 0) AS inserted, count(*) FILTER (k > n) AS skipped_missing, count(*) FILTER (k <= n AND value = 0) AS skipped_zero FROM cells")
def ingest_metrics(spark, d):
    return ingest.metrics(*_matrix(spark, d))


@query(_MATRIX + " SELECT DISTINCT 'nobody-' || CAST(k - n - 1 AS VARCHAR) AS sample FROM cells WHERE k > n ORDER BY 1 LIMIT 20")
def missing_samples(spark, d):
    return ingest.missing_samples(*_matrix(spark, d))


@query("""WITH n AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey + 1000000000 END AS o_orderkey, o_custkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 5 = 0 OR o_orderkey % 2 = 0)
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(o.o_custkey, n.o_custkey) AS o_custkey, round(coalesce(n.o_totalprice, o.o_totalprice), 6) AS o_totalprice FROM orders o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def upsert(spark, d):
    old = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    key = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).otherwise(F.col("o_orderkey") + 1_000_000_000)
    new = old.filter("o_orderkey % 5 = 0 OR o_orderkey % 2 = 0").select(key.alias("o_orderkey"), "o_custkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return rounded(sinks.upsert(old, new, ["o_orderkey"], ["o_totalprice"]), "o_totalprice")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer")
def point_update(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = rows.filter("c_custkey % 2 = 0 OR c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.lit(0.0)).alias("c_acctbal"))
    return sinks.point_update(rows, new, "c_custkey")


# --- traces and registries -------------------------------------------------------------


@query("SELECT user_id, event_id, CAST(age AS INTEGER) AS age FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events) WHERE age <= 20")
def trace_latest20(spark, d):
    return traces.latest(t(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "age")


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type NOT IN ('click', 'view')) AS other FROM events GROUP BY 1")
def usage_counters(spark, d):
    return traces.usage(t(spark, d, "events"), "user_id", F.col("event_type"), ["click", "view"], "other")


@query("""WITH a AS (SELECT user_id, max(event_id) AS event_id, NULL AS event_type FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, min(event_id) AS event_id, min(event_type) AS event_type FROM events WHERE user_id % 3 = 0 GROUP BY 1)
SELECT user_id, coalesce(a.event_id, b.event_id) AS event_id, coalesce(a.event_type, b.event_type) AS event_type FROM a FULL JOIN b USING (user_id)""")
def context_merge(spark, d):
    e = t(spark, d, "events")
    a = e.filter("user_id % 2 = 0").groupBy("user_id").agg(F.max("event_id").alias("event_id")).withColumn("event_type", F.lit(None).cast("string"))
    b = e.filter("user_id % 3 = 0").groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.min("event_type").alias("event_type"))
    return traces.merged_context(a, b, "user_id")


@query("SELECT name, count(e.event_id) AS n FROM (VALUES ('click'), ('view'), ('never')) v(name) LEFT JOIN events e ON e.event_type = v.name GROUP BY 1")
def zero_filled_enum(spark, d):
    return traces.zero_filled(t(spark, d, "events"), "event_type", ["click", "view", "never"])


@query("SELECT event_type AS transport, count(*) AS total, count(*) FILTER (value > 50) AS active FROM events GROUP BY 1")
def registry_counts(spark, d):
    return traces.registry_counts(t(spark, d, "events"), "event_type", F.col("value") > 50)


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_props(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("long") % 10
    return t(spark, d, "events").groupBy("event_type", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


# --- streaming -------------------------------------------------------------------------

_LAST = "SELECT user_id, arg_max(event_id, (ts, event_id)) AS e, max(ts) AS ts FROM events GROUP BY 1"


def _streamed(spark, d) -> DataFrame:
    events = t(spark, d, "events")
    consumer = queue.Consumer(spark, sinks.scratch_folder(spark, "stream"), "user_id", f"user_id long, risk_score double, risk_level string, ts {events.schema['ts'].dataType.simpleString()}", lambda b: queue.scored(b, "user_id"))
    run = consumer.start(queue.read_queue(spark, f"{d}/events.parque[t]", events.schema), sinks.scratch_folder(spark, "stream-checkpoint"))
    run.awaitTermination()
    return consumer.read()


@query("SELECT user_id, ((user_id * 7919 + 104729) % 10000) / 10000.0::DOUBLE AS risk_score, CASE WHEN ((user_id * 7919 + 104729) % 10000) / 10000.0::DOUBLE > 0.7 THEN 'HIGH' ELSE 'LOW' END AS risk_level FROM (SELECT DISTINCT user_id FROM events)")
def stream_scores(spark, d):
    return _streamed(spark, d).select("user_id", "risk_score", "risk_level")


@query("SELECT user_id, max(ts) AS ts FROM events GROUP BY 1")
def stream_latest_state(spark, d):
    return _streamed(spark, d).select("user_id", "ts")


@query("""WITH g AS (SELECT user_id, arg_max(value, ts) FILTER (event_type <> 'error') AS risk_score, count(*) FILTER (event_type = 'error') AS dead FROM events GROUP BY 1)
SELECT user_id AS patient_id, round(risk_score, 6) AS risk_score, dead FROM g""")
def stream_dead_letters(spark, d):
    """Results as JSON messages; those of errors have no number for a score and end among the dead letters."""
    events = t(spark, d, "events")
    text = F.to_json(F.struct(F.col("user_id").alias("patient_id"), F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string")).alias("risk_score"), F.col("event_type").alias("risk_level"), F.col("ts").cast("string").alias("ts")))
    schema = StructType.fromDDL("patient_id long, risk_score double, risk_level string, ts timestamp")
    root = sinks.scratch_folder(spark, "results")
    consumer = queue.Consumer(spark, root, "patient_id", schema, queue.parsed)
    messages = queue.read_queue(spark, f"{d}/events.parque[t]", events.schema).select(text.alias("value"))
    consumer.start(messages, sinks.scratch_folder(spark, "results-checkpoint")).awaitTermination()
    bad = queue.dead_letters(spark, root, StructType.fromDDL("message string, patient_id long, fault string")).groupBy("patient_id").agg(F.count_if(F.col("fault") == "bad_score").alias("dead"))
    return consumer.read().join(bad, "patient_id", "full").select("patient_id", F.round("risk_score", 6).alias("risk_score"), F.coalesce("dead", F.lit(0)).alias("dead"))


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x_tumbling(spark, d):
    return queue.tumbling(t(spark, d, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""")
def x_session(spark, d):
    return queue.sessions(t(spark, d, "events")).withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query(WITH + "SELECT body_site, disease, count(*) AS n FROM v_patients GROUP BY ROLLUP (body_site, disease)")
def x_rollup(spark, d):
    return P(spark, d).rollup("body_site", "disease").agg(F.count(F.lit(1)).alias("n"))


# --- smaller operators -----------------------------------------------------------------


@query(WITH + "SELECT patient_id, sample_id, min(sample_date) AS first_date, count(*) AS n, arg_min(value, (pos, taxon, value)) AS first_value FROM v_abundance GROUP BY 1, 2".replace("min(sample_date) AS first_date", "arg_min(sample_date, pos) AS first_date"))
def sample_rows_in_order(spark, d):
    first_date = F.min_by("sample_date", F.when(F.col("sample_date").isNotNull(), F.col("pos")))
    first_value = F.min_by("value", F.struct("pos", "taxon", "value"))
    return A(spark, d).groupBy("patient_id", "sample_id").agg(first_date.alias("first_date"), F.count(F.lit(1)).alias("n"), first_value.alias("first_value"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'male' WHEN 1 THEN 'female' WHEN 2 THEN '-' ELSE c_name END AS label FROM customer")
def gender_normalised(spark, d):
    raw = F.when(F.col("c_custkey") % 4 == 0, " M ").when(F.col("c_custkey") % 4 == 1, "Female").when(F.col("c_custkey") % 4 == 3, F.col("c_name"))
    return t(spark, d, "customer").select("c_custkey", T.gender_label(raw).alias("label"))


_ROUTED = f"SELECT conv_id, turn, {_RISKY} AS intent, contains(lower(text), 'search') OR contains(lower(text), 'evidence') OR contains(lower(text), 'latest') OR contains(lower(text), 'guideline') OR contains(lower(text), 'literature') AS outside FROM conversations"


@query(f"SELECT conv_id, turn, CAST(CASE WHEN intent = 'DASHBOARD_QA' THEN 5 WHEN conv_id % 4 = 0 THEN 8 WHEN conv_id % 2 = 0 THEN 5 ELSE 4 END AS INTEGER) AS n_tools, outside AS allow_external_evidence, conv_id % 4 = 0 AND intent <> 'DASHBOARD_QA' AS allow_prediction FROM ({_ROUTED})")
def tool_policy(spark, d):
    text = lambda k: F.when(F.col("conv_id") % k == 0, F.col("conv_id").cast("string"))
    rows = t(spark, d, "conversations").withColumn("intent", rules.intent(F.col("text"), F.col("role")))
    rows = rows.withColumn("tools", rules.available_tools(F.col("intent"), text(2), text(4)))
    flags = rules.policies(F.col("text"), F.col("intent"), F.col("tools"), text(4), F.lit("low"))
    return rows.select("conv_id", "turn", F.size("tools").alias("n_tools"), flags["allow_external_evidence"].alias("allow_external_evidence"), flags["allow_prediction"].alias("allow_prediction"))


@query("SELECT conv_id, CAST(count(*) AS INTEGER) AS n_steps, CAST(7 - (count(DISTINCT role) FILTER (role IN ('workflow', 'intent_resolved'))) AS INTEGER) AS n_missing FROM conversations GROUP BY 1")
def trace_completeness(spark, d):
    there = F.count_distinct(F.when(F.col("role").isin(*rules.CORE_STEPS), F.col("role")))
    return t(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n_steps"), (len(rules.CORE_STEPS) - there).cast("int").alias("n_missing"))


@query("SELECT doc_id, CASE WHEN contains(u, 'FAIL') THEN 'FAIL' WHEN contains(u, 'OPTIMIZE') OR contains(u, 'WARN') THEN 'OPTIMIZE' ELSE 'PASS' END AS gate FROM (SELECT doc_id, upper(coalesce(text, '')) AS u FROM documents)")
def staged_gate(spark, d):
    steps = F.array(F.struct(F.lit("assistant").alias("kind"), F.col("text").alias("output")), F.struct(F.lit("quality").alias("kind"), F.lit("").alias("output")))
    return t(spark, d, "documents").select("doc_id", rules.staged_fold(steps, F.lit("")).getField("gate").alias("gate"))


@query("SELECT event_id, 'user ' || CAST(user_id AS VARCHAR) || ' did ' || event_type AS line FROM events")
def template_filled(spark, d):
    values = F.create_map(F.lit("who"), F.col("user_id").cast("string"), F.lit("what"), F.col("event_type"))
    return t(spark, d, "events").select("event_id", T.filled_template(F.lit("user {{who}} did {{what}}"), values).alias("line"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(list_transform(embedding, lambda x: round(x::DOUBLE * 1000))), 3) AS total FROM embeddings")
def vector_parsed(spark, d):
    raw = F.array_join(F.transform("embedding", lambda x: F.round(x * 1000).cast("long").cast("string")), ",")
    rows = E(spark, d).select("vec_id", N.parse_vector(F.concat(raw, F.lit("\n\t , "))).alias("v"))
    return rows.select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


@query("SELECT user_id, event_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS seen FROM events")
def running_context(spark, d):
    rows = t(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("seen"))
    return traces.running_context(rows, "user_id", "event_id", ["seen"])


@query("SELECT vec_id, CAST((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 5 AS INTEGER) AS fold FROM embeddings")
def stratified_folds(spark, d):
    return boosting.folds_by_rank(E(spark, d).select("vec_id", "label"), "label", "vec_id", 5).select("vec_id", "fold")


@query("SELECT doc_id, nullif(regexp_extract(coalesce(text, ''), '(?:^|[^0-9])([0-9]{1,6})(?:[^0-9]|$)', 1), '') AS first_id FROM documents")
def first_id(spark, d):
    return t(spark, d, "documents").select("doc_id", T.first_id(F.coalesce("text", F.lit(""))).alias("first_id"))


@query("SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS matched, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS unmatched")
def semi_and_anti(spark, d):
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    side = c.join(o, c.c_custkey == o.o_custkey, "left_semi").select(F.lit(1).alias("m")).unionByName(c.join(o, c.c_custkey == o.o_custkey, "left_anti").select(F.lit(0).alias("m")))
    return side.agg(F.count_if(F.col("m") == 1).alias("matched"), F.count_if(F.col("m") == 0).alias("unmatched"))


from . import models, responses, texts  # noqa: E402, F401  (they register their queries)

"""Registered queries: features, curves, models, insight and state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import boosting, deviation, information, structure, vectors
from ..sources import sinks, tables
from ..streaming import queue
from .queries import CHUNKS, LONG, RANKED, SCOPED, SPATIAL, STATS, WITH, A, E, H, _compared, _ranked, _scored, _scored_sql, _target, query, rounded, t

# --- features and curves ---------------------------------------------------------------


@query(LONG + ", v AS (SELECT feature, var_pop(value) AS variance FROM l GROUP BY 1) SELECT CAST(feature AS INTEGER) AS feature, round(variance, 6) AS variance FROM v ORDER BY v.variance DESC, feature LIMIT 38")
def best_features(spark, d):
    scores = vectors.variance(vectors.long_form(E(spark, d), "vec_id", "embedding"))
    return rounded(vectors.best_features(scores, "variance", vectors.kept_features(64)), "variance")


_PSI = "(ln({0} + 6.0::DOUBLE) - 0.5::DOUBLE / ({0} + 6) - 1 / 12.0::DOUBLE / ({0} + 6) ** 2 + 1 / 120.0::DOUBLE / ({0} + 6) ** 4 - 1 / 252.0::DOUBLE / ({0} + 6) ** 6 + 1 / 240.0::DOUBLE / ({0} + 6) ** 8 - 1 / 132.0::DOUBLE / ({0} + 6) ** 10 - 1.0::DOUBLE / {0} - 1.0::DOUBLE / ({0} + 1) - 1.0::DOUBLE / ({0} + 2) - 1.0::DOUBLE / ({0} + 3) - 1.0::DOUBLE / ({0} + 4) - 1.0::DOUBLE / ({0} + 5))"
_NEAR = (
    LONG
    + f""", s AS (SELECT label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY 1 HAVING count(*) > 1), v AS MATERIALIZED (SELECT l.*, s.n FROM l JOIN s USING (label)),
r AS MATERIALIZED (SELECT a.feature, a.vec_id, a.value, a.n, list_sort(list(abs(a.value - b.value)))[least(5, a.n - 1)] AS r FROM v a JOIN v b ON a.feature = b.feature AND a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.feature, a.vec_id, a.value, a.n),
m AS (SELECT r.feature, r.vec_id, r.n, count(*) AS m FROM r JOIN v b ON b.feature = r.feature AND (abs(r.value - b.value) < r.r OR (r.r = 0 AND b.value = r.value)) GROUP BY r.feature, r.vec_id, r.n),
mi AS (SELECT feature, greatest(0, {_PSI.format("count(*)")} + avg({_PSI.format("least(5, n - 1)")}) - avg({_PSI.format("n")}) - avg({_PSI.format("m")})) AS information FROM m GROUP BY 1)"""
)


@query(_NEAR + " SELECT CAST(feature AS INTEGER) AS feature, round(information, 6) AS information FROM mi")
def mi_knn(spark, d):
    return rounded(information.knn_information(E(spark, d), "embedding", "label"), "information")


@query(_NEAR + " SELECT CAST(feature AS INTEGER) AS feature, round(information, 6) AS information FROM (SELECT * FROM mi ORDER BY round(information, 9) DESC, feature LIMIT 38)")
def informative_features(spark, d):
    scores = information.knn_information(E(spark, d), "embedding", "label").withColumn("information", F.round("information", 9))
    return rounded(vectors.best_features(scores, "information", vectors.kept_features(64)), "information")


#: Few, shallow trees at a high rate: a model that a registered query can train.
SHORT = boosting.Params(rounds=8, patience=3, floor=4, depth=3, rate=0.4, bins=32, least_hessian=1.0)


@query()
def train_predict(spark, d):
    rows = E(spark, d)
    model = boosting.fitted(rows, "embedding", "label", "vec_id", SHORT)
    return boosting.predictions(model, rows, "embedding", "vec_id").select("vec_id", "predicted", F.get("top", F.lit(0))["label"].alias("top1"))


@query()
def cv_oof(spark, d):
    return boosting.cross_validated(E(spark, d), "embedding", "label", "vec_id", SHORT, 3)[0]


@query()
def selected_model(spark, d):
    """Variance filter, CLR, features by information, then a model whose rounds the folds decide: top classes of every row."""
    rows = vectors.clr_rows(E(spark, d), "embedding")
    kept = vectors.variance_filter(vectors.variance(vectors.long_form(rows, "vec_id", "embedding"))).select("feature")
    scores = information.knn_information(rows, "clr", "label").join(kept, "feature", "left_semi")
    chosen = [r.feature for r in vectors.best_features(scores, "information", vectors.kept_features(52)).collect()]  # a number per kept feature
    picked = rows.select("vec_id", "label", F.array(*[F.get("clr", F.lit(f)) for f in chosen]).alias("x"))
    _, model = boosting.cross_validated(picked, "x", "label", "vec_id", SHORT, 3)
    top = boosting.predictions(model, picked, "x", "vec_id", {"0": "Healthy"})
    return top.select("vec_id", F.lit(model.rounds).alias("rounds"), F.posexplode("top").alias("place", "c")).select("vec_id", "rounds", "place", F.col("c.label").alias("label"), F.col("c.percent").alias("percent"))


_SHARE = "(('0x' || substring(md5(CAST(vec_id AS VARCHAR) || ':42'), 1, 8))::BIGINT % 1000000) < 400000"


@query(f"SELECT vec_id, label FROM embeddings WHERE {_SHARE}")
def stratified_sample(spark, d):
    return vectors.stratified_sample(E(spark, d), "vec_id", 0.4).select("vec_id", "label")


@query("SELECT greatest(CAST(floor(median(CAST(value AS DOUBLE))) AS INTEGER), 120) AS rounds, greatest(CAST(floor(median(event_id)) AS INTEGER), 120) AS of_ids FROM events")
def best_rounds(spark, d):
    e = t(spark, d, "events")
    low, high = vectors.best_rounds(e, "value"), vectors.best_rounds(e, "event_id").withColumnRenamed("rounds", "of_ids")
    return low.join(F.broadcast(high))  # single rows


_MODE = "SELECT label FROM embeddings GROUP BY 1 ORDER BY count(*) DESC, CAST(label AS VARCHAR) LIMIT 1"
_CURVE = f"cv AS (SELECT r - 1 AS rank, avg(v) AS mean FROM (SELECT value AS v, row_number() OVER (PARTITION BY vec_id ORDER BY value DESC) AS r FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS value FROM embeddings) WHERE label = ({_MODE})) GROUP BY 1)"


@query(f"WITH {_CURVE} SELECT CAST(({_MODE}) AS VARCHAR) AS grp, CAST(rank AS INTEGER) AS rank, round(mean, 6) AS mean FROM cv")
def reference_bundle(spark, d):
    group, curve = vectors.reference_bundle(E(spark, d), "embedding", "label", "no such group")
    return rounded(curve.select(F.lit(group).alias("grp"), "rank", "mean"), "mean")


@query(f"WITH {_CURVE}, u AS (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY value DESC) - 1 AS rank, value FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS value FROM embeddings)) SELECT vec_id, CAST(rank AS INTEGER) AS rank, round(value, 6) AS value, round(mean, 6) AS mean FROM u LEFT JOIN cv USING (rank)")
def curve_beside_reference(spark, d):
    rows = E(spark, d)
    curve = vectors.reference_bundle(rows, "embedding", "label", "no such group")[1]
    return rounded(vectors.curves(rows, "embedding", "vec_id", curve).withColumn("value", F.col("value").cast("double")), "value", "mean")


@query("""WITH p AS (SELECT vec_id, unnest([0, 1, 2, 3, 4]) AS k, unnest(list_transform(embedding[1:5], lambda x: round(abs(x::DOUBLE), 6) + 0.001::DOUBLE)) AS w FROM embeddings), s AS (SELECT *, w / sum(w) OVER (PARTITION BY vec_id) AS q FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY q DESC, name) AS rank FROM (SELECT *, CASE k WHEN 0 THEN 'Healthy' ELSE 'Group ' || CAST(k AS VARCHAR) END AS name FROM s))
SELECT vec_id, CAST(rank - 1 AS INTEGER) AS place, name AS label, round(q * 100, 2) AS percent FROM r WHERE rank <= 3""")
def top3_classes(spark, d):
    weight = F.transform(F.slice("embedding", 1, 5), lambda x: F.round(F.abs(x.cast("double")), 6) + 0.001)
    labels = F.array(*[F.lit(vectors.class_name(str(k), {"0": "Healthy"})) for k in range(5)])
    rows = E(spark, d).select("vec_id", weight.alias("w")).withColumn("total", F.aggregate("w", F.lit(0.0), lambda s, x: s + x))
    top = vectors.top_classes(labels, F.transform("w", lambda x: x / F.col("total")))
    return rows.select("vec_id", F.posexplode(top).alias("place", "c")).select("vec_id", "place", F.col("c.label").alias("label"), F.col("c.percent").alias("percent"))


@query("WITH c AS (SELECT avg(x) AS m FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)) SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: (x::DOUBLE - m) * (x::DOUBLE - m))) / len(embedding)), 6) AS distance FROM embeddings CROSS JOIN c")
def array_distance(spark, d):
    rows = E(spark, d)
    m = F.broadcast(rows.select(F.explode("embedding").alias("x")).agg(F.avg(F.col("x").cast("double")).alias("m")))  # one row
    rows = rows.withColumn("v", F.transform("embedding", lambda x: x.cast("double"))).join(m)
    return rows.select("vec_id", F.round(N.rms_distance(F.col("v"), F.transform("v", lambda x: F.col("m"))), 6).alias("distance"))


@query(WITH + STATS + " SELECT a.patient_id, a.sample_id, a.taxon, a.pos, CASE WHEN avg_abundance IS NULL OR value / avg_abundance >= 1.5 THEN 'higher' WHEN value / avg_abundance <= 1 / 1.5::DOUBLE THEN 'lower' ELSE 'similar' END AS direction FROM v_abundance a LEFT JOIN st USING (taxon) WHERE value > 0")
def direction_by_ratio(spark, d):
    rows = tables.named(_scored(spark, d))
    return rows.select("patient_id", "sample_id", "taxon", "pos", N.direction_by_ratio(F.col("ratio")).alias("direction"))


@query("SELECT vec_id, CASE WHEN round(100 * list_max(w) / list_sum(w), 2) >= 70 THEN 'follow_top1' ELSE 'weigh_top2' END AS advice FROM (SELECT vec_id, list_transform(embedding[1:5], lambda x: greatest(x::DOUBLE, 0) + 0.001::DOUBLE) AS w FROM embeddings)")
def confidence_advice(spark, d):
    """Whether the first class of a row is sure enough to go by."""
    rows = E(spark, d).select("vec_id", F.transform(F.slice("embedding", 1, 5), lambda x: F.greatest(x, F.lit(0.0)) + 0.001).alias("w"))
    percent = F.round(100 * F.array_max("w") / F.aggregate("w", F.lit(0.0), lambda s, x: s + x), 2)
    return rows.select("vec_id", structure.confidence_advice(percent).alias("advice"))


@query("SELECT event_type, round(100.0 * count(*) FILTER (value <= 50) / count(*), 6) AS percentile FROM events GROUP BY 1")
def empirical_percentile(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.round(N.empirical_percentile(F.col("value"), F.lit(50)), 6).alias("percentile"))


# --- insight ---------------------------------------------------------------------------

_LEVEL = """, ag AS (SELECT (SELECT max(distance) FROM dist WHERE side = 1) AS cd, avg(distance) AS mean, stddev_pop(distance) AS sd, 100.0 * count(*) FILTER (distance <= (SELECT max(distance) FROM dist WHERE side = 1)) / count(*) AS pct FROM dist WHERE side = 0),
lv AS (SELECT CASE WHEN z >= 2 OR pct >= 97.5 THEN 'high' WHEN z >= 1 OR pct >= 85 THEN 'moderate' WHEN z <= -1 OR pct <= 35 THEN 'close_to_healthy' ELSE 'mild' END AS level FROM (SELECT *, CASE WHEN sd > 0 THEN (cd - mean) / sd ELSE 0 END AS z FROM ag))"""
_NAME = "regexp_replace(regexp_extract(taxon, '[^.]*$'), '^[a-z]__', '')"


@query(WITH + SCOPED + SPATIAL + _LEVEL + f""", r AS (SELECT *, {RANKED} AS rank, translate({_NAME}, '_', ' ') AS name FROM sc), e AS (SELECT name, direction, min(rank) AS rank FROM r WHERE rank <= 8 GROUP BY 1, 2), b AS (SELECT name, min(rank) AS rank FROM r WHERE rank <= 8 GROUP BY 1),
big AS (SELECT taxon FROM (SELECT *, row_number() OVER (ORDER BY value DESC, taxon, pos) AS k FROM cur) WHERE k <= 120),
sg AS (SELECT translate({_NAME}, '_', ' ') AS name, p FROM (SELECT taxon, row_number() OVER (ORDER BY avg_abundance DESC, sample_hits DESC, taxon) AS p FROM st QUALIFY p <= 12) WHERE taxon NOT IN (SELECT taxon FROM big) ORDER BY p LIMIT 3),
ff AS (SELECT (SELECT string_agg(name, ',' ORDER BY rank) FROM (SELECT * FROM b ORDER BY rank LIMIT 5)) AS top, (SELECT coalesce(string_agg(name, ',' ORDER BY rank), '') FROM (SELECT * FROM e WHERE direction = 'higher' ORDER BY rank LIMIT 3)) AS raised, (SELECT coalesce(string_agg(name, ',' ORDER BY rank), '') FROM (SELECT * FROM e WHERE direction = 'lower' ORDER BY rank LIMIT 3)) AS lowered,
 (SELECT least(3, count(*)) FROM e WHERE direction = 'higher') AS nr, (SELECT least(3, count(*)) FROM e WHERE direction = 'lower') AS nl, (SELECT level FROM lv) AS level, (SELECT coalesce(string_agg(name, ',' ORDER BY p), '') FROM sg) AS signature),
g AS (SELECT *, CASE WHEN level = 'high' OR (nr >= 2 AND nl >= 1) THEN 'clear_deviation' WHEN level = 'moderate' OR nr > 0 OR nl > 0 THEN 'some_deviation' ELSE 'near_healthy' END AS deviation_label FROM ff)
SELECT (SELECT sample_id FROM tg) AS sample_id, top, raised, lowered, level, signature, deviation_label, CASE deviation_label WHEN 'clear_deviation' THEN 'look_at_top_scores' WHEN 'some_deviation' THEN 'check_against_prediction' ELSE 'follow_up' END AS recommendation FROM g""")
def healthy_insight(spark, d):
    rows = _compared(spark, d, _target(spark, d))
    rows = structure.insight_of(rows, "comparisons", F.col("deviation_level"), F.col("missing"))
    joined = [F.array_join(c, ",").alias(c) for c in ("top", "raised", "lowered", "signature")]
    return rows.select("sample_id", *joined, "level", "deviation_label", "recommendation")


@query(WITH + STATS + _scored_sql("v_abundance", "st") + f", r AS (SELECT *, {RANKED} AS rank FROM sc) SELECT patient_id, sample_id, string_agg(substring(regexp_replace({_NAME}, '^_+|_+$', '', 'g'), 1, 20) || '(log2FC ' || CASE WHEN round(fold + 1e-9::DOUBLE, 2) >= 0 THEN '+' ELSE '' END || printf('%.2f', round(fold + 1e-9::DOUBLE, 2) + 0.0::DOUBLE) || ', Z=' || printf('%.2f', round(z + 1e-9::DOUBLE, 2) + 0.0::DOUBLE) || ')', '、' ORDER BY rank) AS text FROM r WHERE rank <= 3 GROUP BY 1, 2")
def difference_lines(spark, d):
    return tables.named(structure.difference_text(rounded2(_ranked(spark, d, 3))))


def rounded2(df: DataFrame) -> DataFrame:
    """Two digits without a negative zero. Values on a half (2.625) are nudged up, as sums in another order fall on either side of it."""
    return df.withColumns({c: F.rint((F.col(c) + 1e-9) * 100) / 100 + 0.0 for c in ("log2_fold", "z")})


# --- SQL surface and state -------------------------------------------------------------


@query(CHUNKS + " SELECT doc_id, count(*) AS n_chunks, sum(length(chunk)) AS n_chars FROM ch GROUP BY 1")
def sql_chunks(spark, d):
    T.register(spark)
    t(spark, d, "documents").createOrReplaceTempView("abundara_documents")
    return spark.sql("SELECT doc_id, count(*) AS n_chunks, sum(length(chunk)) AS n_chars FROM abundara_documents, LATERAL text_chunks(text) GROUP BY doc_id")


@query(WITH + "SELECT DISTINCT taxon, 'part ' || regexp_extract(taxon, '[0-9]+$') AS name, round(ln(1 + (100 - 7 + 0.5) / 7.5::DOUBLE), 6) AS idf FROM v_abundance")
def sql_names(spark, d):
    T.register(spark)
    A(spark, d).createOrReplaceTempView("abundara_facts")
    return spark.sql("SELECT taxon, short_taxon_name(taxon) AS name, round(bm25_idf(100D, 7D), 6) AS idf FROM (SELECT DISTINCT taxon FROM abundara_facts)")


@query("SELECT user_id, count(*) AS n, arg_max(event_type, (ts, event_id)) AS last, list(event_id ORDER BY ts DESC, event_id DESC)[least(20, count(*))] AS oldest FROM events GROUP BY 1")
def session_counts(spark, d):
    """Running state of every session, fed by a stream that is run to its end."""
    events = t(spark, d, "events")
    path = sinks.scratch_folder(spark, "sessions")
    stream = queue.session_state(queue.read_queue(spark, f"{d}/events.parque[t]", events.schema))
    run = stream.writeStream.foreachBatch(lambda rows, number: rows.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)).outputMode("update")
    before = {k: spark.conf.get(k, None) for k in queue.ROCKS_DB}
    for k, v in queue.ROCKS_DB.items():
        spark.conf.set(k, v)
    try:
        run.option("checkpointLocation", sinks.scratch_folder(spark, "sessions-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    latest = F.max_by(F.struct("last", "oldest"), F.struct("batch", "n")).alias("latest")
    return spark.read.parquet(path).groupBy("user_id").agg(F.max("n").alias("n"), latest).select("user_id", "n", "latest.last", "latest.oldest")

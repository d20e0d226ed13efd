"""Compositional vectors: feature selection, ordination, curves, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N

#: Quantile of the chi-square distribution with two degrees of freedom at 95 %, and points of an ellipse.
CHI2_95, ELLIPSE_POINTS = 5.991, 120


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """N / (classes * n of the class)."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("classes"))
    return n.join(F.broadcast(total)).select(label, "n", (F.col("all") / (F.col("classes") * F.col("n"))).alias("weight"))  # one row


def long_form(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, feature, value) of arrays."""
    return rows.select(key, F.posexplode(vector).alias("feature", "value"))


def variance(long: DataFrame, samples: int | None = None, key: str = "vec_id") -> DataFrame:
    """Population variance per feature; with `samples`, absent values count as 0."""
    if samples is None:
        return long.groupBy("feature").agg(F.var_pop("value").alias("variance"))
    return long.groupBy("feature").agg(F.greatest(F.lit(0.0), F.sum(F.col("value") * F.col("value")) / samples - F.pow(F.sum("value") / samples, F.lit(2))).alias("variance"))


def variance_filter(variances: DataFrame, quantile: float = 0.2) -> DataFrame:
    """Features from the quantile of the variances on; interpolated linearly. One row per feature by now."""
    edge = variances.agg(F.percentile("variance", quantile).alias("edge"))
    return variances.join(F.broadcast(edge)).filter(F.col("variance") >= F.col("edge")).drop("edge")  # one row


def mutual_information(long: DataFrame, labels: DataFrame, key: str, label: str, bins: int = 8) -> DataFrame:
    """Mutual information of each feature with the label, over bins of equal width: an approximation by counts."""
    span = long.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    at = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * bins))).otherwise(0).cast("int")
    n = long.join(span, "feature").join(labels, key).groupBy("feature", at.alias("bin"), label).agg(F.count(F.lit(1)).alias("n"))
    by = lambda *c: F.sum("n").over(Window.partitionBy("feature", *c))
    n = n.withColumns({"by_bin": by("bin"), "by_label": by(label), "all": by()})
    return n.groupBy("feature").agg(F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("by_bin") * F.col("by_label")))).alias("information"))


def kept_features(n: int) -> int:
    return max(32, min(1500, int(0.6 * n)))


def best_features(scores: DataFrame, by: str, k: int) -> DataFrame:
    return scores.orderBy(F.desc(by), "feature").limit(k).orderBy("feature")


def stratified_sample(rows: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """The same share of every label: a row stays if the hash of its key falls in it. Deterministic, without a sort or a window."""
    place = F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")
    return rows.filter(F.pmod(place, F.lit(1_000_000)) < int(share * 1_000_000))


def descending(v: Column, n: int) -> Column:
    return F.slice(F.reverse(F.array_sort(v)), 1, n)


def mean_curve(rows: DataFrame, vector: str, n: int = 100) -> DataFrame:
    """Mean of the largest, second largest... value over all vectors."""
    long = rows.select(F.posexplode(descending(F.col(vector), n)).alias("rank", "value"))
    return long.groupBy("rank").agg(F.avg("value").alias("mean"))


def curves(rows: DataFrame, vector: str, key: str, reference: DataFrame, n: int = 100) -> DataFrame:
    """A vector's curve beside the reference curve (rank, mean)."""
    return rows.select(key, F.posexplode(descending(F.col(vector), n)).alias("rank", "value")).join(reference, "rank", "left")


def align(features: DataFrame, payload: DataFrame) -> DataFrame:
    """Values in the model's feature space: unknown names ignored, absent 0, negatives 0, the last of duplicates wins."""
    last = payload.groupBy("name").agg(F.max_by("value", "pos").alias("value"))
    return features.join(last, "name", "left").withColumn("value", F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0)))


def top_classes(labels: Column, probabilities: Column, k: int = 3) -> Column:
    """(label, percent) of the k most probable classes."""
    pairs = F.zip_with(labels, probabilities, lambda a, b: F.struct((-b).alias("o"), a.alias("label"), F.round(b * 100, 2).alias("percent")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct(p["label"].alias("label"), p["percent"].alias("percent")))


def ellipse(points: DataFrame, x: str = "pc1", y: str = "pc2") -> DataFrame:
    """95 % confidence ellipse as points; none for fewer than three points."""
    s = points.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("a"), F.var_samp(y).alias("c"), F.covar_samp(x, y).alias("b"))
    half, gap = (F.col("a") + F.col("c")) / 2, F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, F.lit(2)) + F.col("b") * F.col("b"))
    s = s.filter("n >= 3").withColumns({"r1": F.sqrt(F.greatest(half + gap, F.lit(0.0)) * CHI2_95), "r2": F.sqrt(F.greatest(half - gap, F.lit(0.0)) * CHI2_95), "angle": 0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("c"))})
    t = F.col("i") * (2 * 3.141592653589793 / (ELLIPSE_POINTS - 1))
    rows = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(ELLIPSE_POINTS - 1))).alias("i"))
    return rows.select("i", (F.col("mx") + F.col("r1") * F.cos(t) * F.cos("angle") - F.col("r2") * F.sin(t) * F.sin("angle")).alias("x"), (F.col("my") + F.col("r1") * F.cos(t) * F.sin("angle") + F.col("r2") * F.sin(t) * F.cos("angle")).alias("y"))


def class_name(label: str, names: dict[str, str] | None = None) -> str:
    return (names or {}).get(label, f"Group {label}")


def report(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support by label; 0 where undefined."""
    n = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    by_label = n.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("named"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("named"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    s = by_label.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "named", "hit")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    s = s.withColumns({"precision": ratio(F.col("hit"), F.col("named")), "recall": ratio(F.col("hit"), F.col("support"))})
    return s.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).drop("named", "hit")


def best_rounds(rounds: DataFrame, column: str, floor: int = 120) -> DataFrame:
    """Median of the folds' best rounds, rounded down, `floor` at least."""
    return rounds.agg(F.greatest(F.floor(F.median(column)).cast("int"), F.lit(floor)).alias("rounds"))


def reference_bundle(rows: DataFrame, vector: str, label: str, healthy: str) -> tuple[str, DataFrame]:
    """The reference group (the most frequent one if `healthy` isn't there) and its mean curve."""
    counts = rows.groupBy(F.col(label).cast("string").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    first = counts.orderBy(F.desc(F.col("g") == healthy), F.desc("n"), "g").first()
    group = first.g if first else healthy
    return group, mean_curve(rows.filter(F.col(label).cast("string") == group), vector)


def stub_risk(key: Column) -> Column:
    """A deterministic stand-in score in [0, 1)."""
    return F.pmod(key.cast("long") * 7919 + 104_729, F.lit(10_000)) / 10_000.0


def risk_label(score: Column) -> Column:
    return F.when(score > 0.7, "HIGH").otherwise("LOW")


def clr_rows(rows: DataFrame, vector: str) -> DataFrame:
    return rows.withColumn("clr", N.clr(F.col(vector)))

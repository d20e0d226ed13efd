"""Structure of samples: richness ranks, dominance, comparison of two samples, insight labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T


def richness_order() -> list[Column]:
    return [F.desc("feature_count"), F.desc("abundance_total"), F.asc("sample_id")]


def richness_rank(summaries: DataFrame) -> DataFrame:
    return summaries.withColumn("rank", F.row_number().over(Window.partitionBy("patient_id").orderBy(*richness_order())))


def current_sample(summaries: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """The requested sample of each patient if it has it, else its richest."""
    rows = summaries if requested is None else summaries.join(requested.select("patient_id", F.col("sample_id").alias("asked")), "patient_id", "left")
    first = [] if requested is None else [F.desc(F.coalesce(F.col("sample_id") == F.col("asked"), F.lit(False)))]
    w = Window.partitionBy("patient_id").orderBy(*first, *richness_order())
    return rows.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank", "asked")


def comparison_sample(summaries: DataFrame, current: DataFrame) -> DataFrame:
    """The richest sample of each patient other than the current one."""
    return current_sample(summaries.join(current.select("patient_id", "sample_id"), ["patient_id", "sample_id"], "left_anti"))


def dominance_label(top1: Column, top3: Column) -> Column:
    return F.when((top1 >= 0.45) | (top3 >= 0.75), "concentrated").when((top1 <= 0.20) & (top3 <= 0.50), "dispersed").otherwise("medium")


def dominance(top: DataFrame, summaries: DataFrame) -> DataFrame:
    """Shares of the largest and the three largest values. `top` has ranks from 1; a total of 0 falls back to the listed values."""
    share = top.groupBy("patient_id", "sample_id").agg(F.sum(F.when(F.col("rank") == 1, F.col("value"))).alias("top1"), F.sum(F.when(F.col("rank") <= 3, F.col("value"))).alias("top3"), F.sum("value").alias("listed"))
    rows = summaries.join(share, ["patient_id", "sample_id"], "left").fillna(0.0, ["top1", "top3", "listed"])
    total = F.when(F.col("abundance_total") > 0, F.col("abundance_total")).otherwise(F.col("listed"))
    part = lambda c: F.when(total > 0, F.col(c) / total).otherwise(F.lit(0.0))
    return rows.withColumns({"top1_ratio": part("top1"), "top3_ratio": part("top3")}).withColumn("dominance", dominance_label(F.col("top1_ratio"), F.col("top3_ratio"))).drop("top1", "top3", "listed")


def comparison_advice(delta: Column, top1: Column, top3: Column, other_top1: Column, other_top3: Column, shared: Column, rank: Column, other_rank: Column) -> Column:
    """Which sample to look at; the first rule that holds."""
    return (
        F.when((delta >= 80) & (top3 + 0.10 < other_top3), "prefer_current")
        .when((delta <= -80) & (other_rank < rank), "prefer_other")
        .when((top1 > other_top1 + 0.10) & (shared <= 2), "current_shift")
        .when(shared >= 4, "stable_heads").otherwise("visible_difference")
    )


def profiles(facts: DataFrame, k: int = 8) -> DataFrame:
    """Row per sample: its summary, its k largest values' taxa and its dominance, from one ranking of the facts that the grouping shares."""
    w = Window.partitionBy("patient_id", "sample_id").orderBy(F.desc("value"), "taxon", "pos")
    upto = lambda n: F.sum(F.when(F.col("rank") <= n, F.col("value")))
    rows = facts.withColumn("rank", F.row_number().over(w)).groupBy("patient_id", "sample_id").agg(
        F.count(F.lit(1)).alias("feature_count"), F.sum("value").alias("abundance_total"), F.collect_set(F.when(F.col("rank") <= k, F.col("taxon"))).alias("heads"),
        upto(1).alias("top1"), upto(3).alias("top3"), upto(k).alias("listed"),
    )
    total = F.when(F.col("abundance_total") > 0, F.col("abundance_total")).otherwise(F.col("listed"))
    part = lambda c: F.when(total > 0, F.col(c) / total).otherwise(F.lit(0.0))
    return rows.withColumns({"top1_ratio": part("top1"), "top3_ratio": part("top3")}).drop("top1", "top3", "listed")


def richest_two(profiles: DataFrame) -> DataFrame:
    """Row per patient with two samples at least: its richest (`a`) and its second (`b`) as structs, and sizes of what their heads share."""
    both = richness_rank(profiles).filter("rank <= 2").groupBy("patient_id").agg(*[F.max(F.when(F.col("rank") == n, F.struct("sample_id", "feature_count", "top1_ratio", "top3_ratio", "rank", "heads"))).alias(s) for n, s in ((1, "a"), (2, "b"))])
    size = lambda f, x, y: F.size(f(F.col(f"{x}.heads"), F.col(f"{y}.heads")))
    sizes = {"overlap": size(F.array_intersect, "a", "b"), "only_current": size(F.array_except, "a", "b"), "only_other": size(F.array_except, "b", "a")}
    return both.filter("b IS NOT NULL").withColumns(sizes)


def compared(pairs: DataFrame) -> DataFrame:
    """Advice per patient of `richest_two`."""
    delta = F.col("a.feature_count") - F.col("b.feature_count")
    advice = comparison_advice(delta, F.col("a.top1_ratio"), F.col("a.top3_ratio"), F.col("b.top1_ratio"), F.col("b.top3_ratio"), F.col("overlap"), F.col("a.rank"), F.col("b.rank"))
    return pairs.select("patient_id", F.col("a.sample_id").alias("sample_id"), F.col("b.sample_id").alias("other_sample_id"), delta.alias("feature_delta"), "overlap", advice.alias("advice"))


def insight_of(compared: DataFrame, comparisons: str, level: Column, missing: Column) -> DataFrame:
    """`deviation_insight` for rows that hold a sample's ranked comparisons, level and missing taxa (in order): nothing is joined."""
    name = lambda x: T.short_taxon_name(x)
    items = F.transform(comparisons, lambda x: F.struct(x["rank"].alias("rank"), name(x["taxon"]).alias("name"), x["direction"].alias("direction")))
    signature = F.slice(F.array_distinct(F.transform(missing, name)), 1, 3)
    return _labelled(compared.select("patient_id", "sample_id", items.alias("items"), level.alias("level"), signature.alias("signature")), "level", "signature")


def _labelled(rows: DataFrame, *carried: str) -> DataFrame:
    key = ["patient_id", "sample_id"]
    names = lambda which: F.array_distinct(F.transform(F.filter("items", which), lambda x: x["name"]))
    raised, lowered = F.slice(names(lambda x: x["direction"] == "higher"), 1, 3), F.slice(names(lambda x: x["direction"] == "lower"), 1, 3)
    out = rows.select(*key, F.slice(names(lambda x: x["name"] != ""), 1, 5).alias("top"), raised.alias("raised"), lowered.alias("lowered"), *carried)
    some = (F.size("raised") > 0) | (F.size("lowered") > 0)
    is_level = lambda x: F.coalesce(F.col("level") == x, F.lit(False))
    label = F.when(is_level("high") | ((F.size("raised") >= 2) & (F.size("lowered") >= 1)), "clear_deviation").when(is_level("moderate") | some, "some_deviation").otherwise("near_healthy")
    advice = F.when(F.col("deviation_label") == "clear_deviation", "look_at_top_scores").when(F.col("deviation_label") == "some_deviation", "check_against_prediction").otherwise("follow_up")
    return out.withColumn("deviation_label", label).withColumn("recommendation", advice)


def deviation_insight(comparisons: DataFrame, levels: DataFrame | None = None, signature: DataFrame | None = None) -> DataFrame:
    """Labels of each sample's ranked comparisons: first 5 names, first 3 raised and lowered, an overall label and a recommendation.

    `levels`: (patient_id, sample_id, level) of the distance to the healthy centre, where it is known. `signature`: missing
    healthy taxa (patient_id, sample_id, position, taxon).
    """
    key = ["patient_id", "sample_id"]
    name = T.short_taxon_name(F.col("taxon"))
    rows = comparisons.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", name.alias("name"), "direction"))).alias("items"))
    carried = ["level"] if signature is None else ["level", "signature"]
    rows = rows.withColumn("level", F.lit("mild")) if levels is None else rows.join(levels.select(*key, "level"), key, "left")
    if signature is not None:
        listed = signature.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("position", name.alias("name")))).alias("s"))
        rows = rows.join(listed, key, "left").withColumn("signature", F.coalesce(F.slice(F.array_distinct(F.transform("s", lambda x: x["name"])), 1, 3), F.array().cast("array<string>"))).drop("s")
    return _labelled(rows, *carried)


def consistency_label(disease: Column, top1: Column) -> Column:
    """How a predicted label agrees with the recorded one."""
    d, t = T.disease_label(disease), T.disease_label(top1)
    return (
        F.when((d != "") & (F.lower(d) == F.lower(t)), "consistent").when((d != "healthy") & (t == "healthy"), "inconsistent")
        .when((d != "") & (d != "healthy") & (t != "healthy"), "both_unhealthy").otherwise("needs_context")
    )


def confidence_advice(top1_percent: Column) -> Column:
    return F.when(top1_percent >= 70, "follow_top1").otherwise("weigh_top2")


def difference_text(items: DataFrame, k: int = 3) -> DataFrame:
    """One line per sample: its k most telling taxa with fold change and z. `items` has ranks from 1, each once.

    A line is the greatest text of its rank: rows that were ranked lie in the order of the samples, which such a grouping keeps, while lists would be hashed and sorted again.
    """
    line = F.concat(F.coalesce(T.clean_taxon_name(F.col("taxon")), F.lit("null")), F.lit("(log2FC "), N.hundredths_text(F.col("log2_fold"), "+"), F.lit(", Z="), N.hundredths_text(F.col("z")), F.lit(")"))
    rows = items.filter(F.col("rank") <= k).withColumn("line", line).groupBy("patient_id", "sample_id").agg(*[F.max(F.when(F.col("rank") == i, F.col("line"))).alias(f"line{i}") for i in range(1, k + 1)])
    return rows.select("patient_id", "sample_id", F.concat_ws("、", *[f"line{i}" for i in range(1, k + 1)]).alias("text"))

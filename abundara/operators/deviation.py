"""Comparison of samples with a healthy reference cohort.

The cohort's values are joined once and reduced to per-taxon statistics; every sample of a table is scored against them
by an equi-join. Averages run over stored (non-zero) values, distances over all samples with zeros filled in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import numeric as N
from ..functions import text as T

#: Samples a body site needs for a cohort of its own; limits and sizes of the comparison.
LEAST_SCOPED_SAMPLES, DEFAULT_LIMIT, MOST_LIMIT, DOMINANT = 20, 8, 30, 120


def cohort_facts(healthy: DataFrame, facts: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Stored values of the cohort. Spark broadcasts the cohort if it is small enough, and shuffles it otherwise."""
    return facts.join(healthy.select("patient_id", *columns), "patient_id")


def cohort_counts(cohort: DataFrame) -> DataFrame:
    """Patients and samples with stored values."""
    return cohort.agg(F.count_distinct("patient_id").alias("patient_count"), F.count_distinct("patient_id", "sample_id").alias("sample_count"))


def taxon_stats(cohort: DataFrame, taxa: list[str] | DataFrame | None = None) -> DataFrame:
    """Mean, population deviation and number of samples per taxon; optionally of some taxa only.

    Values are first combined by taxon and sample, so distinct samples need no further shuffle of values.
    """
    rows = cohort
    if isinstance(taxa, DataFrame):
        rows = rows.join(taxa, "taxon", "left_semi")
    elif taxa:
        rows = rows.filter(F.col("taxon").isin(taxa))
    return rows.groupBy("taxon").agg(F.avg("value").alias("avg_abundance"), F.stddev_pop("value").alias("std_abundance"), F.count_distinct("patient_id", "sample_id").alias("sample_hits"))


def top_taxa(stats: DataFrame, k: int) -> DataFrame:
    """Highest means first, then most samples, then name."""
    return stats.orderBy(F.desc("avg_abundance"), F.desc("sample_hits"), "taxon").limit(k)


def scopes(patients: DataFrame, cohort_sites: DataFrame) -> DataFrame:
    """For each body site: its own cohort if it has enough samples, else all healthy samples. `cohort_sites`: cohort facts with body_site."""
    per_site = cohort_sites.filter(T.present(F.col("body_site"))).groupBy("body_site").agg(F.count_distinct("patient_id", "sample_id").alias("scoped"))
    total = cohort_counts(cohort_sites).select(F.col("sample_count").alias("all_samples"))
    sites = patients.select("body_site").distinct().join(per_site, "body_site", "left").withColumn("scoped", F.coalesce("scoped", F.lit(0)))
    own = T.present(F.col("body_site")) & (F.col("scoped") >= LEAST_SCOPED_SAMPLES)
    return sites.join(F.broadcast(total)).select(  # one row
        "body_site", F.when(own, "same_body_site_healthy").otherwise("all_healthy").alias("reference_scope"), F.when(own, F.col("scoped")).otherwise(F.col("all_samples")).alias("healthy_sample_count")
    )


def scored(samples: DataFrame, stats: DataFrame) -> DataFrame:
    """Every positive value of every sample against the reference; taxa without reference count as 0 there.

    Samples are gathered after the join by taxon, so a ranking of theirs needs no further shuffle. Keys may be numbers or texts.
    """
    taxon = F.col("taxon")
    has_taxon = T.present(taxon) if isinstance(samples.schema["taxon"].dataType, StringType) else taxon.isNotNull()
    rows = samples.filter(has_taxon & (F.coalesce("value", F.lit(0.0)) > 0))
    rows = rows.join(stats, "taxon", "left").fillna(0.0, ["avg_abundance", "std_abundance"]).fillna(0, ["sample_hits"])
    return described(rows.withColumn("top", F.max("value").over(Window.partitionBy("patient_id", "sample_id"))))


def described(joined: DataFrame) -> DataFrame:
    """Adds how a value differs from its reference. `top`: the greatest value of the sample, which goes."""
    value, mean = F.col("value"), F.col("avg_abundance")
    out = joined.withColumns({
        "delta": value - mean, "ratio": N.ratio_to(value, mean), "log2_fold": N.log2_fold(value, mean),
        "z": N.z_score(value, mean, F.col("std_abundance")),
    }).withColumn("percentile", N.percentile_of_z(F.col("z"))).withColumn("percentile_deviation", N.percentile_deviation(F.col("percentile")))
    score = N.combined_score(value / F.col("top"), F.col("log2_fold"), F.col("percentile_deviation"))
    return out.withColumns({"combined_score": score, "direction": N.direction(value, mean, F.col("log2_fold"))}).drop("top")


def ranking(name: Column | None = None) -> list[Column]:
    """Scores and folds to nine digits, as whole numbers: F.round would write each double as a decimal text. `name` orders equal ones, the taxon unless given."""
    digits = lambda c: F.rint(c * 1e9)
    return [F.desc(digits(F.col("combined_score"))), F.desc(digits(F.abs("log2_fold"))), F.desc("value"), (F.col("taxon") if name is None else name).asc(), F.asc("pos")]


def ranked(comparisons: DataFrame, k: int, name: Column | None = None) -> DataFrame:
    """The k most telling taxa of each sample, with their rank. `name`: what orders equal taxa where they are numbers."""
    w = Window.partitionBy("patient_id", "sample_id").orderBy(*ranking(name))
    return comparisons.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def spatial_size(limit: int) -> int:
    return min(80, max(40, 8 * limit))


def missing_signature(samples: DataFrame, signature: DataFrame, k: int = 3) -> DataFrame:
    """For each sample, the first k signature taxa (taxon, position) that aren't among its DOMINANT largest rows.

    The signature has a fixed, small number of rows (the caller's limit), so each sample meets each of its rows.
    """
    order = Window.partitionBy("patient_id", "sample_id").orderBy(F.desc("value"), "taxon", "pos")
    per = samples.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= DOMINANT).select("patient_id", "sample_id", "taxon").distinct()
    names = signature.agg(F.array_sort(F.collect_list(F.struct("position", "taxon"))).alias("wanted"))
    held = per.join(F.broadcast(signature.select("taxon")), "taxon").groupBy("patient_id", "sample_id").agg(F.collect_set("taxon").alias("held"))
    all_ = per.select("patient_id", "sample_id").distinct().join(held, ["patient_id", "sample_id"], "left").join(F.broadcast(names))  # one row
    kept = F.slice(F.filter("wanted", lambda w: F.col("held").isNull() | ~F.array_contains(F.col("held"), w["taxon"])), 1, k)
    return all_.select("patient_id", "sample_id", F.posexplode(kept).alias("at", "w")).select("patient_id", "sample_id", (F.col("at") + 1).alias("position"), F.col("w.taxon").alias("taxon"))


#: Distances that differ by less are equal: a sample of the cohort lies as far as itself, whatever the order of its sums.
TIE = 1e-9
#: The scope of all healthy samples, beside those named by body sites, and the cohort's values without a taxon.
EVERYWHERE, NAMELESS = "\x00all", "\x00none"


def scoped(cohort_sites: DataFrame) -> DataFrame:
    """Cohort facts (with body_site) once for all healthy samples and once for their own site, as `scope`."""
    names = F.when(T.present(F.col("body_site")), F.array(F.lit(EVERYWHERE), F.col("body_site"))).otherwise(F.array(F.lit(EVERYWHERE)))
    return cohort_sites.withColumn("scope", F.explode(names)).drop("body_site")


def sites_of(patients: DataFrame) -> DataFrame:
    """(patient_id, sites): the body sites of a patient, one as a rule."""
    return patients.groupBy("patient_id").agg(F.collect_set("body_site").alias("sites"))


def compared_samples(patients: DataFrame, healthy: DataFrame, facts: DataFrame, targets: DataFrame | None, limit: int = DEFAULT_LIMIT, cohort: DataFrame | None = None) -> DataFrame:
    """Every asked sample (patient_id, sample_id) with stored values against its reference, a row each: one plan for a sample or for thousands; without targets, every sample of the facts.

    Statistics exist once for each scope (a body site with enough samples, or all); samples meet them by (scope, taxon). A sample's centre meets the cohort's values of
    its scope by taxon: a sparse product, in which the sum over all taxa is that of the centre's squares plus a correction for stored
    values. Nothing runs before an action, and facts are read four times at most. Only keys, taxa and numbers go through the product; all else of a sample waits where its rows
    were ranked. `cohort`: the cohort's facts with body_site, and `facts` may have the `sites` of their patients, where a caller joins these more cheaply. Columns besides the key:
    reference_scope, healthy_sample_count, healthy_patient_count, comparisons (by rank), missing (signature taxa in order), current_distance, healthy_samples, distance_mean,
    distance_std, distance_z, distance_percentile, deviation_level.
    """
    limit, key = N.clamp_limit(limit, DEFAULT_LIMIT, MOST_LIMIT), ["patient_id", "sample_id"]
    cohort = scoped((cohort_facts(healthy, facts, ("body_site",)) if cohort is None else cohort).select(*key, "taxon", "value", "pos", "body_site"))
    samples = cohort.groupBy("scope", *key).agg(F.count(F.lit(1)).alias("n")).groupBy("scope", "patient_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = samples.groupBy("scope").agg(F.sum("n").alias("healthy_sample_count"), F.count(F.lit(1)).alias("healthy_patient_count"))
    # one shuffle of the cohort serves statistics and values: both come from a sample's list of a taxon, one value as a rule. Values without a taxon, which
    # meet no sample, are named rather than dropped, as a filter would reach the facts and part this scan from that of the samples
    named = cohort.filter("scope IS NOT NULL").withColumn("taxon", F.coalesce("taxon", F.lit(NAMELESS)))
    lists = named.repartition("scope", "taxon").groupBy("scope", "taxon", *[F.col(k).alias(f"of_{k}") for k in key]).agg(F.collect_list(F.struct("pos", "value")).alias("x"))
    each = lists.select("scope", "taxon", F.posexplode("x").alias("at", "x"))
    stats = each.groupBy("scope", "taxon").agg(F.avg("x.value").alias("avg_abundance"), F.stddev_pop("x.value").alias("std_abundance"), F.count_if(F.col("at") == 0).alias("sample_hits"))
    values = lists.withColumn("v", F.array_max("x")["value"]).drop("x")  # the last one

    # a sample's own scope is taken if it is large enough
    large = sizes.filter((F.col("scope") != EVERYWHERE) & (F.col("healthy_sample_count") >= LEAST_SCOPED_SAMPLES)).agg(F.collect_set("scope").alias("large"))
    scope = F.coalesce(F.array_max(F.array_intersect("sites", "large")), F.lit(EVERYWHERE)).alias("scope")
    with_scope = lambda df, *columns: df.crossJoin(F.broadcast(large)).select(*key, *columns, scope)  # noqa: E731 one row
    if targets is None:
        sited = facts if "sites" in facts.columns else facts.join(sites_of(patients), "patient_id", "left")
        current = with_scope(sited.filter("patient_id IS NOT NULL AND sample_id IS NOT NULL"), "taxon", "value", "pos")
    else:
        wanted = targets.select(*key).distinct()
        current = facts.select(*key, "taxon", "value", "pos").join(wanted, key).join(with_scope(wanted.join(sites_of(patients), "patient_id", "left")), key)

    # one sample's rows are sorted in one task: ranks, the last value of a taxon, and the largest rows
    sample = Window.partitionBy(*key)
    usable = T.present(F.col("taxon")) & (F.coalesce("value", F.lit(0.0)) > 0)
    rows = current.join(stats, ["scope", "taxon"], "left").fillna(0.0, ["avg_abundance", "std_abundance"]).fillna(0, ["sample_hits"])
    rows = described(rows.withColumn("top", F.max(F.when(usable, F.col("value"))).over(sample)))
    rows = rows.withColumns({
        "usable": usable, "rank": F.row_number().over(sample.orderBy(F.desc(usable), *ranking())), "place": F.row_number().over(sample.orderBy(F.desc("value"), "taxon", "pos")),
        "last": F.max_by("value", F.struct("pos", "value")).over(Window.partitionBy(*key, "taxon")),
    })
    ranked_ = lambda n: F.col("usable") & (F.col("rank") <= n)
    fields = F.struct("rank", "taxon", "pos", "value", "avg_abundance", "delta", "ratio", "log2_fold", "z", "percentile", "combined_score", "sample_hits", "direction")
    # the centre has the hits too, so it and all else of a sample are made from one shuffle
    centre = F.collect_set(F.when(ranked_(spatial_size(limit)), F.struct("taxon", F.col("avg_abundance").alias("c"), "last", "sample_hits"))).alias("centre")
    per = rows.groupBy(*key, "scope").agg(
        F.array_sort(F.collect_list(F.when(ranked_(limit), fields))).alias("comparisons"), centre,
        F.collect_set(F.when(F.col("place") <= DOMINANT, F.col("taxon"))).alias("held"),
    )  # bounded by the limits
    total = lambda f: F.aggregate("centre", F.lit(0.0), lambda acc, x: acc + f(x))
    near = lambda shift: F.sqrt(F.greatest(F.lit(0.0), (F.col("base") + shift) / F.col("dims")))
    per = per.withColumns({"base": total(lambda x: x["c"] * x["c"]), "dims": F.size("centre"), "shift": total(lambda x: x["last"] * x["last"] - 2 * x["last"] * x["c"])})
    per = per.withColumn("current_distance", F.when(F.col("dims") > 0, near(F.col("shift"))).otherwise(0.0))

    # a row for each taxon of a centre meets the values; the products of a sample are summed where its own row is
    cells = rows.groupBy(*key, "scope").agg(centre).select(*key, "scope", F.explode("centre").alias("x")).select(*key, "scope", "x.taxon", "x.c")
    of = [f"of_{k}" for k in key]
    met = cells.join(values, ["scope", "taxon"]).select(*key, *of, (F.col("v") * F.col("v") - 2 * F.col("v") * F.col("c")).alias("d")).repartition(*key)
    pairs = per.drop("shift", "centre").join(met.groupBy(*key, *of).agg(F.sum("d").alias("shift")), key, "left")
    pairs = pairs.withColumn("distance", F.when(F.col("shift").isNotNull(), near(F.col("shift"))))
    is_near = F.when(F.col("distance") <= F.col("current_distance") + TIE, 1.0).when(F.col("distance").isNotNull(), 0.0)
    own = F.first(F.struct("scope", "comparisons", "held", "current_distance")).alias("own")
    out = pairs.groupBy(*key).agg(own, F.count("distance").alias("healthy_samples"), N.mean_or_zero(F.col("distance")).alias("distance_mean"), N.std_or_zero(F.col("distance")).alias("distance_std"), F.coalesce(100.0 * F.avg(is_near), F.lit(50.0)).alias("distance_percentile"))

    # what is known of the scopes is one row, an entry for each
    first = Window.partitionBy("scope").orderBy(F.col("taxon") == NAMELESS, F.desc("avg_abundance"), F.desc("sample_hits"), "taxon", "std_abundance")
    signature = stats.withColumn("position", F.row_number().over(first)).filter((F.col("position") <= limit + 4) & (F.col("taxon") != NAMELESS)).groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("position", "taxon"))).alias("signature"))
    known = sizes.join(signature, "scope", "left").agg(F.map_from_entries(F.collect_list(F.struct("scope", F.struct("healthy_sample_count", "healthy_patient_count", "signature")))).alias("known"))
    out = out.crossJoin(F.broadcast(known)).withColumn("size", F.try_element_at("known", F.col("own.scope"))).select(*key, "own.*", "size.*", "healthy_samples", "distance_mean", "distance_std", "distance_percentile")
    missing = F.slice(F.filter(F.transform(F.coalesce("signature", F.array().cast("array<struct<position:int,taxon:string>>")), lambda x: x["taxon"]), lambda x: ~F.array_contains("held", x)), 1, 3)
    out = out.fillna(0, ["healthy_sample_count", "healthy_patient_count"]).withColumn("distance_z", N.z_score(F.col("current_distance"), F.col("distance_mean"), F.col("distance_std")))
    return out.select(
        *key, F.when(F.col("scope") == EVERYWHERE, "all_healthy").otherwise("same_body_site_healthy").alias("reference_scope"), "healthy_sample_count", "healthy_patient_count", "comparisons", missing.alias("missing"),
        "current_distance", "healthy_samples", "distance_mean", "distance_std", "distance_z", "distance_percentile", N.deviation_level(F.col("distance_z"), F.col("distance_percentile")).alias("deviation_level"),
    )

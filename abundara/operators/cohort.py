"""Cohort search, paging, summaries and dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T


def search(patients: DataFrame, kind: str | None, value: str | None, case_sensitive: bool = True, escaped: bool = False) -> DataFrame:
    """Filters by id, name or disease; an unknown kind filters nothing. Unescaped values keep % and _ as wildcards."""
    if value is None:
        return patients
    fold = (lambda c: c) if case_sensitive else F.lower
    v = value if case_sensitive else value.lower()
    like = lambda c: F.contains(fold(F.col(c)), F.lit(v)) if escaped else fold(F.col(c)).like(f"%{v}%")
    rules = {"id": F.col("patient_id").cast("string") == value, "name": like("patient_name"), "disease": like("disease")}
    return patients.filter(rules[kind]) if kind in rules else patients


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` from 1."""
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def page_totals(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total")).select("total", F.ceil(F.col("total") / size).cast("long").alias("pages"))


def overview(patients: DataFrame, facts: DataFrame, fields: tuple[str, ...] = (), **others: DataFrame) -> DataFrame:
    """Samples and values per patient, beside the patient's `fields`. Each of `others` (by name, with a patient_id) is a further table whose rows are counted."""
    n = facts.groupBy("patient_id").agg(F.count_distinct("sample_id").alias("sample_count"), F.count(F.lit(1)).alias("value_count"))
    rows, counts = patients.join(n, "patient_id", "left"), ["sample_count", "value_count"]
    for name, table in others.items():
        counts.append(f"{name}_count")
        rows = rows.join(table.groupBy("patient_id").agg(F.count(F.lit(1)).alias(counts[-1])), "patient_id", "left")
    return rows.select("patient_id", *fields, *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def linked(patients: DataFrame, links: DataFrame, targets: DataFrame, column: str, value: str) -> DataFrame:
    """Patients with a link to a target whose `column` is `value`: patients and targets are m:n by `links` (patient_id, target_id). Each patient once, however many links lead to it."""
    met = links.join(targets.filter(F.col(column) == value), "target_id", "left_semi")
    return patients.join(met, "patient_id", "left_semi")


def top_groups(df: DataFrame, column: str, k: int, name: str = "count") -> DataFrame:
    """Largest groups of values that aren't blank; ties by value."""
    return df.filter(T.present(F.col(column))).groupBy(column).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), column).limit(k)


def age_gender(patients: DataFrame) -> DataFrame:
    bracket = N.bucketize(F.col("age"), N.AGE_BRACKETS, N.AGE_REST)
    return patients.filter(F.col("gender").isNotNull()).groupBy(bracket.alias("age_group"), "gender").agg(F.count(F.lit(1)).alias("count"))


def age_gender_pivot(patients: DataFrame) -> DataFrame:
    """Every bracket, with counts of both genders; spellings that differ by case are summed.

    One aggregate over the patients; brackets are unfolded from its single row of counts, so empty ones are there too.
    """
    names = [b[2] for b in N.AGE_BRACKETS] + [N.AGE_REST]
    bracket, sex = N.bucketize(F.col("age"), N.AGE_BRACKETS, N.AGE_REST), F.lower("gender")
    count = lambda name, s: F.count_if((bracket == name) & (sex == s)).alias(s)
    row = patients.agg(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("age_group"), count(n, "male"), count(n, "female")).alias(f"b{i}") for i, n in enumerate(names)])
    return row.select(F.explode(F.array(*[F.col(f"b{i}") for i in range(len(names))])).alias("b")).select("b.*")


def rolled_up(df: DataFrame, column: str, k: int = 5, when_over: int = 6) -> DataFrame:
    """The k largest groups and the sum of the others, if there are more than `when_over`."""
    counts = df.filter(T.present(F.col(column))).groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    # the largest groups are a top-k and the others a sum less theirs, so no task sees all groups
    largest = counts.orderBy(F.desc("n"), "name").limit(max(k, when_over)).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "name", "n"))).alias("all"))
    one = largest.join(F.broadcast(counts.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("total"))))  # two single rows
    head = F.transform(F.when(F.col("groups") <= when_over, F.col("all")).otherwise(F.slice("all", 1, k)), lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n")))
    rest = F.col("total") - F.aggregate("head", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    rows = one.withColumn("head", head).withColumn("rest", rest).select(F.explode(F.when(F.col("rest") > 0, F.concat("head", F.array(F.struct(F.lit("other").alias("name"), F.col("rest").alias("n"))))).otherwise(F.col("head"))).alias("g"))
    return rows.groupBy("g.name").agg(F.sum("g.n").alias("n"))


def sample_summaries(facts: DataFrame) -> DataFrame:
    return facts.groupBy("patient_id", "sample_id").agg(F.max("sample_date").alias("sample_date"), F.count(F.lit(1)).alias("feature_count"), F.sum("value").alias("abundance_total"))


def top_features(facts: DataFrame, k: int) -> DataFrame:
    """Largest k values of each sample, with their rank."""
    w = Window.partitionBy("patient_id", "sample_id").orderBy(F.desc("value"), "taxon", "pos")
    return facts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= N.clamp_limit(k, 20, 100))


def sample_detail(facts: DataFrame, patients: DataFrame | None = None) -> DataFrame:
    """Values, date and name of the largest one, per sample; its unit too where `facts` have one, and the patient's fields where `patients` are given."""
    first = F.struct(-F.col("value"), F.col("pos"), F.col("taxon"), *[F.col(c) for c in facts.columns if c == "unit"])
    names = {"sample_date": "top_date", "taxon": "top_taxon", "unit": "unit"}
    rows = facts.groupBy("patient_id", "sample_id").agg(F.count(F.lit(1)).alias("feature_count"), *[F.min_by(c, first).alias(n) for c, n in names.items() if c in facts.columns])
    return rows if patients is None else rows.join(patients, "patient_id", "left")


def payload(facts: DataFrame) -> DataFrame:
    """Prediction request of every sample: features in order of value."""
    item = F.struct((-F.col("value")).alias("o"), F.col("taxon").alias("name"), F.col("value").alias("value"), F.lit("count").alias("meta"))
    rows = facts.groupBy("patient_id", "sample_id").agg(F.array_sort(F.collect_list(item)).alias("f"))
    return rows.select("patient_id", "sample_id", F.lit("standard_abundance").alias("source"), F.lit("").alias("raw_data"), F.transform("f", lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value"), x["meta"].alias("meta"))).alias("features"))


def payload_present(raw: Column, features: Column) -> Column:
    return F.coalesce(F.trim(raw) != "", F.lit(False)) | (F.coalesce(F.size(features), F.lit(0)) > 0)


def dashboard(patients: DataFrame) -> DataFrame:
    """All headline numbers in one row, from one pass and the disease counts."""
    counts = patients.filter(T.present(F.col("disease"))).groupBy("disease").agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max_by("disease", F.struct(F.col("n"), F.col("disease"))).alias("most_common_disease"), F.max("n").alias("most_common_count"))
    one = patients.agg(F.count("patient_id").alias("total_patients"), F.min("age").alias("min_age"), F.max("age").alias("max_age"), F.count_distinct("country").alias("regions"))
    return one.join(F.broadcast(top)).withColumn("most_common_disease", F.coalesce("most_common_disease", F.lit("N/A")))  # two single rows


def dashboard_bundle(patients: DataFrame, diseases: DataFrame) -> DataFrame:
    """The whole dashboard as one row: the ten most common diseases, countries of origin, counts by age and gender, headline numbers.

    `diseases` has a row per patient and disease. Lists are made from counts: ten diseases, seven brackets and one entry for each country.
    """
    entry = F.struct((-F.col("count")).alias("o"), "name", "count")
    listed = lambda df, by, name: df.withColumnRenamed(by, "name").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(x["name"].alias("name"), x["count"].alias("count"))).alias(name))
    origins = patients.filter(T.present(F.col("country"))).groupBy("country").agg(F.count(F.lit(1)).alias("count"))
    ages = age_gender_pivot(patients).agg(F.array_sort(F.collect_list(F.struct("position", "age_group", "male", "female"))).alias("a"))
    ages = ages.select(*[F.col(f"a.{c}").alias(n) for c, n in (("age_group", "age_brackets"), ("male", "male_counts"), ("female", "female_counts"))])
    out = dashboard(patients).withColumn("most_common_count", F.coalesce("most_common_count", F.lit(0)))
    for part in (listed(top_groups(diseases, "disease", 10), "disease", "diseases"), listed(origins, "country", "origins"), ages):
        out = out.join(F.broadcast(part))  # single rows
    return out


def insight(values: Column, k: int = 3) -> Column:
    """The first k values that aren't blank, and how many there are."""
    kept = F.filter(F.coalesce(values, F.array().cast("array<string>")), T.present)
    return F.struct(F.slice(kept, 1, k).alias("first"), F.size(kept).alias("n"))

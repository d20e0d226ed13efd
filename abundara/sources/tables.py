"""Table scans and the canonical cohort tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, name: str, predicates: list[str] | None = None, **properties: str) -> DataFrame:
    """A relational table; each predicate is read by a task of its own."""
    return spark.read.jdbc(url, name, predicates=predicates, properties=properties) if predicates else spark.read.jdbc(url, name, properties=properties)


def camel_case(df: DataFrame) -> DataFrame:
    """Names like patient_id become patientId."""
    camel = lambda name: name.split("_")[0] + "".join(x[:1].upper() + x[1:] for x in name.split("_")[1:])
    return df.withColumnsRenamed({c: camel(c) for c in df.columns})


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per patient. The small geography tables are joined by Spark's own size check."""
    t = lambda n: table(spark, sf_dir, n)
    geo = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    sex = F.col("c_custkey") % 5
    return t("customer").join(geo, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("patient_id"), F.col("c_name").alias("patient_name"), (F.col("c_custkey") % 97).cast("int").alias("age"),
        F.when(sex <= 1, "male").when(sex <= 3, "female").alias("gender"), F.col("n_name").alias("country"), F.col("r_name").alias("body_site"),
        F.col("c_mktsegment").alias("disease"), F.col("c_acctbal").alias("bmi"),
    )


def abundance(spark: SparkSession, sf_dir: str, unit: str | None = None, of: DataFrame | None = None, how: str = "inner", coded: bool = False) -> DataFrame:
    """Stored (non-zero) values, long form: a sample is a patient's year, a taxon a part. `unit` names the column of a line that stands for its unit.

    `of` has patients (patient_id and columns to take along). They are joined with the orders, so lines are shuffled by order alone. `coded`: samples and taxa
    stay numbers (a year, a part) until `named` gives their texts, so shuffles carry and sorts compare numbers.
    """
    return facts(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), unit, of, how, coded)


def taxon_name(part: Column) -> Column:
    return F.concat(F.lit("k__life.g__part_"), part.cast("string"))


def sample_name(patient: Column, year: Column) -> Column:
    return F.concat(patient.cast("string"), F.lit("-"), year.cast("string"))


def named(coded: DataFrame) -> DataFrame:
    """Texts for the numbers of coded values, as far as these have the columns."""
    names = {"sample_id": lambda: sample_name(F.col("patient_id"), F.col("sample_id")), "taxon": lambda: taxon_name(F.col("taxon"))}
    return coded.withColumns({c: name() for c, name in names.items() if c in coded.columns})


def facts(lineitem: DataFrame, orders: DataFrame, unit: str | None = None, of: DataFrame | None = None, how: str = "inner", coded: bool = False) -> DataFrame:
    """`abundance` of tables that are read already."""
    o = orders.select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("o_date"))  # a date is found once an order, not once a line
    more = [] if of is None else [c for c in of.columns if c != "patient_id"]
    if of is not None:
        o = o.join(of.withColumnRenamed("patient_id", "o_custkey"), "o_custkey", how)
    line = lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", *([unit] if unit else []))
    patient, year, part = F.col("o_custkey"), F.year("o_date"), F.col("l_partkey")
    sample = F.when(patient.isNotNull(), year) if coded else sample_name(patient, year)  # values without a patient have no sample either way
    return line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        patient.alias("patient_id"), sample.alias("sample_id"), (part if coded else taxon_name(part)).alias("taxon"), F.col("l_quantity").alias("value"), F.col("o_date").alias("sample_date"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("pos"),
        *([F.col(unit).alias("unit")] if unit else []), *more,
    )


def healthy(patients_: DataFrame) -> DataFrame:
    return patients_.filter(F.lower(F.trim("disease")) == HEALTHY)


#: The segment that stands for the healthy cohort.
HEALTHY = "building"

#: The same tables for the SQL oracle, as common table expressions.
SQL = """
v_patients AS (
  SELECT c_custkey AS patient_id, c_name AS patient_name, CAST(c_custkey % 97 AS INTEGER) AS age,
         CASE WHEN c_custkey % 5 <= 1 THEN 'male' WHEN c_custkey % 5 <= 3 THEN 'female' END AS gender,
         n_name AS country, r_name AS body_site, c_mktsegment AS disease, c_acctbal AS bmi
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
v_abundance AS (
  SELECT o_custkey AS patient_id, CAST(o_custkey AS VARCHAR) || '-' || CAST(year(o_orderdate) AS VARCHAR) AS sample_id,
         'k__life.g__part_' || CAST(l_partkey AS VARCHAR) AS taxon, l_quantity AS value, CAST(o_orderdate AS DATE) AS sample_date,
         l_orderkey * 100 + l_linenumber AS pos
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
v_healthy AS (SELECT * FROM v_patients WHERE lower(trim(disease)) = 'building')
"""

"""Matrix ingest: cells to keyed facts, with metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import sinks

#: Columns that may match a sample to its patient.
MATCH_COLUMNS = ("patient_name", "patient_id")
KEYS = ("patient_id", "sample_id", "taxon_hash", "feature_version")


def match_column(name: str) -> Column:
    if name not in MATCH_COLUMNS:
        raise ValueError(f"samples are matched by one of {MATCH_COLUMNS}")
    return F.col(name).cast("string")


def patient_lookup(patients: DataFrame, match: str = "patient_name") -> DataFrame:
    """(sample, patient_id): the last patient of a name wins; null names are left out."""
    rows = patients.select(match_column(match).alias("sample"), "patient_id").filter(F.col("sample").isNotNull())
    return rows.groupBy("sample").agg(F.max("patient_id").alias("patient_id"))


def cell_value(c: Column) -> Column:
    """Number of a cell; empty cells and text are 0."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def facts(cells: DataFrame, lookup: DataFrame, feature_version: str, batch: str, unit: str = "relative", normalisation: str = "none", skip_zero: bool = True) -> DataFrame:
    """Fact rows of the cells (taxon, sample, cell) whose sample is known."""
    rows = cells.join(lookup, "sample").withColumn("value", cell_value(F.col("cell")))
    rows = rows.filter("value <> 0") if skip_zero else rows
    return rows.select(
        "patient_id", F.col("sample").alias("sample_id"), "taxon", F.md5("taxon").alias("taxon_hash"), "value",
        F.lit(unit).alias("unit"), F.lit(feature_version).alias("feature_version"), F.lit(batch).alias("source_batch"), F.lit(normalisation).alias("normalisation"),
    )


def metrics(cells: DataFrame, lookup: DataFrame) -> DataFrame:
    """Taxa, cells to insert, cells of unknown samples, zeros: one pass."""
    rows = cells.join(lookup, "sample", "left").withColumn("value", cell_value(F.col("cell")))
    known = F.col("patient_id").isNotNull()
    return rows.agg(
        F.count_distinct("taxon").alias("taxa"), F.count_if(known & (F.col("value") != 0)).alias("inserted"),
        F.count_if(~known).alias("skipped_missing"), F.count_if(known & (F.col("value") == 0)).alias("skipped_zero"),
    )


def missing_samples(cells: DataFrame, lookup: DataFrame, k: int = 20) -> DataFrame:
    """The first k unknown samples by name."""
    return cells.select("sample").distinct().join(lookup, "sample", "left_anti").orderBy("sample").limit(k)


def merge(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Insert, or update value, unit, batch and normalisation of rows with the same key."""
    return sinks.upsert(existing, new, KEYS, ("value", "unit", "source_batch", "normalisation"))

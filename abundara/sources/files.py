"""File sources: wide matrices, metadata, JSON lines, Markdown corpora, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BOM = "﻿"


def without_bom(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BOM}", "")


def matrix_cells(lines: DataFrame, line_col: str = "value", header: str | None = None, sep: str = ",") -> DataFrame:
    """Long cells (taxon, sample, cell) of a wide matrix given as text lines; names of samples are one literal array in the plan, not columns.

    `header` is the first line (read by `read_matrix`); blank rows and blank taxa are skipped, a row of another
    width than the header raises.
    """
    names = [x.strip() for x in (header or "").lstrip(BOM).split(sep)]
    if len(names) < 2:
        raise ValueError("a matrix needs a taxon column and a sample column")
    samples = F.array(*[F.lit(x) for x in names[1:]])
    cells = F.split(without_bom(F.col(line_col)), sep)
    rows = lines.filter(F.trim(F.col(line_col)) != "").select(cells.alias("cells")).filter(F.trim(F.col("cells")[0]) != "")
    width = F.when(F.size("cells") == len(names), F.col("cells")).otherwise(F.raise_error(F.concat(F.lit("ragged row: "), F.col("cells")[0])))
    rows = rows.select(width.alias("cells")).select(F.trim(F.col("cells")[0]).alias("taxon"), F.posexplode(F.slice("cells", 2, len(names))).alias("at", "cell"))
    return rows.select("taxon", F.get(samples, F.col("at")).alias("sample"), F.trim("cell").alias("cell"))


def read_matrix(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    lines = spark.read.text(path)
    header = lines.filter(F.trim(without_bom(F.col("value"))) != "").first()
    if header is None:
        raise ValueError("an empty matrix")
    rows = lines.filter(without_bom(F.col("value")) != header.value.lstrip(BOM))
    return matrix_cells(rows, "value", header.value, sep)


def read_metadata(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def labelled_matrix(cells: DataFrame, metadata: DataFrame, sample_col: str = "sampleID", group_col: str = "Group") -> DataFrame:
    """Cells of samples that have metadata, with their group; the long form makes a transpose needless."""
    return cells.join(metadata.select(F.col(sample_col).alias("sample"), F.col(group_col).alias("group")), "sample").withColumn("value", F.coalesce(F.col("cell").try_cast("double"), F.lit(0.0)))


def last_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key that isn't blank."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return df.filter(F.trim(F.col(key)) != "").withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def read_index(spark: SparkSession, path: str, schema: str, key: str = "pmcid") -> DataFrame:
    """JSON lines without the malformed ones; the last line of a key wins: files in order of their path, lines in order of their place."""
    place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")]
    lines = spark.read.text(path).select("value", *[c.alias(f"__{i}") for i, c in enumerate(place)]).withColumn("__line", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    parsed = lines.select(F.struct("__0", "__1", "__line").alias("__at"), F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).filter(F.col("r").isNotNull())
    return last_of_each(parsed.select("__at", "r.*"), key, "__at").drop("__at")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Chunks, evaluation cases, traces: malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document of one row, and whether it is ready: all its fields are there."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    ready = F.lit(True)
    for c in rows.columns:
        ready = ready & F.col(c).isNotNull()
    return rows.withColumn("ready", ready)


def read_markdown(spark: SparkSession, path: str, pattern: str = "*.md", recursive: bool = False, key_pattern: str = r"([^/]+)\.md$") -> DataFrame:
    """(path, key, text) of Markdown files, sorted by path only where the caller orders."""
    return spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=recursive).select(F.col("_metadata.file_path").alias("path"), F.regexp_extract(F.col("_metadata.file_path"), key_pattern, 1).alias("key"), without_bom(F.col("value")).alias("text"))

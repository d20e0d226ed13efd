"""Session traces, usage counters, registries and evaluation suites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: traces kept per session.
KEPT = 20


def latest(events: DataFrame, session: str, order: Sequence[str], k: int = KEPT) -> DataFrame:
    """The k latest rows of each session."""
    w = Window.partitionBy(session).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= k)


def usage(events: DataFrame, session: str, kind: Column, kinds: Sequence[str], other: str) -> DataFrame:
    """Count per kind and session, in columns; kinds that aren't listed count as `other`."""
    bucket = F.when(kind.isin(*kinds), kind).otherwise(other)
    return events.groupBy(session).agg(*[F.count_if(bucket == k).alias(k) for k in dict.fromkeys([*kinds, other])])


def merged_context(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Each field from the incoming row, else from the stored one."""
    s = stored.select(key, *[F.col(c).alias(f"__{c}") for c in stored.columns if c != key])
    rows = incoming.join(s, key, "full")
    return rows.select(key, *[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) for c in incoming.columns if c != key])


def running_context(events: DataFrame, session: str, order: str, fields: Sequence[str]) -> DataFrame:
    """The context of a session after each event: the last value that isn't null."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return events.select(session, order, *[F.last(c, True).over(w).alias(c) for c in fields])


def zero_filled(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Count of each of the values, 0 for those that don't occur."""
    counts = df.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.createDataFrame([(v,) for v in values], "name string")
    return names.join(counts, "name", "left").fillna(0, ["n"])


def registry_counts(rows: DataFrame, transport: str, active: Column) -> DataFrame:
    return rows.groupBy(F.col(transport).alias("transport")).agg(F.count(F.lit(1)).alias("total"), F.count_if(active).alias("active"))


def registry_get(rows: DataFrame, key: str, value: str, timeout: str | None = None) -> DataFrame:
    """Lookup in any case; a missing timeout is 60."""
    found = rows.filter(F.lower(F.col(key)) == value.lower())
    return found if timeout is None else found.withColumn(timeout, F.coalesce(timeout, F.lit(60)))


def ordered_steps(flows: DataFrame, intent: str, column: str = "steps") -> DataFrame:
    """The intent's flows, steps sorted by their first field."""
    return flows.filter(F.col("intent") == intent).withColumn(column, F.array_sort(column))


def suite_counters(results: DataFrame, suite: str, severity: str) -> DataFrame:
    """Cases by suite and severity, with a row of suite "all" for each severity: one shuffle."""
    both = results.select(F.explode(F.array(F.col(suite), F.lit("all"))).alias("suite"), F.col(severity).alias("severity"))
    return both.groupBy("suite", "severity").agg(F.count(F.lit(1)).alias("n"))


def counters_map(counters: DataFrame) -> DataFrame:
    return counters.groupBy("suite").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("severity", "n")))).alias("counts"))


def merged_maps(*maps: Column) -> Column:
    """Later maps win; null maps are empty."""
    empty = F.create_map().cast("map<string,string>")
    entries = F.concat(*[F.map_entries(F.coalesce(m, empty)) for m in maps])
    last = F.filter(entries, lambda e, i: F.size(F.filter(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"])) == 0)
    return F.map_from_entries(last)


def source_catalogue(spark, internal: str, domains: Sequence[str], labels: Column) -> DataFrame:
    """The internal source first, then the trusted domains with their labels."""
    rows = spark.createDataFrame([(0, internal)] + [(i, d) for i, d in enumerate(domains, 1)], "rank int, domain string")
    return rows.withColumn("label", F.when(F.col("rank") == 0, F.col("domain")).otherwise(labels))

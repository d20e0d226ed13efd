"""A table that is partitioned by a hash of its key, so that a merge rewrites the buckets of its keys alone."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from . import sinks


class BucketedTable:
    """Rows under `path`, in folders bucket=0, 1, ...

    A merge reads the touched buckets, writes their new rows beside the table, notes where they are, and overwrites these buckets
    dynamically. The note goes last, so a merge that was broken off is finished from its rows by whoever opens the table next. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, list(keys), buckets
        for name in self._notes("merging"):
            self._overwrite(spark.read.schema(self._bucketed_schema()).parquet(self._staged(name)))
            self._finish(name)

    # --- files of the table's own, next to its buckets ---

    def _fs(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _notes(self, kind: str) -> list[str]:
        path, fs = self._fs(f"_{kind}")
        return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []

    def _note(self, kind: str, name: str) -> None:
        path, fs = self._fs(f"_{kind}", name)
        fs.mkdirs(path.getParent())
        fs.create(path).close()

    def _staged(self, name: str) -> str:
        return f"{self.path}/_staged/{name}"

    def _finish(self, name: str) -> None:
        self._note("done", name)
        for done in self._notes("done")[:-1]:  # the last one is enough
            path, fs = self._fs("_done", done)
            fs.delete(path, False)
        for parts in (("_merging", name), ("_staged", name)):
            path, fs = self._fs(*parts)
            fs.delete(path, True)

    def done(self) -> int:
        """Number of the last merge; -1 if there was none."""
        return max((int(n) for n in self._notes("done")), default=-1)

    # --- rows ---

    def _bucketed_schema(self) -> StructType:
        return StructType([*self.schema.fields]).add("bucket", IntegerType())

    def _with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _stored(self) -> DataFrame:
        path, fs = self._fs()
        there = fs.exists(path) and any(f.getPath().getName().startswith("bucket=") for f in fs.listStatus(path))
        return self.spark.read.schema(self._bucketed_schema()).parquet(self.path) if there else self.spark.createDataFrame([], self._bucketed_schema())

    def read(self) -> DataFrame:
        return self._stored().drop("bucket")

    def _overwrite(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def merge(self, new: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], number: int | None = None) -> list[int]:
        """Replaces the touched buckets by combine(their old rows, new rows); a number that was merged before does nothing. Returns the buckets."""
        number = self.done() + 1 if number is None else number
        if number <= self.done():
            return []
        name = f"{number:012d}"
        rows = sinks.written(self._with_bucket(new.select(*self.schema.names)), "merge")
        touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # at most `buckets` numbers
        if touched:
            old = self._stored().filter(F.col("bucket").isin(touched)).drop("bucket")
            merged = self._with_bucket(combine(old, rows.drop("bucket")).select(*self.schema.names))
            merged.hint("rebalance", "bucket").write.mode("overwrite").parquet(self._staged(name))
            self._note("merging", name)
            self._overwrite(self.spark.read.schema(self._bucketed_schema()).parquet(self._staged(name)))
        self._finish(name)
        return touched


def newest_by(keys: Sequence[str], order: Column) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Of old and new rows of a key, the one with the greatest `order` stays; one grouping with map-side combining."""

    def combine(old: DataFrame, new: DataFrame) -> DataFrame:
        rows = old.unionByName(new)
        names = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), order).alias("r")).select(*keys, "r.*")

    return combine


def upserted(keys: Sequence[str], updated: Sequence[str] | None = None, order: str | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda old, new: sinks.upsert(old, new, keys, updated, order)

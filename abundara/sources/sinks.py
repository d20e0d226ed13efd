"""Sinks: keyed upsert, dry run, versioned overwrite, JSON and CSV writers, and a result cache."""

from __future__ import annotations

import fnmatch
import json
import tempfile
import time
import uuid
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F


def scratch_folder(spark, tag: str) -> str:
    """A new folder under spark.checkpoint.dir, which executors share; in local mode a temporary one where that is unset, elsewhere an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="abundara-")
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows as a table in the shared folder, for plans that read them several times."""
    path = scratch_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], updated: Sequence[str] | None = None, order: str | None = None) -> DataFrame:
    """Rows after an insert that updates on conflict.

    One grouping by key, with map-side combining: no window, no sort of whole rows. On a conflict the columns in
    `updated` (all by default) come from the new row, the others stay. Of several new rows of a key the last by `order` wins.
    """
    names = [c for c in existing.columns if c not in keys]
    changed = set(names if updated is None else updated)
    row = lambda df, side, pos: df.select(*keys, F.struct(*names).alias("row"), F.lit(side).alias("side"), pos.alias("pos"))
    both = row(existing, 0, F.lit(0).cast("long")).unionByName(row(new, 1, F.col(order).cast("long") if order else F.lit(0).cast("long")))
    last = lambda side: F.max_by(F.when(F.col("side") == side, F.col("row")), F.when(F.col("side") == side, F.col("pos")))
    merged = both.groupBy(*keys).agg(last(0).alias("old"), last(1).alias("new"))
    pick = lambda c: F.when(F.col("new").isNull(), F.col(f"old.{c}")).when(F.col("old").isNull() | F.lit(c in changed), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))
    return merged.select(*[F.col(k) if k in keys else pick(k).alias(k) for k in existing.columns])


def point_update(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Columns of `updates` replace those of matching rows, nulls too."""
    names = [c for c in updates.columns if c != key]
    u = updates.select(F.col(key), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in names])
    joined = target.join(u, key, "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in target.columns])


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def versioned_overwrite(df: DataFrame, root: str, view: str) -> str:
    """Writes a new version beside the old one, then swaps the view: readers never see half a table."""
    path = f"{root.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    df.sparkSession.read.parquet(path).createOrReplaceTempView(view)
    return path


def dry_run(df: DataFrame, **metrics: Any) -> dict[str, Any]:
    """Runs the plan without writing; metrics are aggregate columns."""
    seen = Observation()
    df.observe(seen, *[c.alias(k) for k, c in ({"rows": F.count(F.lit(1))} | metrics).items()]).write.format("noop").mode("overwrite").save()
    return seen.get


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_document(df: DataFrame, path: str) -> None:
    """A table of one row (a manifest, statistics, an artifact) as one JSON document."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_sorted_csv(df: DataFrame, path: str, by: str, *ties: str) -> None:
    """One sorted CSV file: for results of a row per feature, not for data."""
    df.orderBy(F.desc(by), *ties).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


class ResultCache:
    """Persisted results by name and parameters, with a time to live. Holds plans on the driver, rows on the executors."""

    def __init__(self, seconds: float = 600, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self.kept = seconds, clock, {}

    def get(self, name: str, make: Callable[..., DataFrame], **params: Any) -> DataFrame:
        key = f"{name}:{json.dumps(params, sort_keys=True, default=str)}"
        entry = self.kept.get(key)
        if entry and entry[0] > self.clock():
            return entry[1]
        if entry:
            entry[1].unpersist()
        df = make(**params).persist()
        self.kept[key] = (self.clock() + self.seconds, df)
        return df

    def invalidate_matching(self, pattern: str) -> int:
        """Drops all results whose key matches a pattern with * and ?."""
        return sum(self.invalidate(k) for k in [k for k in self.kept if fnmatch.fnmatchcase(k, pattern)])

    def invalidate(self, prefix: str) -> int:
        """Drops all results whose key begins with the prefix."""
        keys = [k for k in self.kept if k.startswith(prefix)]
        for k in keys:
            self.kept.pop(k)[1].unpersist()
        return len(keys)

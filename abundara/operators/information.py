"""Mutual information of continuous features with a label by nearest neighbours, without a feature in one task.

For a value with k neighbours of its own label (fewer where the label is rarer) let r be the distance to the k-th and m the number
of values of any label nearer than r, itself included (at r = 0: equal to it). The information of a feature is
psi(n) + mean psi(k) - mean psi(n of the label) - mean psi(m), at least 0; labels of a single row take no part.

Values are range-sorted by (feature, label, value, place), so the values of a label lie in runs over consecutive tasks; a run's neighbours beyond its borders
are the k outermost values of the runs beside it. A second range sort, of values and of the ends of each value's interval, gives m as a
difference of two ranks: counts in earlier tasks plus the count in the task. Equal values, such as zeros, are parted by place.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..sources import sinks

NEIGHBOURS = 5


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles."""
    b = (x + 0.0).view(np.int64)
    return np.where(b < 0, np.int64(-(1 << 63)) - b, b)


def from_bits(b: np.ndarray) -> np.ndarray:
    return np.where(b < 0, np.int64(-(1 << 63)) - b, b).view(np.float64)


def halved(good: np.ndarray, bad: np.ndarray, nearer) -> np.ndarray:
    """The last double from `good` towards `bad` that `nearer` accepts: a search over the doubles themselves, so rounding of differences is respected."""
    good, bad = ordered_bits(good), ordered_bits(bad)
    for _ in range(65):
        mid = (good & bad) + ((good ^ bad) >> 1)
        ok = nearer(from_bits(mid))
        good, bad = np.where(ok, mid, good), np.where(ok, bad, mid)
    return from_bits(good)


def interval(x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest double whose rounded distance to x is below r; x itself at r = 0."""
    wide = np.full(len(x), np.finfo(np.float64).max)
    low = np.where(r > 0, halved(x, -wide, lambda v: (x - v) < r), x)
    high = np.where(r > 0, halved(x, wide, lambda v: (v - x) < r), x)
    return low, high


def kth_distances(values: np.ndarray, first: int, last: int, k: int) -> np.ndarray:
    """Distance from each of values[first:last], a sorted run with its neighbours, to its k-th nearest other value."""
    n = len(values)
    x = values[first:last]
    out = np.full(len(x), np.inf)
    padded = np.concatenate([np.full(k, -np.inf), values, np.full(k, np.inf)])
    at = np.arange(first, last) + k
    if n > k:
        for left in range(k + 1):  # so many of the k lie on the left
            lo = x - padded[at - left] if left else np.zeros(len(x))
            hi = padded[at + k - left] - x if left < k else np.zeros(len(x))
            out = np.minimum(out, np.maximum(lo, hi))
    return out


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def radii(long: DataFrame, k: int) -> DataFrame:
    """(feature, value, place, k, low, high): each value's interval. `long`: (feature, label, value, place, n of the label)."""
    dealt = long.repartitionByRange(_partitions(long), "feature", "label", "value", "place").sortWithinPartitions("feature", "label", "value", "place")
    table = sinks.written(dealt.withColumn("task", F.spark_partition_id()), "radii")
    # the runs that touch a task's borders: k outermost values of each (task, feature, label)
    size = Window.partitionBy("task", "feature", "label")
    ends = table.withColumns({"up": F.row_number().over(size.orderBy("value", "place")), "down": F.row_number().over(size.orderBy(F.desc("value"), F.desc("place")))}).filter((F.col("up") <= k) | (F.col("down") <= k))
    runs = ends.groupBy("task", "feature", "label").agg(F.array_sort(F.collect_list(F.when(F.col("up") <= k, F.col("value")))).alias("heads"), F.array_sort(F.collect_list(F.when(F.col("down") <= k, F.col("value")))).alias("tails"))
    spans = runs.groupBy("feature", "label").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("task", "heads", "tails"))).alias("runs")).filter("n > 1")  # a row per task and run
    own = spans.select("feature", "label", F.explode("runs").alias("own"), "runs")
    near = own.select(
        F.col("own.task").alias("task"),
        "feature",
        "label",
        _last(F.flatten(F.transform(F.filter("runs", lambda x: x["task"] < F.col("own.task")), lambda x: x["tails"])), k).alias("before"),
        F.slice(F.flatten(F.transform(F.filter("runs", lambda x: x["task"] > F.col("own.task")), lambda x: x["heads"])), 1, k).alias("after"),
    )
    kind = table.schema["feature"].dataType.simpleString()

    def run(key, group, beside):
        import pyarrow as pa

        group = group.sort_by([("value", "ascending"), ("place", "ascending")])
        values, n = group.column("value").to_numpy(), group.num_rows
        if not n:
            return pa.table({c: pa.array([], t) for c, t in kinds.items()})
        k_own = min(k, int(group.column("n")[0].as_py()) - 1)
        outer = [np.array(beside.column(c)[0].as_py() if beside.num_rows else [], np.float64) for c in ("before", "after")]
        r = kth_distances(np.concatenate([outer[0], values, outer[1]]), len(outer[0]), len(outer[0]) + n, k_own)
        low, high = interval(values, r)
        return pa.table({"feature": group.column("feature"), "value": group.column("value"), "place": group.column("place"), "k": pa.array(np.full(n, k_own, np.int32)), "low": low, "high": high, "n": group.column("n")})

    keys = ("task", "feature", "label")
    schema = f"feature {kind}, value double, place long, k int, low double, high double, n long"
    kinds = {f.name: f.type for f in to_arrow_schema(schema)}
    return table.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInArrow(run, schema)


def to_arrow_schema(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema as to_arrow
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow(_parse_datatype_string(ddl))


def _last(values: Column, k: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - k + 1, F.lit(1)), k)


def ranks(events: DataFrame) -> DataFrame:
    """(feature, place, sign, below): values that come before each end of an interval, in the common order of a feature. `events`: (feature, at, kind, place); kind 1 is a value."""
    dealt = events.repartitionByRange(_partitions(events), "feature", "at", "kind", "place").sortWithinPartitions("feature", "at", "kind", "place")
    table = sinks.written(dealt.withColumn("task", F.spark_partition_id()), "ranks")
    counts = table.groupBy("task", "feature").agg(F.count_if(F.col("kind") == 1).alias("n"))
    before = counts.select("task", "feature", (F.sum("n").over(Window.partitionBy("feature").orderBy("task")) - F.col("n")).alias("before"))  # a row per task and feature
    w = Window.partitionBy("task", "feature").orderBy("at", "kind", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = table.withColumn("inside", F.count_if(F.col("kind") == 1).over(w)).filter("kind <> 1")
    return inside.join(before, ["task", "feature"]).select("feature", "place", F.when(F.col("kind") == 0, -1).otherwise(1).alias("sign"), (F.col("inside") + F.col("before")).alias("below"))


def knn_information(rows: DataFrame, vector: str, label: str, k: int = NEIGHBOURS) -> DataFrame:
    """(feature, information) in nats, by k nearest neighbours of the same label. Null labels, and null or NaN values, are left out.

    The number of values with the label is counted for each feature, as vectors may lack some.
    """
    spread = rows.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), F.posexplode(vector).alias("feature", "v"))
    long = spread.select("feature", "label", F.monotonically_increasing_id().alias("place"), (F.col("v").cast("double") + 0.0).alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    sizes = sinks.written(long.groupBy("feature", "label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "label-sizes")
    found = sinks.written(radii(long.join(sizes, ["feature", "label"]), k), "intervals")
    value = found.select("feature", F.col("value").alias("at"), F.lit(1).alias("kind"), "place")
    low = found.select("feature", F.col("low").alias("at"), F.lit(0).alias("kind"), "place")
    high = found.select("feature", F.col("high").alias("at"), F.lit(2).alias("kind"), "place")
    within = ranks(value.unionByName(low).unionByName(high)).groupBy("feature", "place").agg(F.sum(F.col("sign") * F.col("below")).alias("m"))
    of_values = within.groupBy("feature").agg(F.avg(N.digamma(F.col("m"))).alias("m"))
    of_labels = found.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.avg(N.digamma(F.col("k"))).alias("k"), F.avg(N.digamma(F.col("n"))).alias("labels"))
    information = N.digamma(F.col("n")) + F.col("k") - F.col("labels") - F.col("m")
    return of_values.join(of_labels, "feature").select("feature", F.greatest(F.lit(0.0), information).alias("information"))

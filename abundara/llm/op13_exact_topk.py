"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers, are range-sorted by length (longest first) and written; a task's runs of BUCKET rows are the buckets, each of
nearly equal lengths. Every query starts with the k-th best product among the SEEDS longest vectors as its threshold. In a bucket whose
longest vector is l, only vectors with a cosine of at least threshold / (|q| l) can matter: above 1 the bucket is skipped; from COSINE on,
the region that this angle leaves in the query's largest coordinates is looked up in the bucket's sorted coordinates (coordinate pruning); else, or
where those lists are long, the bucket's prefix of vectors that are long enough is taken (length pruning). What is left is verified
by exact integer products (`exact_gemm`). A bucket returns at most k rows a query, and Spark keeps the k best.

Queries are written too and every task reads them in blocks, so no set of queries has to fit in memory and
nothing is broadcast but the seeds, whose number is fixed.

Edge cases: vectors that are null, or hold null or non-finite components, take no part. Ties go to the smaller id, null ids last. Rows that share
a query's id are the query's own, so they are no candidates of it; a query id that is there twice gets a list for each of its
rows. Null ids are no queries. Shorter vectors are filled with zeros. Fewer candidates than k give all of them. Equal
lengths are dealt by place, so copies spread. Empty tables give no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, exact_gemm, vectors

SCALE, K = 1024, 10
#: Rows of a bucket, vectors that give the first thresholds, bytes of integers in a task, rows of a block of queries.
BUCKET, SEEDS, TASK_BYTES, BLOCK = 8192, 1024, 32 << 20, 1024
#: Least local cosine at which coordinates are looked at, coordinates looked at, and the share of a bucket up to which their list is worth it.
COSINE, FOCUS, WORTH = 0.7, 4, 0.25
#: Slack of floating-point lengths and angles; pruning may keep too much, never too little.
SLACK = 1e-9
#: Stands for a missing threshold.
NONE = -float("inf")
FOUND = "q long, query_id long, vec_id long, score long"


def by_length(ints: DataFrame) -> DataFrame:
    """The table (id, v, length), range-sorted by falling length and written. Equal lengths are parted by their place in the input."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = ints.select("id", "v", length.alias("length"), F.monotonically_increasing_id().alias("place"))
    n = max(common.shuffle_partitions(ints.sparkSession), -(-(common.input_bytes(ints) or 0) // TASK_BYTES))
    dealt = rows.repartitionByRange(n, F.desc("length"), "place").sortWithinPartitions(F.desc("length"), "place")
    return common.spill(dealt.drop("place"), "by-length")


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: highest score first, then the least id."""
    if scores.dtype == object:  # beyond 64 bits
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    return np.lexsort((ids, -scores))[:k]


class Bucket:
    """Vectors of nearly equal lengths, longest first."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, lengths: np.ndarray):
        self.ids, self.x, self.lengths = ids, x, lengths
        self.unit = None

    def sorted_coordinates(self) -> None:
        if self.unit is None:
            self.unit = self.x / np.maximum(self.lengths, 1e-300)[:, None]
            self.order = np.argsort(self.unit, axis=0)
            self.values = np.take_along_axis(self.unit, self.order, axis=0)

    def by_coordinates(self, q: np.ndarray, length: float, cosine: float) -> np.ndarray | None:
        """Rows whose coordinates an angle of at most arccos(cosine) to q allows; None where the lists are long."""
        self.sorted_coordinates()
        u = q / length
        angle = np.arccos(min(1.0, cosine)) + 1e-7
        focus = np.argsort(-np.abs(u))[:FOCUS]
        own = np.arccos(np.clip(u[focus], -1.0, 1.0))
        low, high = np.cos(np.minimum(np.pi, own + angle)) - SLACK, np.cos(np.maximum(0.0, own - angle)) + SLACK
        spans = [(np.searchsorted(self.values[:, f], lo, "left"), np.searchsorted(self.values[:, f], hi, "right")) for f, lo, hi in zip(focus, low, high, strict=True)]
        first = min(range(len(focus)), key=lambda i: spans[i][1] - spans[i][0])
        if spans[first][1] - spans[first][0] > WORTH * len(self.ids):
            return None
        rows = self.order[spans[first][0] : spans[first][1], focus[first]]
        part = self.unit[rows][:, focus]
        return np.sort(rows[((part >= low) & (part <= high)).all(axis=1)])

    def search(self, ids: np.ndarray, x: np.ndarray, lengths: np.ndarray, least: np.ndarray, k: int, stats: dict | None = None):
        """For each query (place, rows of the bucket, scores): up to k best rows that reach its threshold `least`."""
        count = stats if stats is not None else {}
        longest = float(self.lengths[0]) if len(self.lengths) else 0.0
        reach = lengths * longest * (1 + SLACK)
        prefix = {}
        for i in np.flatnonzero((least <= 0) | (least <= reach)):
            cosine = least[i] / reach[i] if reach[i] > 0 else NONE
            rows = self.by_coordinates(x[i], lengths[i], cosine * (1 - SLACK)) if cosine >= COSINE and x.shape[1] else None
            if rows is not None:
                count["coordinate"] = count.get("coordinate", 0) + 1
                yield i, *self.kept(rows, exact_gemm.product(x[i : i + 1], self.x[rows])[0], ids[i], least[i], k)
                continue
            bound = least[i] / lengths[i] * (1 - SLACK) if least[i] > 0 else NONE
            prefix[i] = len(self.lengths) - np.searchsorted(self.lengths[::-1], bound, "left")
        count["length"] = count.get("length", 0) + len(prefix)
        count["verified"] = count.get("verified", 0) + sum(prefix.values())
        count["skipped"] = count.get("skipped", 0) + int(((least > 0) & (least > reach)).sum())
        if prefix:
            rows = max(prefix.values())
            places = np.array(list(prefix))
            products = exact_gemm.product(x[places], self.x[:rows])
            for i, scores in zip(places, products, strict=True):
                yield i, *self.kept(np.arange(prefix[i]), scores[: prefix[i]], ids[i], least[i], k)

    def kept(self, rows: np.ndarray, scores: np.ndarray, own: int, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        good = (scores >= least) & (self.ids[rows] != own)
        rows, scores = rows[good], scores[good]
        if len(rows) > 4 * k:  # ties with the k-th stay until ids decide
            edge = np.sort(scores)[-k]
            rows, scores = rows[scores >= edge], scores[scores >= edge]
        top = best_of(scores, self.ids[rows], k)
        return rows[top], scores[top]


def id_numbers(column) -> np.ndarray:
    """Ids as numbers; null becomes the largest long, so it comes last."""
    return np.asarray(column.fill_null((1 << 63) - 1).to_numpy(zero_copy_only=False), np.int64)


def thresholds(queries: DataFrame, seeds: list, width: int, k: int) -> DataFrame:
    """Adds `least`: the k-th best product with the seeds, or none."""
    x = np.array([r.v for r in seeds], np.int64).reshape(len(seeds), width)
    ids = np.array([(1 << 63) - 1 if r.id is None else r.id for r in seeds], np.int64)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            own = id_numbers(batch.column(1))
            out = []
            for at in range(0, len(own), BLOCK):
                scores = exact_gemm.product(vectors.matrix(batch.column(2).slice(at, BLOCK), width), x)
                for i, s in zip(own[at : at + BLOCK], scores, strict=True):
                    s = s[ids != i]
                    out.append(float(np.nextafter(float(np.sort(s)[-k]), NONE)) if len(s) >= k else NONE)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=["q", "id", "v", "length", "least"])

    return queries.select("q", "id", "v", "length").mapInArrow(run, "q long, id long, v array<long>, length double, least double")


def top_products(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """(q, query_id, rank, vec_id, score): the k highest integer products of each query row. `is_query` is a condition on the column `id`."""
    ints = vectors.integers(rows, vector, scale, id=id_col).withColumn("id", F.col("id").cast("long"))
    width = vectors.width_of(ints)
    table = by_length(ints.withColumn("v", vectors.padded(F.col("v"), width)))
    seeds = table.orderBy(F.desc("length"), "id", "v").limit(SEEDS).select("id", "v").collect()  # SEEDS rows
    numbered = table.filter(is_query).withColumn("q", F.monotonically_increasing_id())
    where = common.new_folder(rows.sparkSession, "queries")
    thresholds(numbered, seeds, width, k).write.parquet(where)

    def run(batches):
        import pyarrow as pa
        import pyarrow.dataset as ds

        def search(bucket):
            files, path = common.file_system(where)
            for block in ds.dataset(path, filesystem=files, format="parquet").to_batches(batch_size=BLOCK):
                if not block.num_rows:
                    continue
                q = {n: block.column(n) for n in block.schema.names}
                ids, numbers = id_numbers(q["id"]), q["q"].to_numpy()
                out = [(numbers[i], ids[i], bucket.ids[r], s) for i, r, s in bucket.search(ids, vectors.matrix(q["v"], width), q["length"].to_numpy(), q["least"].to_numpy(), k) if len(r)]
                if not out:
                    continue
                sizes = [len(s) for *_, s in out]
                found = np.concatenate([v for _, _, v, _ in out])
                columns = [pa.array(np.repeat([a for a, *_ in out], sizes), pa.int64()), pa.array(np.repeat([b for _, b, *_ in out], sizes), pa.int64()), pa.array(found, pa.int64(), mask=found == (1 << 63) - 1), pa.array(np.concatenate([np.minimum(s, (1 << 63) - 1).astype(np.int64) for *_, s in out]), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["q", "query_id", "vec_id", "score"])

        kept, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET):
                piece = batch.slice(at, BUCKET)
                if n + piece.num_rows > BUCKET:
                    yield from search(bucket_of(kept, width))
                    kept, n = [], 0
                kept.append(piece)
                n += piece.num_rows
        if n:
            yield from search(bucket_of(kept, width))

    found = table.select("id", "v", "length").mapInArrow(run, FOUND)
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bucket_of(batches: list, width: int) -> Bucket:
    ids = np.concatenate([id_numbers(b.column(0)) for b in batches])
    x = np.concatenate([vectors.matrix(b.column(1), width) for b in batches])
    lengths = np.concatenate([np.asarray(b.column(2).to_numpy(zero_copy_only=False), np.float64) for b in batches])
    order = np.argsort(-lengths, kind="stable")  # scans may join runs of several files
    return Bucket(ids[order], x[order], lengths[order])


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
                        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

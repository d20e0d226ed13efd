"""Product codes of vectors: exact integer k-means by limb-split products.

Components become integers floor(scale * x), vectors are cut into equal parts, and each part position gets a codebook.
A task forms dot products of its rows with all entries by BLAS on limbs (`exact_gemm`), recombines them in
int64 and takes the first least of |c|^2 - 2 x.c. It sums components per entry before anything is shuffled, so a round moves
parts x entries rows a task; the driver holds codebooks only (parts x entries x width numbers). Every round reads the written
table of integers again, so a lost executor costs its tasks alone.

Edge cases: rows whose vector is null, or holds null or non-finite components, are dropped. Ties go to the lower entry. A codebook
begins with the parts of the rows of least ids, null ids last, equal ids by content; fewer rows give fewer entries. Entries
that no part chose stay. Shorter vectors are filled with zeros up to the longest, and all up to a multiple of the number of parts. Components
beyond a long are its ends; sums use wider integers then, and an error beyond a long is its end. Repeated rows are rows of their own. Empty
tables give no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, exact_gemm, vectors

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
LONG_MAX = (1 << 63) - 1
SUMS = "part int, entry int, at int, total decimal(38,0), n long"


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First nearest entry of each row, and its squared distance, in exact integers."""
    gap = exact_gemm.squares(entries)[None, :] - 2 * exact_gemm.product(x, entries)
    code = np.argmin(gap, axis=1)
    return code, exact_gemm.squares(x) + gap[np.arange(len(x)), code]


def entry_sums(x: np.ndarray, code: np.ndarray, n_entries: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of the rows of each entry, exact."""
    order = np.argsort(code, kind="stable")
    counts = np.bincount(code, minlength=n_entries)
    wide = x[order] if len(x) * exact_gemm.largest(x) < 1 << 62 else x[order].astype(object)
    sums = np.zeros((n_entries, x.shape[1]), wide.dtype)
    used = np.flatnonzero(counts)
    if len(used):
        sums[used] = np.add.reduceat(wide, np.cumsum(counts)[used] - counts[used], axis=0)
    return sums, counts


class Codebooks:
    """Entries of every part position: a list of int64 matrices (entries x width)."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books

    @property
    def parts(self) -> int:
        return len(self.books)

    def part(self, x: np.ndarray, i: int) -> np.ndarray:
        w = self.books[i].shape[1]
        return np.ascontiguousarray(x[:, i * w : (i + 1) * w])

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.ravel().tolist()).encode()).hexdigest()


def prepared(rows: DataFrame, vector: str, scale: int, parts: int, **keep: str) -> tuple[DataFrame, int]:
    """Integer vectors of equal width, written once, and that width (a multiple of `parts`)."""
    ints = vectors.integers(rows, vector, scale, **keep)
    width = -(-vectors.width_of(ints) // parts) * parts
    return common.spill(ints.withColumn("v", vectors.padded(F.col("v"), width)), "vectors"), width


def first_books(ints: DataFrame, width: int, parts: int, entries: int) -> Codebooks:
    rows = ints.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()  # as many rows as a codebook has entries
    x = np.array([r.v for r in rows], np.int64).reshape(len(rows), width)
    w = width // parts
    return Codebooks([x[:, i * w : (i + 1) * w].copy() for i in range(parts)])


def improved(ints: DataFrame, books: Codebooks, width: int) -> Codebooks:
    """One round: every part joins its nearest entry, entries become floored means. One shuffle of a row per task, entry and component."""

    def partial(batches):
        import pyarrow as pa

        total = None
        for batch in batches:
            x = vectors.matrix(batch.column(0), width)
            got = []
            for i, book in enumerate(books.books):
                own = books.part(x, i)
                got.append(entry_sums(own, nearest(own, book)[0], len(book)))
            total = got if total is None else [(a.astype(object) + c.astype(object), b + d) for (a, b), (c, d) in zip(total, got, strict=True)]
        out = [(i, e, at, int(v), int(n)) for i, (sums, counts) in enumerate(total or []) for e, n in enumerate(counts) if n for at, v in enumerate(sums[e])]
        part, entry, at, value, n = zip(*out, strict=True) if out else ((),) * 5
        from decimal import Decimal

        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(at, pa.int32()), pa.array([Decimal(v) for v in value], pa.decimal128(38, 0)), pa.array(n, pa.int64())], names=["part", "entry", "at", "total", "n"])

    found = ints.select("v").mapInArrow(partial, SUMS).groupBy("part", "entry", "at").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n"))
    new = [b.copy() for b in books.books]
    for r in found.collect():  # parts x entries x width of a part
        new[r.part][r.entry, r.at] = int(r.total) // r.n
    return Codebooks(new)


def trained(ints: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    books = first_books(ints, width, parts, entries)
    for _ in range(rounds):
        books = improved(ints, books, width)
    return books


def encoded(ints: DataFrame, books: Codebooks, width: int, *carried: str) -> DataFrame:
    """`carried` columns, code (array of entry numbers by part) and error (squared distances summed)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = vectors.matrix(batch.column(len(carried)), width)
            found = [nearest(books.part(x, i), b) for i, b in enumerate(books.books)]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.int32)
            error = sum((e.astype(object) for _, e in found), np.zeros(len(x), object))
            code = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, codes.shape[1]), pa.int32()), pa.array(codes.ravel(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], code, pa.array([min(int(e), LONG_MAX) for e in error], pa.int64())], names=[*carried, "code", "error"])

    schema = ", ".join([*(f"`{c}` {ints.schema[c].dataType.simpleString()}" for c in carried), "code array<int>", "error long"])
    return ints.select(*carried, "v").mapInArrow(run, schema)


def decoded(codes: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """Adds `approximation`: the entries that a code names, as one vector. Codebooks are of a fixed size."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(int(v)) for v in e]) for e in b]) for b in books.books])
    return codes.withColumn("approximation", F.flatten(F.zip_with(code, entries, lambda c, b: F.get(b, c))))


def compressed(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(id, label, code, error, label_error) of every usable row, and the codebooks."""
    ints, width = prepared(rows, vector, scale, parts, id=id_col, label=label)
    books = trained(ints, width, parts, entries, rounds)
    found = common.spill(encoded(ints, books, width, "id", "label"), "vector-codes")
    totals = found.groupBy(F.col("label").alias("of")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long").alias("label_error"))
    totals = common.spill(totals, "label-errors")  # its size is known when the join is planned
    return found.join(totals, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return rows.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _oracle() -> str:
    """Assignment and update, written out for each round."""
    least = "SELECT vec_id, part, x, entry, d FROM (SELECT p.vec_id, p.part, p.x, c.entry, list_sum(list_transform(list_zip(p.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts p JOIN b{k} c USING (part)) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1"
    mean = "SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY pos) AS c FROM (SELECT part, entry, pos, sum(v)::DOUBLE AS s, count(*)::DOUBLE AS n FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS pos FROM a{k}) GROUP BY 1, 2, 3) GROUP BY 1, 2) m USING (part, entry)"
    steps = [
        "ok AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS MATERIALIZED (SELECT vec_id, i AS part, v[i * len(v) // 8 + 1 : (i + 1) * len(v) // 8] AS x FROM ok CROSS JOIN (SELECT unnest(range(8)) AS i))",
        "b0 AS MATERIALIZED (SELECT p.part, f.entry, p.x AS c FROM parts p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM ok ORDER BY vec_id LIMIT 16) f USING (vec_id))",
    ]
    for k in range(ROUNDS):
        steps += [f"a{k} AS MATERIALIZED ({least.format(k=k)})", f"b{k + 1} AS MATERIALIZED ({mean.format(k=k)})"]
    steps += [
        f"a{ROUNDS} AS MATERIALIZED ({least.format(k=ROUNDS)})",
        f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})",
        f"e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY 1)",
    ]
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN ok USING (vec_id) CROSS JOIN h"


ORACLE = _oracle()

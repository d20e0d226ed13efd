"""Best-fit packing of token pieces into sequences, in bulk-synchronous sweeps.

Pieces are range-sorted by size, largest first, so a piece's rank within its size is its place in its range plus the counts of
the ranges before: no task sees a whole size, and a size with a third of all pieces lies over many ranges. Sizes
are whole numbers up to the sequence length L, so the sorted order of pieces and gaps is fully told by counts per
size: at most L rows, whatever the corpus. Each sweep takes the next size class of pieces (largest first) and
matches it with its successor among the gaps, the smallest gap that holds it: each gap of that size takes as many pieces
as it holds, the pieces of lowest rank first, so two pieces never get the same place. Gaps are updated and the
sweep repeats until the class is placed; what fits nowhere opens new sequences. This gives the same packing as
best-fit decreasing one piece at a time. The sweeps work on these counts, on the driver; sorting, ranking and placing
the rows is distributed.

Edge cases: null and empty texts are pieces of the end id alone. Documents longer than L are cut into
pieces of L and a rest. Repeated rows are packed each. An empty table gives an empty result. Other columns
of the input are ignored.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, token_cache

LENGTH, END_ID = 2048, 0


def token_pieces(docs: DataFrame, path: str, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """Row per piece: doc_id, piece, start, length, ids_crc32."""
    rows = docs.select("doc_id", common.text_or_empty().alias("text"))

    def cut(batches):
        encoder, end = token_cache.library_encoder(path), token_cache.u32([end_id])
        for batch in batches:
            doc, piece, start, size, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = encoder.ids(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    doc.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, size, crc)]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit_plan(counts: dict[int, int], length: int = LENGTH) -> np.ndarray:
    """Rows (size, first rank, first sequence, pieces a sequence, offset): from that rank on, pieces of that size take successive places."""
    plan: list[tuple[int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, count) with that gap
    gaps: list[int] = []  # sorted sizes that have runs
    sequences = 0

    def put(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in runs:
                bisect.insort(gaps, gap)
            runs.setdefault(gap, []).append((first, count))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect.bisect_left(gaps, size)
            if at < len(gaps):
                gap = gaps[at]
                first, count = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
                each = min(gap // size, left)  # a gap that took a piece is the tightest for the next one while it fits
                filled = min(count, left // each)
                took = filled * each
                plan.append((size, rank, first, each, length - gap))
                put(gap, first + filled, count - filled)
                put(gap - each * size, first, filled)
            else:
                fit = length // size
                took = min(left, max(1, left // fit) * fit)  # whole sequences of this size, or one that isn't full
                each = min(fit, took)
                plan.append((size, rank, sequences, each, 0))
                put(length - each * size, sequences, took // each)
                sequences += took // each
            rank, left = rank + took, left - took
    return np.array(sorted(plan), np.int64).reshape(-1, 5)


def range_sorted(pieces: DataFrame, tie: list[str]) -> DataFrame:
    """The pieces as a written table, sorted by size over ranges, with `place`: range << 33 plus place in it.

    Rows that tie in everything are told apart by their place in the input, so no range is larger than the others.
    """
    keyed = pieces.withColumn("__place", F.monotonically_increasing_id())
    order = [F.desc("length"), *[F.col(c) for c in tie], F.col("__place")]
    ranges = keyed.repartitionByRange(common.shuffle_partitions(pieces.sparkSession), *order).sortWithinPartitions(*order)
    return common.spill(ranges.withColumn("__place", F.monotonically_increasing_id()), "sorted")


def pack(pieces: DataFrame, length: int = LENGTH, tie: list[str] | None = None) -> DataFrame:
    """Adds sequence_id and offset to rows with a `length` from 1 to `length`. Reads `pieces` twice: give a written table."""
    tie = tie or [c for c in pieces.columns if c != "length"]
    spark, names = pieces.sparkSession, pieces.columns
    rows = range_sorted(pieces, tie).select(*names, "__place")
    runs = rows.groupBy(F.shiftright("__place", 33).alias("range"), "length").agg(F.min("__place").alias("first"), F.count(F.lit(1)).alias("n"))
    runs = sorted(runs.select("first", "length", "n").collect())  # at most `length` rows more than there are ranges, as ranges are sorted
    seen: dict[int, int] = {}
    bases = np.zeros((len(runs), 2), np.int64)
    for k, (first, size, n) in enumerate(runs):
        bases[k] = first, first - seen.get(size, 0)  # a rank is the place less this
        seen[size] = seen.get(size, 0) + n
    plan = spark.sparkContext.broadcast((bases, best_fit_plan(seen, length)))
    schema = rows.select(*names).schema.add("sequence_id", "long").add("offset", "long")

    def place(batches):
        starts, p = plan.value
        keys = (p[:, 0] << 44) + p[:, 1]
        for batch in batches:
            size, at = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "__place"))
            rank = at - starts[np.searchsorted(starts[:, 0], at, "right") - 1, 1] if len(at) else at
            put = p[np.searchsorted(keys, (size << 44) + rank, "right") - 1] if len(at) else p[:0]
            nth = rank - put[:, 1]
            seq, offset = put[:, 2] + nth // np.maximum(put[:, 3], 1), put[:, 4] + nth % np.maximum(put[:, 3], 1) * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(seq), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return rows.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    pieces = common.spill(token_pieces(docs, path, end_id, length), "pieces")
    return pack(pieces, length, ["doc_id", "piece", "ids_crc32"])


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.documents(spark, sf_dir), token_cache.tokenizer_path("word_bpe_49k.json"))

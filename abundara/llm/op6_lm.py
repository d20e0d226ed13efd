"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of order 0 (uniform), 1, 2 and 3 are mixed with weights that depend on how often
the context was seen (buckets of the counts of both contexts). Expectation-maximisation learns the weights
on deleted counts: every training token is held out in turn, so its own occurrence is taken from each count
that predicts it.

The n-gram counts grow with the corpus and are never in one place. Each task numbers the words of its
documents into blocks of bounded size, writes a block to the shared folder, and asks for its distinct
n-grams once a block (map-side combining), as sorted hashes cut by hash range. The task of a
range adds up the counts of all blocks and answers each block in the block's own order, so the answer
needs no keys. Each block then has the corpus counts of its n-grams in memory, and two passes over
blocks and answers follow: sums for the weights, then scores. A frequent n-gram is one row per block,
whatever its number of occurrences.

Words are told apart by 64-bit hashes, longer n-grams by 56 bits. Counts are whole numbers of up to 53 bits, each list written
in the fewest bytes that hold its greatest. Weight sums are kept by cell (context buckets and octaves of the
estimates), a table of bounded size.

A block's name is made of its partition, its place there and a digest of its documents, and a block that is there already
isn't written again: a task that is repeated after a lost executor gives the same names and bytes, so answers for either
attempt stand for both. This needs input whose partitions read alike when repeated, as a written table does.
The number of hash ranges follows the bytes of the input (RANGE_BYTES), so a range's group doesn't grow with the corpus; a
block asks at most one row per range and order, so larger corpora want larger blocks (`block_bytes`), as memory allows.

Edge cases: null and empty texts have the end token alone. Words of any length count as they are. Repeated
rows are scored alike. An empty table, or one without training documents, gives uniform scores. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FOLDS, ORDER = 10, 3
#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Hash ranges for each shuffle partition, and bytes of input files for a range where that gives more ranges.
RANGES, RANGE_BYTES = 4, 64 << 20
HASH_BITS = (64, 56, 56)
CONTEXT_CAPS = (12, 8)  # greatest bucket of one-word and two-word contexts
OCTAVES = 24
EM_ROUNDS = 60
END = np.uint64(0x656E645F6F665F74)
_codec = lambda: pa.Codec("zstd", 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def squeezed(a: np.ndarray) -> bytes:
    """Whole numbers from 0 as compressed bytes: the fewest that hold the greatest, the bytes of one weight together."""
    a = a.astype(np.min_scalar_type(int(a.max()))) if len(a) else a
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()
    return len(a).to_bytes(8, "little") + bytes([a.itemsize]) + (_codec().compress(raw, asbytes=True) if raw else b"")


def unsqueezed(data: bytes) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), data[8]
    kind = np.dtype(f"u{size}")
    if not n:
        return np.zeros(0, kind)
    raw = _codec().decompress(data[9:], n * size, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(kind)


class Block:
    """Documents as word numbers; number 0 is the end of a text, which also stands before its first word."""

    def __init__(self, docs: pa.Table, hashes: np.ndarray, ids: np.ndarray):
        self.docs, self.hashes, self.ids = docs, hashes, ids.astype(np.int32)
        self.lengths = docs.column("n_tokens").to_numpy().astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        first = np.zeros(len(ids), bool)
        first[np.cumsum(self.lengths) - self.lengths] = True
        self.train = docs.column("train").to_numpy(zero_copy_only=False)[self.doc]
        # a text's first token has no two-word context
        self.has_two = ~first
        words = np.int64(len(hashes))
        self.before = np.where(first, 0, np.concatenate(([0], self.ids[:-1]))).astype(np.int32)
        # n-grams by order: hash of each distinct one, and which one ends at each token
        pairs, pair = np.unique(self.before * words + self.ids, return_inverse=True)
        pair = pair.astype(np.int32)
        with np.errstate(over="ignore"):
            pair_hash = mixed(hashes[pairs // words] * np.uint64(0x9E3779B97F4A7C15) + hashes[pairs % words])
            del pairs
            self.before_pair = np.where(first, 0, np.concatenate(([0], pair[:-1]))).astype(np.int32)
            triples, triple = np.unique((self.before_pair * words + self.ids)[self.has_two], return_inverse=True)
            triple_hash = mixed(mixed(pair_hash[triples // words] * np.uint64(0xD6E8FEB86659FD93)) + hashes[triples % words])
        self.grams = [(hashes, self.ids), (pair_hash >> np.uint64(8), pair), (triple_hash >> np.uint64(8), triple.astype(np.int32))]

    def order(self, k: int) -> np.ndarray:
        return np.argsort(self.grams[k][0], kind="stable")

    def train_counts(self, k: int) -> np.ndarray:
        train = self.train if k < 2 else self.train[self.has_two]
        return np.bincount(self.grams[k][1], train, len(self.grams[k][0])).astype(np.uint64)

    def save(self, folder: str, place: str) -> str:
        """Writes the block unless it is there; its name."""
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.docs.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(self.docs)
        parts = [sink.getvalue().to_pybytes(), self.hashes.tobytes(), squeezed(self.ids)]
        digest = hashlib.blake2b(digest_size=16)
        for x in parts:
            digest.update(x)
        name = f"{place}-{digest.hexdigest()}"
        files, path = common.file_system(f"{folder}/{name}.arrow")
        if files.get_file_info(path).type == fs.FileType.NotFound:
            draft = f"{path}.{uuid.uuid4().hex}"
            row = pa.table(dict(zip(("docs", "hashes", "ids"), ([x] for x in parts))), pa.schema([(c, pa.large_binary()) for c in ("docs", "hashes", "ids")]))
            with files.open_output_stream(draft) as f, pa.ipc.new_file(f, row.schema) as w:
                w.write_table(row)
            # a name appears with its whole content, and whoever comes second has the same bytes
            try:
                files.move(draft, path)
            except OSError:
                if files.get_file_info(path).type == fs.FileType.NotFound:
                    raise
        return name

    @staticmethod
    def load(uri: str) -> Block:
        files, path = common.file_system(uri)
        with files.open_input_file(path) as f:
            docs, hashes, ids = (c[0].as_py() for c in pa.ipc.open_file(f).read_all().columns)
        return Block(pa.ipc.open_stream(docs).read_all(), np.frombuffer(hashes, np.uint64), unsqueezed(ids))


def blocks_of(batches, block_bytes: int = BLOCK_BYTES):
    """Blocks from batches of (doc_id, train, text in UTF-8)."""

    def fresh():
        numbers: dict[bytes, int] = defaultdict(itertools.count(1).__next__)
        return numbers, [], [], [], []

    numbers, ids, doc_ids, train, lengths = fresh()
    size = 0

    def made() -> Block:
        hashes = np.empty(len(numbers) + 1, np.uint64)
        hashes[0] = END
        for word, i in numbers.items():
            hashes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        docs = pa.table([pa.chunked_array(doc_ids), pa.chunked_array(train), pa.array(lengths, pa.int64())], names=["doc_id", "train", "n_tokens"]).combine_chunks()
        return Block(docs, hashes, np.concatenate(ids))

    for batch in batches:
        for i in range(batch.num_rows):
            words = batch.column(2)[i].as_py()
            size += len(words)
            words = words.lower().split()
            one = np.empty(len(words) + 1, np.uint32)
            one[:-1] = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
            one[-1] = 0
            ids.append(one)
            doc_ids.append(batch.column(0).slice(i, 1))
            train.append(batch.column(1).slice(i, 1))
            lengths.append(len(one))
            if size >= block_bytes:
                yield made()
                numbers, ids, doc_ids, train, lengths = fresh()
                size = 0
    if ids:
        yield made()


def make_folder(folder: str) -> None:
    files, path = common.file_system(folder)
    files.create_dir(path, recursive=True)


def asked(batches, folder: str, partition: int, ranges: int, block_bytes: int):
    """Writes the blocks of a partition; batches of (block, part, kind, hashes, counts), a row per block, hash range and order."""
    widths = [np.uint64((1 << bits) // ranges + 1) for bits in HASH_BITS]
    for nth, block in enumerate(blocks_of(batches, block_bytes)):
        name = block.save(folder, f"{partition}-{nth}")
        out = {k: [] for k in ("block", "part", "kind", "hashes", "counts")}
        for k in range(ORDER):
            order = block.order(k)
            hashes, counts = block.grams[k][0][order], block.train_counts(k)[order]
            cuts = np.searchsorted(hashes, np.arange(1, ranges, dtype=np.uint64) * widths[k])
            for part, (h, c) in enumerate(zip(np.split(hashes, cuts), np.split(counts, cuts))):
                if len(h):
                    out["block"].append(name)
                    out["part"].append(part)
                    out["kind"].append(k)
                    out["hashes"].append(squeezed(np.diff(h, prepend=np.uint64(0))))
                    out["counts"].append(squeezed(c))
        yield pa.RecordBatch.from_arrays([pa.array(out["block"]), pa.array(out["part"], pa.int32()), pa.array(out["kind"], pa.int32()), pa.array(out["hashes"], pa.binary()), pa.array(out["counts"], pa.binary())], names=list(out))


def answers(table: pa.Table) -> pa.Table:
    """Adds up one range's counts: (block, part, kind, counts, words, tokens); the row without block has the range's words."""
    out = []
    for k in range(ORDER):
        mine = table.filter(pc.equal(table.column("kind"), k)).to_pylist()
        if not mine:
            continue
        hashes = [np.cumsum(unsqueezed(r["hashes"]), dtype=np.uint64) for r in mine]
        counts = np.concatenate([unsqueezed(r["counts"]) for r in mine])
        _, which = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(which, counts)  # exact up to 2^53
        for r, found in zip(mine, np.split(total[which].astype(np.uint64), np.cumsum([len(h) for h in hashes])[:-1])):
            out.append((r["block"], r["part"], k, squeezed(found), 0, 0))
        if k == 0:
            out.append((None, mine[0]["part"], 0, None, int((total > 0).sum()), int(total.sum())))
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()))], names=["block", "part", "kind", "counts", "words", "tokens"])


def corpus_counts(docs: DataFrame, text_col: str = "text", block_bytes: int | None = None) -> tuple[DataFrame, str]:
    """Answers for every block and hash range, and the folder of the blocks."""
    ranges = max(RANGES * common.shuffle_partitions(docs.sparkSession), (common.input_bytes(docs) or 0) // RANGE_BYTES)
    folder, size = common.new_folder(docs.sparkSession, "lm-blocks"), block_bytes or BLOCK_BYTES
    make_folder(folder)
    rows = docs.select("doc_id", (common.fold(F.col("doc_id"), FOLDS) != 0).alias("train"), common.text_or_empty(text_col).cast("binary").alias("data"))
    asks = rows.mapInArrow(lambda batches: asked(batches, folder, TaskContext.get().partitionId(), ranges, size), "block string, part int, kind int, hashes binary, counts binary")
    return common.spill(asks.groupBy("part").applyInArrow(answers, "block string, part int, kind int, counts binary, words long, tokens long"), "lm-counts"), folder


def answered(table: pa.Table, folder: str) -> tuple[Block, list[np.ndarray]]:
    """A block, and the corpus count of each of its distinct n-grams by order."""
    block = Block.load(f"{folder}/{table.column('block')[0].as_py()}.arrow")
    counts = []
    for k in range(ORDER):
        mine = table.filter(pc.equal(table.column("kind"), k)).sort_by("part")
        found = np.concatenate([unsqueezed(x.as_py()) for x in mine.column("counts")]) if len(mine) else np.zeros(0)
        by_gram = np.empty(len(found), np.int64)
        by_gram[block.order(k)] = found
        counts.append(by_gram)
    return block, counts


def estimates(block: Block, counts: list[np.ndarray], words: int, tokens: int, deleted: bool) -> tuple[np.ndarray, np.ndarray]:
    """(context bucket, estimates of order 0 to 3) for every token; deleted: without the token's own occurrence."""
    less = block.train.astype(np.int64) if deleted else 0
    one, pair = counts[0][block.ids] - less, counts[1][block.grams[1][1]] - less
    triple = np.zeros(len(block.ids), np.int64)
    triple[block.has_two] = counts[2][block.grams[2][1]]
    triple = np.where(block.has_two, triple - less, 0)
    context1 = counts[0][block.before] - less
    context2 = np.where(block.has_two, counts[1][block.before_pair] - less, 0)
    p = np.zeros((4, len(block.ids)))
    p[0] = 1 / (words + 1)
    p[1] = one / max(tokens - int(deleted), 1)
    np.divide(pair, context1, out=p[2], where=context1 > 0)
    np.divide(triple, context2, out=p[3], where=context2 > 0)
    b1, b2 = (np.minimum(np.ceil(np.log2(np.maximum(c, 0) + 1)).astype(int), cap) for c, cap in zip((context1, context2), CONTEXT_CAPS))
    return b1 * (CONTEXT_CAPS[1] + 1) + b2, np.maximum(p, 0)


BUCKETS = (CONTEXT_CAPS[0] + 1) * (CONTEXT_CAPS[1] + 1)


def mixture_weights(cells: list[tuple], rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights (bucket, order) from cells (bucket, tokens, mean estimates relative to order 0) by expectation-maximisation.

    An order whose context was never seen gets no weight; a small share of every bucket stays with order 0, so
    no text has probability zero.
    """
    seen = np.ones((BUCKETS, 4))
    b = np.arange(BUCKETS)
    seen[b // (CONTEXT_CAPS[1] + 1) == 0, 2] = 0
    seen[b % (CONTEXT_CAPS[1] + 1) == 0, 3] = 0
    weights = seen / seen.sum(1, keepdims=True)
    if cells:
        bucket, n, p = np.array([c[0] for c in cells]), np.array([c[1] for c in cells], float), np.array([c[2:] for c in cells], float)
        for _ in range(rounds):
            part = weights[bucket] * p
            part *= (n / part.sum(1))[:, None]
            new = seen.copy() * 0.5
            np.add.at(new, bucket, part)
            weights = new * seen / (new * seen).sum(1, keepdims=True)
    weights[:, 0] = np.maximum(weights[:, 0], 1e-6)
    return weights / weights.sum(1, keepdims=True)


def learned(counts: DataFrame, folder: str, words: int, tokens: int) -> np.ndarray:
    def cells(table: pa.Table) -> pa.Table:
        block, found = answered(table, folder)
        bucket, p = estimates(block, found, words, tokens, True)
        bucket, p = bucket[block.train], p[:, block.train] * (words + 1)
        octave = np.clip(np.ceil(np.log2(np.maximum(p[1:], 2.0**-OCTAVES))).astype(int) + 1, 0, OCTAVES)
        octave[p[1:] == 0] = 0
        code = ((bucket * (OCTAVES + 1) + octave[0]) * (OCTAVES + 1) + octave[1]) * (OCTAVES + 1) + octave[2]
        kinds, which = np.unique(code, return_inverse=True)
        sums = [np.bincount(which, x, len(kinds)) for x in (np.ones(len(code)), *p)]
        return pa.table([pa.array(kinds // (OCTAVES + 1) ** 3, pa.int32()), pa.array(kinds, pa.int64()), *[pa.array(s) for s in sums]], names=["bucket", "cell", "n", "p0", "p1", "p2", "p3"])

    rows = counts.filter("block is not null").groupBy("block").applyInArrow(cells, "bucket int, cell long, n double, p0 double, p1 double, p2 double, p3 double")
    found = rows.groupBy("cell").agg(F.first("bucket").alias("bucket"), *[F.sum(c).alias(c) for c in ("n", "p0", "p1", "p2", "p3")]).collect()  # a bounded number of cells
    return mixture_weights([(r.bucket, r.n, *(r[f"p{k}"] / r.n for k in range(4))) for r in sorted(found, key=lambda r: r.cell)])


def scores(docs: DataFrame, text_col: str = "text", block_bytes: int | None = None) -> DataFrame:
    """Row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    counts, folder = corpus_counts(docs, text_col, block_bytes)
    words, tokens = counts.filter("block is null").agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    weights = learned(counts, folder, words, tokens)

    def score(table: pa.Table) -> pa.Table:
        block, found = answered(table, folder)
        bucket, p = estimates(block, found, words, tokens, False)
        mix = np.zeros(len(bucket))
        for k in range(4):
            mix += weights[bucket, k] * p[k]
        per = lambda x: np.bincount(block.doc, x, len(block.lengths))
        c = found[0][block.ids]
        base = per(np.log10((c + 0.1) / (tokens + 0.1 * (words + 1))))
        d = block.docs
        return pa.table([d.column("doc_id"), pc.invert(d.column("train")), d.column("n_tokens"), pa.array(per(c > 0).astype(np.int64)), pa.array(np.full(len(d), tokens)), pa.array(base), pa.array(per(np.log10(mix)))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return counts.filter("block is not null").groupBy("block").applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(common.documents(spark, sf_dir))

"""Token ids in Arrow files with fixed-size-list batches.

Documents are range-partitioned and sorted by id; each task encodes its range, appends an end id to each
document, and writes the stream of ids as rows of `sequence_length` ids with a mask of the same length
(a bit for each id, 0 in the padding of a shard's last row; eight to a byte, the lowest bit first, so a row's mask
is a list of whole bytes). Every record batch but the last holds ROWS_PER_BATCH rows, so row i is row
i % ROWS_PER_BATCH of batch i // ROWS_PER_BATCH: with a memory map, the ids of any row and the bits of its
mask are views of the file; only unpacking the bits copies them. Ids take 16 bits if the vocabulary allows it. A second small Arrow file
beside each shard has the place of each document. Tasks write under a new name and tell it in their
result, so a repeated or speculative attempt never meets another's file.

Edge cases: null and empty texts are documents of the end id alone. Equal ids keep their own rows, in
order of the text's hash. Texts longer than a sequence, or than a shard, go on in the following rows.
An empty table writes no shard and gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, token_cache

SEQUENCE_LENGTH, ROWS_PER_BATCH, END_ID = 2048, 64, 2
#: Bytes of input files for a shard, where that gives more shards than shuffle partitions.
SHARD_BYTES = 256 << 20


def mask_bytes(length: int) -> int:
    return -(-length // 8)


def id_type(vocabulary: int) -> pa.DataType:
    return pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()


class ShardWriter:
    """Writes a stream of ids as fixed-size rows."""

    def __init__(self, sink, kind: pa.DataType, length: int):
        self.kind, self.length, self.held, self.size = kind, length, [], 0
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.uint8(), mask_bytes(length)))])
        self.writer = pa.ipc.new_file(sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind.to_pandas_dtype()))
        self.size += len(ids)
        if self.size >= self.length * ROWS_PER_BATCH:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.kind.to_pandas_dtype())
        step = self.length * ROWS_PER_BATCH
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            self.put(ids[at : at + step], step)
        rest = ids[whole:]
        if last and len(rest):
            n = len(rest)
            self.put(np.concatenate([rest, np.zeros(-n % self.length, ids.dtype)]), n)
            rest = rest[:0]
        self.held, self.size = [rest], len(rest)

    def put(self, ids: np.ndarray, n: int) -> None:
        mask = np.packbits((np.arange(len(ids)) < n).reshape(-1, self.length), axis=1, bitorder="little").reshape(-1)
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), size) for x, size in ((ids, self.length), (mask, mask_bytes(self.length)))]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        self.flush(True)
        self.writer.close()


class TokenFile:
    """Random access to the sequences and documents of one shard; views of the map where the file is local."""

    def __init__(self, uri: str):
        from pyarrow import fs

        system, path = common.file_system(uri)
        local = isinstance(system, fs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(path) if local else system.open_input_file(path))
        self.length = self.reader.schema.field("ids").type.list_size
        with system.open_input_file(path + ".docs") as f:
            self.docs = pa.ipc.open_file(f).read_all()

    def batch(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        b = self.reader.get_batch(k)
        return b.column(0).values.to_numpy(zero_copy_only=True), b.column(1).values.to_numpy(zero_copy_only=True)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of row i, a view, and its mask as a byte for each id, unpacked from its bits."""
        at = i % ROWS_PER_BATCH * self.length
        return self.batch(i // ROWS_PER_BATCH)[0][at : at + self.length], np.unpackbits(self.packed_mask(i), count=self.length, bitorder="little")

    def packed_mask(self, i: int) -> np.ndarray:
        """The bits of row i's mask, a view."""
        width = mask_bytes(self.length)
        at = i % ROWS_PER_BATCH * width
        return self.batch(i // ROWS_PER_BATCH)[1][at : at + width]

    def stream(self, start: int, n: int) -> np.ndarray:
        """n ids from place `start` of the shard."""
        step, out = self.length * ROWS_PER_BATCH, []
        while n > 0:
            ids = self.batch(start // step)[0][start % step :][:n]
            out.append(ids)
            start, n = start + len(ids), n - len(ids)
        return out[0] if len(out) == 1 else np.concatenate(out or [np.zeros(0, np.uint16)])

    def document(self, i: int) -> tuple[int, np.ndarray]:
        row = self.docs.slice(i, 1).to_pylist()[0]
        return row["doc_id"], self.stream(row["start"], row["n_tokens"])


def write_token_files(docs: DataFrame, folder: str, path: str, vocabulary: int, end_id: int = END_ID, length: int = SEQUENCE_LENGTH, partitions: int | None = None) -> list[dict]:
    """Manifest of the shards in order: uri, first id in all shards, tokens, docs. One entry per task, not per document."""
    kind, session = id_type(max(vocabulary, end_id + 1)), docs.sparkSession
    system, where = common.file_system(folder)
    system.create_dir(where, recursive=True)
    rows = docs.select("doc_id", common.text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    partitions = partitions or max(common.shuffle_partitions(session), (common.input_bytes(docs) or 0) // SHARD_BYTES)
    rows = rows.repartitionByRange(partitions, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def write(batches):
        encoder, writer, ids_of, starts, counts, at = token_cache.library_encoder(path), None, [], [], [], 0
        name = f"{folder}/shard-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.arrow"
        files, target = common.file_system(name)
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                sink = files.open_output_stream(target)
                writer = ShardWriter(sink, kind, length)
            ids_of.append(batch.column(0))
            for text in batch.column(1):
                ids = np.frombuffer(encoder.ids(text.as_py()) + token_cache.u32([end_id]), "<u4")
                writer.add(ids)
                starts.append(at)
                counts.append(len(ids))
                at += len(ids)
        if writer is None:
            return
        writer.close()
        sink.close()
        index = pa.table([pa.chunked_array(ids_of), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], names=["doc_id", "start", "n_tokens"])
        with files.open_output_stream(target + ".docs") as f, pa.ipc.new_file(f, index.schema) as w:
            w.write_table(index)
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "uri": [name], "tokens": [at], "docs": [len(counts)]})

    shards = sorted((r.asDict() for r in rows.mapInArrow(write, "part long, uri string, tokens long, docs long").collect()), key=lambda r: r["part"])
    first = 0
    for s in shards:
        s["first"] = first
        first += s["tokens"]
    return shards


def read_token_files(spark: SparkSession, shards: list[dict], id_type: str = "bigint") -> DataFrame:
    """Row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    schema = f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(s["uri"], s["first"]) for s in shards], "uri string, first long").repartition(len(shards), "uri")

    def read(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                file = TokenFile(shard["uri"])
                for part in file.docs.to_batches(10_000):
                    starts, counts = part.column(1).to_numpy(), part.column(2).to_numpy()
                    crc = [zlib.crc32(file.stream(s, n).astype("<u4").tobytes()) for s, n in zip(starts.tolist(), counts.tolist())]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(starts + shard["first"], pa.int64()), part.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(read, schema)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    shards = write_token_files(docs, common.new_folder(spark, "token-files"), token_cache.tokenizer_path("byte_bpe_50k.json"), vocabulary=50_257)
    return read_token_files(spark, shards, docs.schema["doc_id"].dataType.simpleString())

"""Byte-level BPE by per-prefix dynamic programming.

The encoding of a prefix of a pre-token ends with exactly one token. An automaton over the vocabulary
lists the tokens that end at each position; one of them is the last token of that prefix if it may stand
beside the last token of the prefix before it. Two tokens may stand side by side if no merge across
their border would have come before the merges that built them. Following the stored tokens back from
the end gives the ids. Decoding joins the bytes of the tokens.

Edge cases: null and empty texts have no ids, n_tokens 0 and the digests of the empty string. Texts of any
length are encoded whole, piece by piece. Repeated rows give repeated results. An empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, token_cache

#: Remembered pairs of neighbours, per worker.
MOST_PAIRS = 1_000_000
FOREVER = 1 << 60


class Bpe:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pre_tokens = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        #: id -> (rank, left id, right id) of the merge that builds it; -1 for single bytes.
        self.built = {i: (-1, i, i) for i in vocab.values()}
        self.rank: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            left, right = vocab[a], vocab[b]
            self.rank[left, right] = r
            self.built[vocab[a + b]] = (r, left, right)
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()
        byte_of = {c: b for b, c in token_cache.BYTE_CHARS.items()}
        tokens = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.bytes = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.digits = [str(i) for i in range(len(self.bytes))]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = token_cache.SpacedEncoder(self.word, self.whole)

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b side by side; undoes their merges, the latest first."""
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        key, ends_a, ends_b, ok = (a, b), FOREVER, FOREVER, True
        while True:
            across = self.rank.get((a, b), FOREVER)
            # a and b stood side by side until the earlier of their own merges; of equal merges the left one comes first
            if across < ends_a and across <= ends_b and across != FOREVER:
                ok = False
                break
            (rank_a, _, right), (rank_b, left, _) = self.built[a], self.built[b]
            if rank_a > rank_b:
                ends_a, a = rank_a, right
            elif rank_b >= 0:
                ends_b, b = rank_b, left
            else:
                break
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def word(self, chars: str) -> list[int]:
        """Ids of one pre-token, given in byte characters."""
        n = len(chars)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        for end, (length, token) in self.automaton.iter(chars):
            start, stop = end + 1 - length, end + 1
            if last[stop] < 0 and (start == 0 or last[start] >= 0 and self.fits(last[start], token)):
                last[stop], size[stop] = token, length
        out = []
        while n:
            out.append(last[n])
            n -= size[n]
        return out[::-1]

    def whole(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.at_special.split(text) if self.at_special else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                for pre in self.pre_tokens.findall(part):
                    out += self.word(token_cache.byte_chars(pre))
        return out

    def encode(self, text: str) -> memoryview:
        return memoryview(self.pieces.ids(text)).cast("I")

    def decode(self, ids) -> str:
        """Bytes that aren't UTF-8 become U+FFFD, as in the library."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_made: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    if path not in _made:
        _made[path] = Bpe(path)
    return _made[path]


def encode_column(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row per input row: id, ids (array of int)."""
    rows = docs.select(F.col(id_col).alias("id"), common.text_or_empty(text_col).alias("text"))

    def run(batches):
        tool = bpe(path)
        for batch in batches:
            ids = [tool.encode(t.as_py()).tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode_column(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """Adds `decoded` to a frame with a column of ids."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def run(ids):
        import pandas as pd

        return pd.Series([None if x is None else bpe(path).decode(list(x)) for x in ids])

    return encoded.withColumn("decoded", run(F.col(ids_col)))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of ids and of decoded texts, without shipping either out of the task."""
    rows = docs.select("doc_id", common.text_or_empty().alias("text"))

    def run(batches):
        tool = bpe(path)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for text in batch.column(1):
                ids = tool.encode(text.as_py())
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(tool.digits.__getitem__, ids)).encode()).hexdigest())
                text_hash.append(hashlib.sha256(tool.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.documents(spark, sf_dir), token_cache.tokenizer_path("byte_bpe_50k.json"))

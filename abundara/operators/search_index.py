"""A kept inverted index with block bounds, and BM25 searches that read only what can reach the k best.

The index is written once for a corpus and found again by the plan and the files it was built from. Tasks gather documents into shards, sorted by key; a row
for each shard and token has its postings as arrays, and for each run of BLOCK documents the greatest term frequency and the least length, from which the greatest
contribution follows for any statistics. Topics are lists of their own, so a bonus for a topic and a search within one use the
same postings. A search joins the queries' tokens with the index, and each shard's lists meet in one task. There, lists that together
can't lift a document over the k-th score don't bring candidates, blocks that can't either are passed over, and the k best of the shards meet at the end.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..sources import sinks

#: Documents in a block, documents and characters in a shard, bytes of input in a task, queries that a task takes on at once.
BLOCK, SHARD_DOCS, SHARD_CHARS, TASK_BYTES, QUERY_BLOCK = 512, 16_384, 8 << 20, 1 << 20, 1024
#: Scores that differ by less count as equal, so bounds are widened by twice as much.
DIGITS, SLACK = 9, 2e-9
#: Begins the names of topic lists; no token has it.
TOPIC = "\x00topic "
FIND, STOP = re.compile(T.TOKEN_PATTERN).findall, frozenset(T.STOP_WORDS)


def text_tokens(text: str | None) -> list[str]:
    """T.tokens for one text."""
    return [t for t in FIND((text or "").lower()) if len(t) > 1 and t not in STOP]


# --- building ----------------------------------------------------------------------


@dataclass(frozen=True)
class Index:
    """A written index: its table, the number of documents with a token, and their mean length (to six digits)."""

    table: DataFrame
    key: str
    n_docs: int
    avgdl: float

    def document_frequency(self) -> DataFrame:
        lists = self.table.filter(F.col("token").isNotNull() & ~F.startswith("token", F.lit(TOPIC)))
        return lists.groupBy("token").agg(F.sum(F.size("places")).alias("df"))


def shard_rows(name: str, keys, texts: list, topics: list, schema):
    """Arrow batch of a shard: a row for each token and topic, and one without a token that has keys and lengths."""
    import pyarrow as pa
    import pyarrow.compute as pc

    order = pc.sort_indices(keys).to_pylist()
    numbers: dict[str, int] = {}
    found = [np.array([numbers.setdefault(t, len(numbers)) for t in text_tokens(texts[i])], np.int64) for i in order]
    lengths = np.array([len(f) for f in found], np.int64)
    n, named = len(order), [(topics[i] or "").lower() for i in order]
    marks = np.array([numbers.setdefault(TOPIC + x, len(numbers)) if x else -1 for x in named], np.int64)
    doc = np.concatenate([np.repeat(np.arange(n), lengths), np.flatnonzero(marks >= 0)])
    token = np.concatenate([*found, marks[marks >= 0]]) if n else np.zeros(0, np.int64)
    cell, tf = np.unique(token * n + doc, return_counts=True)
    token, doc = cell // n, cell % n
    per_token = np.bincount(token, minlength=len(numbers))
    run = token * (n // BLOCK + 1) + doc // BLOCK
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
    per_run = np.bincount(token[first], minlength=len(numbers))

    def column(values, sizes):
        offsets = np.concatenate([[0], np.cumsum(sizes), [np.sum(sizes)]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))

    most = np.maximum.reduceat(tf, first) if len(first) else tf
    least = np.minimum.reduceat(lengths[doc], first) if len(first) else lengths[:0]
    size = np.diff(np.append(first, len(doc)))
    last = pa.nulls(len(numbers), pa.list_(keys.type))
    own = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), keys.take(pa.array(order, pa.int64())))
    lens = pa.concat_arrays([pa.nulls(len(numbers), pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(lengths.astype(np.int32)))])
    columns = [pa.array([name] * (len(numbers) + 1)), pa.array([*numbers, None], pa.string()), column(doc, per_token), column(tf, per_token), column((doc // BLOCK)[first], per_run), column(size, per_run), column(most, per_run), column(least, per_run), pa.concat_arrays([last, own]), lens]
    return pa.RecordBatch.from_arrays(columns, names=schema)


COLUMNS = ["shard", "token", "places", "tfs", "blocks", "sizes", "most_tf", "least_length", "keys", "lengths"]


def built(docs: DataFrame, key: str, text: str = "text", topic: str | None = None) -> Index:
    """Writes the index of (key, text and, if given, topic). Documents without a token are no part of the statistics."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), (F.col(topic) if topic else F.lit(None)).cast("string").alias("topic"))
    kind = rows.schema["key"].dataType.simpleString()
    execution = rows._jdf.queryExecution()
    size = int(execution.optimizedPlan().stats().sizeInBytes())
    wanted = min(math.ceil(size / TASK_BYTES), 2 * docs.sparkSession.sparkContext.defaultParallelism) if size < 1 << 60 else 1
    if execution.toRdd().getNumPartitions() < wanted:  # fewer row groups than the cluster has cores: rows are dealt out before they are read into tokens
        rows = rows.repartition(wanted)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, n, kept, docs_, chars = TaskContext.get().partitionId(), 0, [], 0, 0

        def shard():
            keys = pa.concat_arrays([b.column(0) for b in kept])
            return shard_rows(f"{task}-{n}", keys, [t for b in kept for t in b.column(1).to_pylist()], [t for b in kept for t in b.column(2).to_pylist()], COLUMNS)

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                size_ = piece.column(1).nbytes
                if kept and (docs_ + piece.num_rows > SHARD_DOCS or chars + size_ > SHARD_CHARS):
                    yield shard()
                    n, kept, docs_, chars = n + 1, [], 0, 0
                kept, docs_, chars = [*kept, piece], docs_ + piece.num_rows, chars + size_
        if kept:
            yield shard()

    ints = "array<int>"
    table = rows.mapInArrow(run, f"shard string, token string, places {ints}, tfs {ints}, blocks {ints}, sizes {ints}, most_tf {ints}, least_length {ints}, keys array<{kind}>, lengths {ints}")
    lengths = F.filter("lengths", lambda x: x > 0)
    seen = Observation()
    counted = table.observe(seen, F.sum(F.when(F.col("token").isNull(), F.size(lengths))).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)).alias("total"))
    path = sinks.scratch_folder(docs.sparkSession, "index")
    counted.write.parquet(path)
    n = max(seen.get["n"] or 0, 0)
    return Index(docs.sparkSession.read.schema(table.schema).parquet(path), key, n, round((seen.get["total"] or 0) / n, 6) if n else 0.0)


_kept: dict[tuple, tuple[str, Index]] = {}


def kept(docs: DataFrame, key: str, text: str = "text", topic: str | None = None) -> Index:
    """The index of these documents, built if this session hasn't one for the same plan over the same, unchanged files."""
    spark = docs.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda f: spark._jvm.org.apache.hadoop.fs.Path(f)
    there = lambda f: path(f).getFileSystem(conf)
    files = sorted(docs.inputFiles())
    states = [there(f).getFileStatus(path(f)) for f in files]
    mark = spark.sparkContext.applicationId, docs.semanticHash(), key, text, topic, tuple((f, s.getModificationTime(), s.getLen()) for f, s in zip(files, states, strict=True))
    if mark in _kept and there(_kept[mark][0]).exists(path(_kept[mark][0])):
        return _kept[mark][1]
    index = built(docs, key, text, topic)
    if files:  # without files nothing tells whether the rows have changed
        _kept[mark] = index.table.inputFiles()[0].rsplit("/", 1)[0], index
    return index


# --- searching ---------------------------------------------------------------------


class Lists:
    """The queries' lists in one shard."""

    def __init__(self, weights: np.ndarray, topic: np.ndarray, lists: dict, lengths: np.ndarray, avgdl: float, bonus: float):
        self.lists, self.lengths, self.weights, self.topic, self.avgdl, self.bonus = lists, lengths, weights, topic, avgdl, bonus
        self.n_blocks = len(lengths) // BLOCK + 1
        self.bound, self.at = np.zeros((len(weights), self.n_blocks)), np.zeros((2, len(weights), self.n_blocks), np.int64)
        self.blocks = self.read = 0
        for t in range(len(weights)):
            blocks, size = lists["blocks"][t], lists["sizes"][t]
            end = np.cumsum(size)
            self.bound[t, blocks] = self.points(t, lists["most_tf"][t], lists["least_length"][t])
            self.at[0, t, blocks], self.at[1, t, blocks] = end - size, end
            self.blocks += len(blocks)
        self.most = self.bound.max(axis=1, initial=0.0)

    def points(self, t: int, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.full(len(tf), self.bonus) if self.topic[t] else self.weights[t] * N.bm25_tf(tf, length, self.avgdl)

    def block(self, t: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        self.read += 1
        part = slice(*self.at[:, t, b])
        places = self.lists["places"][t][part]
        return places - b * BLOCK, self.points(t, self.lists["tfs"][t][part], self.lengths[places])

    def search(self, terms: np.ndarray, times: np.ndarray, k: int, least: float, strict: bool, allowed: np.ndarray | None, cache: dict) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents: by score to DIGITS digits, then by place."""
        order = np.argsort(self.most[terms] * times, kind="stable")
        terms, times = terms[order], times[order]
        reach, sums = np.cumsum(self.most[terms] * times), self.bound[terms].T @ times
        places, scores = np.zeros(0, np.int64), np.zeros(0)
        edge = least
        for b in np.flatnonzero(sums > 0):
            if sums[b] < edge - SLACK:
                continue
            bounds = self.bound[terms, b] * times
            essential = int(np.searchsorted(reach, edge - SLACK, "right"))
            acc = np.zeros(BLOCK)
            for i in essential + np.flatnonzero(bounds[essential:]):
                self.add(cache, terms[i], b, times[i], acc)
            rest = np.flatnonzero(bounds[:essential])
            rest = rest[np.argsort(-bounds[rest], kind="stable")]
            left = float(bounds[rest].sum())
            held = np.flatnonzero(acc)
            for i in rest:
                held = held[acc[held] + left >= edge - SLACK]
                if not len(held):
                    break
                self.add(cache, terms[i], b, times[i], acc)
                left -= float(bounds[i])
            held = held[(acc[held] > least if strict else acc[held] >= least) & (acc[held] >= edge - SLACK)]
            if allowed is not None:
                held = held[allowed[b * BLOCK + held]]
            if len(held):
                places, scores = np.concatenate([places, b * BLOCK + held]), np.concatenate([scores, acc[held]])
                top = np.lexsort((places, -np.round(scores, DIGITS)))[:k]
                places, scores = places[top], scores[top]
                edge = max(edge, float(scores[-1])) if len(scores) == k else edge
        return places, scores

    def add(self, cache: dict, t: int, b: int, times: float, acc: np.ndarray) -> None:
        if (t, b) not in cache:
            cache[t, b] = self.block(t, b)
        at, points = cache[t, b]
        acc[at] += times * points


def top_hits(queries: DataFrame, index: Index, query_key: str, k: int, text: str = "text", least: float = 0.0, strict: bool = True, only: str | None = None, bonus: float = 0.0, named: str | None = None) -> DataFrame:
    """(query, key, rank, score) of the k best documents of each query; equal scores (to nine digits) in order of key.

    `only` keeps to documents of a topic, in any case. With `bonus`, documents whose topic the column `named` of the queries mentions get it.
    """
    found, items = _found(queries, index, query_key, k, text, least, strict, only, bonus, named, False)
    w = Window.partitionBy("q").orderBy(F.desc(F.round("score", DIGITS)), "key")
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.join(items.select("q", "item"), "q").select(F.col("item").alias(query_key), F.col("key").alias(index.key), "rank", "score")


def blocks_read(queries: DataFrame, index: Index, query_key: str, k: int, text: str = "text") -> DataFrame:
    """Of the blocks of all queries' lists, how many a search unpacks: (blocks, read)."""
    found, _ = _found(queries, index, query_key, k, text, 0.0, True, None, 0.0, None, True)
    return found.agg(F.sum("key").alias("blocks"), F.sum("q").alias("read"))


def _found(queries, index: Index, query_key: str, k: int, text: str, least: float, strict: bool, only: str | None, bonus: float, named: str | None, report: bool) -> tuple[DataFrame, DataFrame]:
    words = F.transform(F.array_distinct(F.split(F.lower(F.coalesce(F.col(named), F.lit(""))), r"[^a-z0-9_-]+")), lambda x: F.concat(F.lit(TOPIC), x)) if named and bonus else F.array().cast("array<string>")
    items = sinks.written(queries.select(F.monotonically_increasing_id().alias("q"), F.col(query_key).alias("item"), F.concat(T.tokens(F.col(text)), words).alias("tokens")), "queries")
    parts = max(1, math.ceil(items.count() / QUERY_BLOCK))
    terms = items.select("q", F.explode("tokens").alias("token")).groupBy("token", "q").agg(F.count(F.lit(1)).cast("double").alias("times"))
    users = terms.groupBy(F.pmod("q", F.lit(parts)).cast("int").alias("part"), "token").agg(F.collect_list(F.struct("q", "times")).alias("users"))  # QUERY_BLOCK at most
    lists = index.table.filter(F.col("token").isNotNull())
    df = lists.join(users.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.sum(F.size("places")).alias("df"))
    idf = N.bm25_idf(F.lit(float(index.n_docs)), F.col("df").cast("double")).alias("weight")
    weighed = users.join(df.select("token", idf), "token")
    if only is not None:
        none = F.array().cast(users.schema["users"].dataType)
        weighed = weighed.unionByName(queries.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"), F.lit(TOPIC + only.lower()).alias("token"), none.alias("users"), F.lit(0.0).alias("weight")))
    weighed = sinks.written(weighed, "query-tokens")
    columns = ["part", "weight", "users", *COLUMNS]
    documents = index.table.filter(F.col("token").isNull()).withColumns({"part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), "weight": F.lit(None).cast("double"), "users": F.lit(None).cast(users.schema["users"].dataType)})
    both = lists.join(weighed, "token").select(*columns).unionByName(documents.select(*columns))
    kind = index.table.schema["keys"].dataType.elementType.simpleString()
    avgdl = index.avgdl

    def run(table):
        import pyarrow as pa

        token = table.column("token").to_pylist()
        at = token.index(None)
        keys, lengths = table.column("keys").combine_chunks().slice(at, 1).flatten(), np.array(table.column("lengths")[at].as_py(), np.int64)
        rows = [i for i in range(len(token)) if i != at]
        got = table.take(pa.array(rows, pa.int64())).combine_chunks()
        arrays = {c: [np.asarray(x.values.to_numpy(), np.int64) for x in got.column(c)] for c in ("places", "tfs", "blocks", "sizes", "most_tf", "least_length")}
        topic = np.array([token[i].startswith(TOPIC) for i in rows], bool)
        shard = Lists(np.array(got.column("weight").to_pylist(), np.float64), topic, arrays, lengths, avgdl, bonus)
        allowed = None
        if only is not None:
            allowed = np.zeros(len(lengths) + BLOCK, bool)
            for i, r in enumerate(rows):
                if token[r] == TOPIC + only.lower():
                    allowed[arrays["places"][i]] = True
        asked: dict[int, list] = {}
        for t, each in enumerate(got.column("users").to_pylist()):
            for u in each:
                asked.setdefault(u["q"], []).append((t, u["times"]))
        cache: dict = {}
        out = [(q, *shard.search(np.array([t for t, _ in ts]), np.array([n for _, n in ts]), k, least, strict, allowed, cache)) for q, ts in asked.items()]
        if report:
            return pa.table({"q": pa.array([shard.read], pa.int64()), "key": pa.array([shard.blocks], pa.int64()), "score": pa.array([0.0])})
        sizes = [len(p) for _, p, _ in out]
        places = np.concatenate([np.zeros(0, np.int64), *(p for _, p, _ in out)])
        return pa.table({"q": pa.array(np.repeat(np.array([q for q, *_ in out], np.int64), sizes)), "key": keys.take(pa.array(places)), "score": pa.array(np.concatenate([np.zeros(0), *(s for *_, s in out)]))})

    return both.groupBy("shard", "part").applyInArrow(run, f"q long, key {'long' if report else kind}, score double"), items

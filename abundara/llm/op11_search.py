"""Ranked lexical search by Block-Max MaxScore over sharded postings.

`build_index` reads the documents once. A task gathers documents up to SHARD_CHARS characters into a shard, sorts them by id, and returns a row for each
term: its document frequency and its postings in blocks, one block for each WINDOW documents that hold it. A block is variable-length bytes of (gap, tf);
beside it stands its front: the pairs (tf, terms of the document) that no other document of the block beats in both, so the block's greatest contribution is exact
for any collection statistics, known only once all shards are there. One more row holds the ids and lengths of the shard's documents.

`search` joins the index with the queries' terms, so only their postings are shuffled, to the task of their shard. There, lists are ordered by their
greatest contribution. Those whose sum can't reach the k-th score are non-essential: documents that only they hold are never looked at. Windows whose block maxima
don't reach it are skipped; in the others, candidates come from the essential blocks, and block maxima of the remaining lists
reject candidates before those blocks are unpacked. The k best of each shard meet in a window that Spark limits before the shuffle.
All numbers but the term weights are integers.

Edge cases: null and empty texts, and texts without terms, are no part of the collection and are never found. Queries without
terms have no rows; a term that a query repeats counts each time. Ties go to the smaller id, null ids last. Rows that share an id are documents of
their own, so it may be listed twice; rows that share an item id are queries of their own, each with its list. A long text is a shard of its
own and is read whole. Empty tables give no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 10
#: Characters of text in a shard, documents in a window, queries that a task takes on at once.
SHARD_CHARS, WINDOW, QUERY_BLOCK = 8 << 20, 1024, 1024
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FIND = re.compile(TERM).findall
BREAK = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]").search
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)
#: Long texts are cut into terms this many characters at a time.
PIECE = 1 << 20
INDEX = "shard string, term string, df long, total long, n_blocks int, windows binary, sizes binary, front_sizes binary, fronts binary, postings binary"


# --- building ----------------------------------------------------------------------


def pack(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Variable-length bytes (seven bits each, the last below 128), and where each value begins, plus the end."""
    v = values.astype(np.uint64)
    width = np.ones(len(v), np.int64)
    for b in range(7, 64, 7):
        more = v >= np.uint64(1 << b)
        if not more.any():
            break
        width += more
    at = np.zeros(len(v) + 1, np.int64)
    np.cumsum(width, out=at[1:])
    out = np.zeros(at[-1], np.uint8)
    for j in range(int(width.max(initial=0))):
        has = np.flatnonzero(width > j)
        out[at[has] + j] = ((v[has] >> np.uint64(7 * j)) & np.uint64(127)).astype(np.uint8) | np.where(width[has] > j + 1, 128, 0).astype(np.uint8)
    return out.tobytes(), at


def unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    last = b < 128
    if last.all():
        return b.astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], last[:-1]]))
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b))))
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), starts)


class Terms(dict):
    """term -> number; forms that differ by the case of A-Z share one."""

    def __init__(self):
        super().__init__()
        self.names = []

    def __missing__(self, form: str) -> int:
        low = form.translate(TO_LOWER)
        if low != form:
            n = self[low]
        else:
            n = len(self.names)
            self.names.append(form)
        self[form] = n
        return n


def numbers_of(text: str, terms: Terms) -> np.ndarray:
    """Numbers of the terms of a whole text, piece by piece; pieces end where no term does."""
    if len(text) <= PIECE:
        found = FIND(text)
        return np.fromiter(map(terms.__getitem__, found), np.int32, len(found))
    out, at = [], 0
    while at < len(text):
        cut = BREAK(text, min(at + PIECE, len(text)))
        end = cut.start() if cut else len(text)
        found = FIND(text[at:end])
        out.append(np.fromiter(map(terms.__getitem__, found), np.int32, len(found)))
        at = end
    return np.concatenate(out)


class Shard:
    """Documents that are indexed together."""

    def __init__(self):
        self.terms, self.ids, self.found, self.chars = Terms(), [], [], 0

    def add(self, doc_id: int | None, text: str) -> None:
        numbers = numbers_of(text, self.terms)
        if len(numbers):
            self.ids.append(doc_id)
            self.found.append(numbers)
            self.chars += len(text)

    def rows(self, name: str):
        """Arrow batch of the shard's index rows."""
        import pyarrow as pa

        n = len(self.ids)
        order = sorted(range(n), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        lengths = np.array([len(self.found[i]) for i in order], np.int64)
        names = np.argsort(np.array(self.terms.names, object), kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[names] = np.arange(len(names))
        token = rank[np.concatenate([self.found[i] for i in order])]
        key, tf = np.unique(token * n + np.repeat(np.arange(n), lengths), return_counts=True)
        term, doc = key // n, key % n
        block = term * (n // WINDOW + 1) + doc // WINDOW
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        gap = np.diff(doc, prepend=0)
        gap[first] = doc[first] % WINDOW
        data, at = pack(np.stack([gap, tf], axis=1).ravel())
        edges = np.append(at[2 * first], at[-1])
        per_term = np.bincount(term[first], minlength=len(names))
        ends = np.cumsum(per_term)

        number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
        by = np.lexsort((lengths[doc], -tf, number))
        far = int(lengths.max()) + 1
        falling = np.minimum.accumulate(lengths[doc[by]] + (len(first) - number[by]) * far)
        front = by[np.concatenate([[True], falling[1:] < falling[:-1]])]
        front_sizes = np.bincount(number[front], minlength=len(first))
        fronts, front_at = pack(np.stack([tf[front], lengths[doc[front]]], axis=1).ravel())
        front_edges = front_at[2 * np.concatenate([[0], np.cumsum(front_sizes)])]

        def column(bytes_, byte_at):
            """A value for each term, and an empty one for the row of the documents."""
            offsets = np.concatenate([byte_at, byte_at[-1:]]).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(names) + 1, [None, pa.py_buffer(offsets), pa.py_buffer(bytes_)])

        def per_block(values):
            packed, where = pack(values)
            return column(packed, where[np.concatenate([[0], ends])])

        columns = [pa.array([*(self.terms.names[i] for i in names), None], pa.string()), pa.array(np.append(np.bincount(term, minlength=len(names)), n), pa.int64()), pa.array(np.append(np.bincount(token, minlength=len(names)), int(lengths.sum())), pa.int64()), pa.array(np.append(per_term, 0), pa.int32())]
        columns += [per_block(block[first] % (n // WINDOW + 1)), per_block(np.diff(edges)), per_block(front_sizes), column(fronts, front_edges[np.concatenate([[0], ends])]), column(data, edges[np.concatenate([[0], ends])])]
        kept = [self.ids[i] for i in order]
        ids = np.array([0 if i is None else i for i in kept], np.int64)
        columns[4] = pa.concat_arrays([columns[4].slice(0, len(names)), pa.array([ids.tobytes()], pa.binary())])
        columns[5] = pa.concat_arrays([columns[5].slice(0, len(names)), pa.array([np.packbits([i is None for i in kept]).tobytes()], pa.binary())])
        columns[6] = pa.concat_arrays([columns[6].slice(0, len(names)), pa.array([pack(lengths)[0]], pa.binary())])
        return pa.RecordBatch.from_arrays([pa.array([name] * (len(names) + 1), pa.string()), *columns], names=["shard", "term", "df", "total", "n_blocks", "windows", "sizes", "front_sizes", "fronts", "postings"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """The written index: a row for each shard and term, and one without a term for the documents of a shard. One scan, no shuffle."""

    def run(batches):
        from pyspark import TaskContext

        shard, n, task = Shard(), 0, TaskContext.get().partitionId()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                if shard.ids and shard.chars + len(text) > shard_chars:
                    yield from slices(shard.rows(f"{task}-{n}"))
                    shard, n = Shard(), n + 1
                shard.add(i, text)
        if shard.ids:
            yield from slices(shard.rows(f"{task}-{n}"))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return common.spill(rows.mapInArrow(run, INDEX), "search-index", "zstd")


def slices(batch, rows: int = 20_000):
    """Pieces of a batch, so Spark takes a shard's rows over bit by bit."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


# --- searching ---------------------------------------------------------------------


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def length_norm(lengths: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """m of each document, in integers."""
    wide = lengths if 75 * int(lengths.max(initial=0)) * n_docs < 1 << 63 else lengths.astype(object)
    return (25 + (75 * wide * n_docs) // total).astype(np.int64)


def contribution(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


class Searcher:
    """The queries' postings of one shard."""

    def __init__(self, lengths: np.ndarray, weights: np.ndarray, n_blocks: np.ndarray, windows: np.ndarray, sizes: np.ndarray, front_sizes: np.ndarray, fronts: np.ndarray, postings: list[bytes], n_docs: int, total: int):
        self.norm, self.weights, self.postings = length_norm(lengths, n_docs, total), weights, postings
        n_terms, self.n_windows = len(weights), len(lengths) // WINDOW + 1
        owner = np.repeat(np.arange(n_terms), n_blocks)
        tf, n = fronts[0::2], fronts[1::2]
        at = np.cumsum(front_sizes) - front_sizes
        most = np.maximum.reduceat(contribution(tf, length_norm(n, n_docs, total)), at) * weights[owner] if len(at) else np.zeros(0, np.int64)
        #: Greatest contribution by term and window; 0 where the term is absent.
        self.bound = np.zeros((n_terms, self.n_windows), np.int64)
        self.bound[owner, windows] = most
        self.start, self.size = np.zeros((2, n_terms, self.n_windows), np.int64)
        before = np.cumsum(sizes) - sizes
        self.start[owner, windows] = before - before[(np.cumsum(n_blocks) - n_blocks)[owner]] if len(owner) else 0
        self.size[owner, windows] = sizes
        self.list_bound = self.bound.max(axis=1, initial=0)
        self.unpacked, self.windows_tried, self.blocks = 0, 0, len(windows)

    def block(self, t: int, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the window and contributions of the documents that hold term t."""
        s = self.start[t, w]
        pairs = unpack(self.postings[t][s : s + self.size[t, w]])
        at, tf = np.cumsum(pairs[0::2]), pairs[1::2]
        self.unpacked += 1
        return at, contribution(tf, self.norm[w * WINDOW + at]) * self.weights[t]

    def search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, times): places of the k best documents, and their scores."""
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
        plans = []
        for terms, times in queries:
            order = np.argsort(self.list_bound[terms] * times, kind="stable")
            terms, times = terms[order], times[order]
            plans.append((terms, times, np.cumsum(self.list_bound[terms] * times)))
        sums = np.stack([self.bound[t].T @ c for t, c, _ in plans], axis=0) if plans else np.zeros((0, self.n_windows), np.int64)
        for w in range(self.n_windows):
            cache = {}
            for q in np.flatnonzero(sums[:, w] > 0):
                places, scores = best[q]
                least = int(scores[-1]) if len(scores) == k else 0
                if sums[q, w] <= least:
                    continue
                self.windows_tried += 1
                terms, times, reach = plans[q]
                bounds = self.bound[terms, w] * times
                essential = np.searchsorted(reach, least, "right")
                acc = np.zeros(WINDOW, np.int64)
                for i in essential + np.flatnonzero(bounds[essential:]):
                    self.add(cache, terms[i], w, times[i], acc)
                rest = np.flatnonzero(bounds[:essential])
                rest = rest[np.argsort(-bounds[rest], kind="stable")]
                left = int(bounds[rest].sum())
                held = np.flatnonzero(acc)
                for i in rest:
                    held = held[acc[held] + left > least]
                    if not len(held):
                        break
                    self.add(cache, terms[i], w, times[i], acc)
                    left -= int(bounds[i])
                held = held[acc[held] > least]
                if len(held):
                    places, scores = np.concatenate([places, held + w * WINDOW]), np.concatenate([scores, acc[held]])
                    top = np.lexsort((places, -scores))[:k]
                    best[q] = places[top], scores[top]
        return best

    def add(self, cache: dict, t: int, w: int, times: int, acc: np.ndarray) -> None:
        if t not in cache:
            cache[t] = self.block(t, w)
        at, points = cache[t]
        acc[at] += points * times


def shard_search(table, n_docs: int, total: int, k: int):
    """k best documents of a shard for each query: Arrow table in, (q, doc_id, score) out."""
    import pyarrow as pa

    term = table.column("term").to_pylist()
    at = term.index(None)
    doc = {n: table.column(n)[at].as_py() for n in ("windows", "sizes", "front_sizes")}
    ids = np.frombuffer(doc["windows"], np.int64)
    absent = np.unpackbits(np.frombuffer(doc["sizes"], np.uint8))[: len(ids)].astype(bool)
    rows = [i for i in range(len(term)) if i != at]
    got = table.take(pa.array(rows, pa.int64()))
    join = lambda n: unpack(b"".join(got.column(n).to_pylist()))
    weights, blocks = np.array(got.column("w").to_pylist(), np.int64), np.array(got.column("n_blocks").to_pylist(), np.int64)
    searcher = Searcher(unpack(doc["front_sizes"]), weights, blocks, join("windows"), join("sizes"), join("front_sizes"), join("fronts"), got.column("postings").to_pylist(), n_docs, total)
    users: dict[int, list[tuple[int, int]]] = {}
    for t, each in enumerate(got.column("users").to_pylist()):
        for u in each:
            users.setdefault(u["q"], []).append((t, u["times"]))
    numbers = sorted(users)
    found = searcher.search([tuple(np.array(x, np.int64) for x in zip(*users[q], strict=True)) for q in numbers], k)
    sizes = [len(p) for p, _ in found]
    places = np.concatenate([np.zeros(0, np.int64), *(p for p, _ in found)])
    scores = np.concatenate([np.zeros(0, np.int64), *(s for _, s in found)])
    return pa.table([pa.array(np.repeat(np.array(numbers, np.int64), sizes), pa.int64()), pa.array(ids[places], pa.int64(), mask=absent[places]), pa.array(scores, pa.int64())], names=["q", "doc_id", "score"])


def search(index: DataFrame, queries: DataFrame, id_col: str = "item_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(query's id, rank, doc_id, score): the k documents with the highest scores above 0 of each row of `queries`."""
    spark = index.sparkSession
    size = index.filter("term IS NULL").agg(F.sum("df").alias("n"), F.sum("total").alias("l")).first()
    n_docs, total = size.n or 0, size.l or 0
    items = common.spill(queries.select(F.monotonically_increasing_id().alias("q"), F.col(id_col).alias("item"), terms_of(F.col(text_col)).alias("terms")), "items")
    n_blocks = max(1, math.ceil(items.count() / QUERY_BLOCK))
    asked = items.select("q", F.explode("terms").alias("term")).groupBy("term", "q").agg(F.count(F.lit(1)).alias("times"))
    df = index.filter("term IS NOT NULL").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).alias("w")
    users = asked.groupBy(F.pmod("q", F.lit(n_blocks)).cast("int").alias("part"), "term").agg(F.collect_list(F.struct("q", "times")).alias("users"))  # QUERY_BLOCK at most
    weighted = common.spill(users.join(df.select("term", weight), "term"), "query-terms")
    columns = ["shard", "part", "term", "w", "users", "n_blocks", "windows", "sizes", "front_sizes", "fronts", "postings"]
    lists = index.filter("term IS NOT NULL").join(weighted, "term").select(*columns)
    documents = index.filter("term IS NULL").withColumns({"part": F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))), "w": F.lit(None).cast("long"), "users": F.lit(None).cast(lists.schema["users"].dataType)}).select(*columns)

    def run(table):
        return shard_search(table, n_docs, total, k)

    found = lists.unionByName(documents).groupBy("shard", "part").applyInArrow(run, "q long, doc_id long, score long")
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.join(items.select("q", "item"), "q").select(F.col("item").alias(id_col), "rank", "doc_id", "score")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(common.documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
     c AS (SELECT count(*) FILTER (len(t) > 0) AS n, CAST(coalesce(sum(len(t)), 0) AS BIGINT) AS l FROM d),
     p AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d) GROUP BY 1, 2, 3),
     f AS (SELECT term, CAST(floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1) CROSS JOIN c),
     q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
     s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * p.n * c.n) // c.l)))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN p USING (term) CROSS JOIN c GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""

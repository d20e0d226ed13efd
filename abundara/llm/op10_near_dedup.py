"""Near-duplicate texts by SetSketch registers.

A text's set is its distinct five-word shingles (ASCII lower case; fewer words: the sequence as one
shingle; no words: empty, linked with nothing). Texts with the same set are one node, named by a 128-bit
digest of the set, so copies never meet each other in pairs.

1. Each node gets SetSketch registers: with m independent hashes, register i is 1 - floor(log_b of the
   least exponential variate of its elements), exponentially spaced and cut to 0..q+1. Registers of a
   union are the maxima, so sketches merge.
2. Bands of registers are hashed to buckets; nodes that share a bucket are candidates. With BANDS bands
   of ROWS registers a pair at similarity 0.75 misses every band with probability (1-0.75^4)^40 < 3e-7.
3. Two sets share at most what each has in common with any candidate. So a member's "core" (its shingles that
   some other candidate has) bounds its similarity with every other one, and members or pairs that can't
   reach the threshold go without a look at their sets. Copies with many changes of their own go here.
4. Within a bucket every member is tried against a pivot, not against every other: the one with the least of
   its own. Members that end up in one component need no more trying. Where a bucket still spans several
   components, its members are tried by prefixes: put a set's shingles in one order for all, rare ones first; two sets at
   the similarity share a shingle among the first seventh of the smaller and the first quarter of the larger
   one, at places that leave enough behind them. So a passage that many documents have, being last in their orders,
   brings no pairs. For each such shingle, nodes outside its largest component meet the others, never all with all. No
   link between different components is lost, and a bucket of m near copies costs about m pairs rather than m squared.
5. A pair's similarity is first estimated from both sketches jointly (maximum likelihood for the counts of
   greater, smaller and equal registers, given both set sizes). Pairs whose estimate is far below the
   threshold (over 6 standard errors) go; all others are verified on the full sets.
6. Components of verified links come from alternating large-star and small-star rounds.

Edge cases: null and empty texts are components of their own. Texts are read whole. Repeated rows (equal id
and text) share a component; each is returned. Null ids take part and are never a component's name unless
all its ids are null. An empty table gives an empty result. Other columns are ignored by `near_components`
and carried through by `deduplicate`.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 40, 4
M = BANDS * ROWS
#: SetSketch parameters: base, rate, greatest register less one.
BASE, RATE, Q = 1.001, 20.0, (1 << 16) - 2
#: Estimates below this can't belong to a pair at 0.75: over 6 standard errors of M registers.
ESTIMATE_FROM = 0.52
_rng = np.random.default_rng(20240613)
MULTIPLY = _rng.integers(0, 1 << 63, M, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 1 << 63, M, np.uint64) * np.uint64(2)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hash(word: bytes, kept: dict[bytes, int]) -> int:
    h = kept.get(word)
    if h is None:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            if len(kept) > 200_000:
                kept.clear()
            kept[word] = h
    return h


def shingle_set(data: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles."""
    words = data.lower().split()  # bytes.lower() changes A-Z only, bytes.split() cuts at the six ASCII separators
    if not words:
        return np.zeros(0, np.uint64)
    kept = common.worker_cache("word hashes")
    h = np.fromiter((word_hash(w, kept) for w in words), np.uint64, len(words))
    width = min(SHINGLE, len(h))
    out = np.zeros(len(h) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return np.unique(out)


def registers(elements: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of a set of hashes."""
    least = np.full(M, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(elements), 256):
            block = elements[at : at + 256, None] * MULTIPLY[None] + ADD[None]
            np.minimum(least, block.min(0), out=least)
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, Q + 1).astype(np.uint16)


def estimated(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches (a row each), given the set sizes."""
    greater, smaller = (a > b).sum(1), (a < b).sum(1)
    equal = M - greater - smaller
    u, v = na / (na + nb), nb / (na + nb)
    grid = np.linspace(0, 1, 201)
    j = grid[None] * np.minimum(u / v, v / u)[:, None]  # greatest possible similarity
    part = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = part(u[:, None] - v[:, None] * j), part(v[:, None] - u[:, None] * j)
    tiny = 1e-12
    like = greater[:, None] * np.log(np.maximum(up, tiny)) + smaller[:, None] * np.log(np.maximum(down, tiny)) + equal[:, None] * np.log(np.maximum(1 - up - down, tiny))
    return j[np.arange(len(a)), like.argmax(1)]


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row per document: id, text_hash, n_shingles, node, sketch (null for empty sets), salt.

    The salt goes by the row's place in its task, so rows without id and rows that repeat are dealt out like all others. A task that runs
    again may number its rows anew: callers write the rows before they use it twice.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(common.text_or_empty(text_col)).alias("text_hash"), common.text_or_empty(text_col).cast("binary").alias("data"))

    def run(batches):
        seen = 37 * TaskContext.get().partitionId()  # tasks of few rows begin at different salts
        for batch in batches:
            n, node, sketch = [], [], []
            for data in batch.column(2):
                s = shingle_set(data.as_py())
                n.append(len(s))
                node.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sketch.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(sketch, pa.binary()), pa.array(np.arange(seen, seen + len(n)) % common.SALTS, pa.int32())], names=["id", "text_hash", "n_shingles", "node", "sketch", "salt"])
            seen += len(n)

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text_hash long, n_shingles long, node binary, sketch binary, salt int")


def buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node) for every bucket with two nodes at least. Counts come first, so lone nodes move once, as hashes."""

    def run(batches):
        weights = np.random.default_rng(7).integers(1, 1 << 62, (BANDS, ROWS), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            with np.errstate(over="ignore"):
                key = np.full(regs.shape[:2], 0, np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for r in range(ROWS):
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, r] + weights[None, :, r])
            rows = np.repeat(np.arange(len(regs)), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), batch.column(0).take(pa.array(rows))], names=["bucket", "node"])

    rows = nodes.select("node", "sketch").mapInArrow(run, "bucket long, node binary")
    return common.with_group(rows, ["bucket"], {"members": F.count(F.lit(1))}, ["node"], "members > 1").drop("members")


def sets_of(docs: DataFrame, ids: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(node, elements) of the nodes in `ids` (node, id, text_hash): a document stands for its node."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(common.text_or_empty(text_col)).alias("text_hash"), common.text_or_empty(text_col).cast("binary").alias("data"))
    chosen = rows.join(ids, rows["id"].eqNullSafe(ids["id"]) & (rows["text_hash"] == ids["text_hash"]), "left_semi").select("data")

    def run(batches):
        for batch in batches:
            sets = [shingle_set(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "elements"])

    return chosen.mapInArrow(run, "node binary, elements binary").dropDuplicates(["node"])


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that pass the joint estimate."""
    one = lambda x: nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}"), F.col("n_shingles").alias(f"n_{x}"))
    # sizes alone bound the similarity
    met = pairs.join(one("a"), "a").join(one("b"), "b").filter(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, M) for k in (2, 3))
                na, nb = (batch.column(k).to_numpy().astype(float) for k in (4, 5))
                keep = pa.array(estimated(a, b, na, nb) >= ESTIMATE_FROM)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return met.select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b").mapInArrow(run, "a binary, b binary")


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, linked): shared elements of the full sets, and whether they reach the similarity."""
    one = lambda x: sets.select(F.col("node").alias(x), F.col("elements").alias(f"set_{x}"))

    def run(batches):
        for batch in batches:
            shared, linked = [], []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                shared.append(both)
                linked.append(100 * both >= PERCENT * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "both", "linked"])

    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary, both long, linked boolean")


def star_round(edges: DataFrame) -> DataFrame:
    """Large-star, then small-star. Edges go from a to a smaller b, before and after. A hub's neighbours meet it by salt, so no task holds them all."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    large = common.with_group(both, ["u"], {"m": F.min("v")}, ["v"]).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    # each node keeps its least neighbour; its other neighbours, all smaller than it, hang on that one
    return common.with_group(large, ["u"], {"m": F.min("v")}, ["v"]).select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); the root is the least node of the component.

    Large-star: each node links its greater neighbours to the least of its neighbours and itself. Small-star:
    each node links its smaller neighbours to the least. Both keep components and shorten paths; a
    written table of edges after each round cuts lineage. It ends when the edges are stars: no node hangs on
    two others, and none that hangs on another has some hanging on it.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    while True:
        now = common.spill(star_round(now), "edges")
        sides = now.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("b").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("s")).select("s.*")
        if sides.groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down + up > 1 AND down > 0").isEmpty():
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def exploded(sets: DataFrame, kept: list[str]) -> DataFrame:
    """A row per shingle of (elements, *kept)."""
    rows = sets.select("elements", *kept)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                parts = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(0)]
                owner = pa.array(np.repeat(np.arange(len(parts)), [len(x) for x in parts]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), *[c.take(owner) for c in batch.columns[1:]]], names=["shingle", *kept])

    return rows.mapInArrow(run, ", ".join(["shingle long", *(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)]))


def lone_counts(sets: DataFrame) -> DataFrame:
    """(owner, lone): shingles that no other candidate has, by the first eight bytes of the node."""
    # a shingle of many candidates is one row per map task after the partial aggregate
    seen = exploded(sets.select("elements", F.substring("node", 1, 8).alias("owner")), ["owner"])
    seen = seen.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("owner"))
    return seen.filter("n = 1").groupBy("owner").agg(F.count(F.lit(1)).alias("lone"))


def may_link(n_a: Column, core_a: Column, n_b: Column, core_b: Column) -> Column:
    """Whether sizes allow the similarity: two sets share at most the smaller core (what some other candidate has too)."""
    both = F.least(core_a, core_b)
    return 100 * both >= PERCENT * (n_a + n_b - both)


def narrowed(members: DataFrame) -> DataFrame:
    """Members that could link with one of their bucket's sizes, in buckets that keep two at least."""
    sized = common.with_group(members, ["bucket"], {"least": F.min("n")}, ["node"])
    able = sized.filter(may_link(F.col("n"), F.col("core"), F.greatest("least", "core"), F.col("core"))).drop("least")
    return common.with_group(able, ["bucket"], {"m": F.count(F.lit(1))}, ["node"], "m > 1").drop("m")


def links(docs: DataFrame, sketched: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """(node, root) of all nodes that have links; None if there are none."""
    full = sketched.filter("node is not null")
    nodes = common.spill(full.groupBy("node").agg(F.min(F.struct("id", "text_hash")).alias("doc"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles")), "nodes")
    members = common.spill(buckets(nodes), "buckets")
    if members.isEmpty():
        return None
    wanted = members.select("node").distinct()
    sets = common.spill(sets_of(docs, nodes.join(wanted, "node", "left_semi").select("node", "doc.id", "doc.text_hash"), text_col, id_col), "sets")
    # a member's core is what some other candidate has too; a partner can share no more
    lone = lone_counts(sets)
    sized = sets.select("node", (F.length("elements") / 8).cast("long").alias("n"), F.substring("node", 1, 8).alias("owner"))
    profile = sized.join(lone, "owner", "left").select("node", "n", (F.col("n") - F.coalesce("lone", F.lit(0))).alias("core")).filter(100 * F.col("core") >= PERCENT * F.col("n"))
    members = common.spill(narrowed(members.join(profile, "node")), "members")
    if members.isEmpty():
        return None
    # the pivot of a bucket is the member with the least of its own, the most like all others
    pivot = F.min(F.struct((1 - F.col("core") / F.col("n")).alias("own"), "node", "n", "core"))
    near = common.with_group(members, ["bucket"], {"p": pivot}, ["node"]).filter((F.col("node") != F.col("p.node")) & may_link(F.col("n"), F.col("core"), F.col("p.n"), F.col("p.core")))
    pairs = near.select(F.col("p.node").alias("a"), F.col("node").alias("b")).distinct()
    met = common.spill(measured(likely(pairs, nodes), sets), "links")
    roots = components(met.filter("linked").select("a", "b"))
    named = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    spanning = common.with_group(named, ["bucket"], {"first": F.min("root"), "last": F.max("root")}, ["node"], "first <> last")
    open_ = common.spill(spanning.select("node", "root").distinct(), "open")
    if open_.isEmpty():
        return roots
    left = prefix_pairs(sets.join(open_, "node")).join(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    found = common.spill(measured(likely(left, nodes), sets).filter("linked").select("a", "b"), "links")
    if found.isEmpty():
        return roots
    return components(found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def prefix_pairs(sets: DataFrame) -> DataFrame:
    """(a, b) of the nodes in `sets` (node, root, elements) with different roots that could be similar enough, each pair once.

    `place` counts a set's shingles in the common order: first those that no other set has, then by how many have them.
    """
    rows = exploded(sets.withColumn("n", (F.length("elements") / 8).cast("int")), ["node", "root", "n"])
    seen = common.with_group(rows, ["shingle"], {"f": F.count(F.lit(1))}, ["node"], "f > 1")
    of_node = Window.partitionBy("node")
    place = F.col("n") - F.count(F.lit(1)).over(of_node) + F.row_number().over(of_node.orderBy("f", "shingle"))
    # at least 3/4 of the larger set is shared, and 6/7 of the smaller
    first = seen.withColumn("place", place).filter(100 * (F.col("n") - F.col("place") + 1) >= PERCENT * F.col("n")).drop("f")
    first = common.spill(first, "prefixes")
    counted = common.with_group(first, ["shingle", "root"], {"n_root": F.count(F.lit(1))}, ["node"])
    counted = counted.withColumn("salt", common.salt_of(F.col("node")))
    aggs = {"top": F.max(F.struct("n_root", "root")), "least": F.min("root"), "most": F.max("root"), "salts": common.salt_bits("salt")}
    first = common.with_group(counted, ["shingle"], aggs, ["node"], "least <> most").withColumn("main", F.col("top.root"))
    one = lambda x: first.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "n", "place", "main")], dealt[x])
    dealt = {"x": F.col("salts"), "y": F.col("salt")}
    behind = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y")) + 1
    # x lies outside the shingle's largest component; where y does too, the lesser node is x
    fits = (F.col("root_x") != F.col("root_y")) & ((F.col("root_y") == F.col("main_y")) | (F.col("node_x") < F.col("node_y"))) & ((100 + PERCENT) * behind >= PERCENT * (F.col("n_x") + F.col("n_y")))
    # each x goes to the salts that its shingle's rows have, no more copies than it has partners
    met = common.by_salt(one("x").filter("root_x <> main_x"), "salts", "salt").join(one("y"), ["shingle", "salt"]).filter(fits)
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def rooted(docs: DataFrame, sketched: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row per node: node, root (the node that names its component), first (the least (no id, id, text_hash) of its rows), salts."""
    rows = sketched.filter("node is not null").select("id", "text_hash", "node", "salt")
    nodes = rows.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("first"), common.salt_bits("salt").alias("salts"))
    roots = links(docs, sketched, id_col, text_col)
    if roots is None:
        return nodes.withColumn("root", F.col("node"))
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row per document: id, text_hash, n_shingles, component_id. Copies with equal sets meet their component once for the node, then by salt."""
    sketched = common.spill(sketches(docs, id_col, text_col), "sketches")
    named = common.with_group(rooted(docs, sketched, id_col, text_col), ["root"], {"component": F.min("first")}, ["node"])
    named = common.by_salt(named.select("node", "salts", F.col("component.id").alias("component_id")), "salts", "salt")
    rows = sketched.select("id", "text_hash", "n_shingles", "node", "salt")
    some = rows.filter("node is not null").join(named, ["node", "salt"])
    none = rows.filter("node is null").withColumn("component_id", F.col("id"))
    names = ["id", "text_hash", "n_shingles", "component_id"]
    return some.select(*names).unionByName(none.select(*names))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one of each component, with all their columns. Texts without words all stay.

    A null id never wins over an id. Components are told apart by their root, as several can have no id, or the same least one.
    """
    sketched = common.spill(sketches(docs, id_col, text_col), "sketches")
    winners = rooted(docs, sketched, id_col, text_col).groupBy("root").agg(F.min("first").alias("w")).select("w.id", "w.text_hash")
    winners = winners.unionByName(sketched.filter("node is null").select("id", "text_hash").distinct())
    return common.one_row_each(docs, {"id": F.col(id_col), "text_hash": F.xxhash64(common.text_or_empty(text_col))}, winners)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(common.documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 75 * (a.n + b.n - shared)),
r(doc, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.doc),
c AS (SELECT doc, min(root) AS component_id FROM r GROUP BY 1)
SELECT doc AS doc_id, coalesce(n, 0) AS n_shingles, component_id, doc = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = doc
"""

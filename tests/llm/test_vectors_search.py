"""Ranked search, product codes and exact top-k against brute force, with edge rows."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from abundara.llm import exact_gemm, op11_search, op12_vector_codes, op13_exact_topk

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate(op11_search.TO_LOWER) for t in TERM.findall(text or "")]


# --- ranked search -----------------------------------------------------------------


def ranked(docs, items, k=10):
    """Every document scored for every item."""
    found = [(i, terms(t)) for i, t in docs]
    found = [(i, t) for i, t in found if t]
    n, total = len(found), sum(len(t) for _, t in found)
    counts = [(i, len(t), collections.Counter(t)) for i, t in found]
    df = collections.Counter(x for _, _, c in counts for x in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * v + 1))) for t, v in df.items()}
    out = []
    for item, text in items:
        asked, scores = terms(text), []
        for i, size, tf in counts:
            m = 25 + 75 * size * n // total
            s = sum(weight[t] * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in asked if t in tf)
            if s > 0:
                scores.append((-s, math.inf if i is None else i))
        out += [(item, r, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(str, out))


def searched(spark, docs, items, **kind):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    return sorted(str(tuple(r)) for r in op11_search.search(op11_search.build_index(frame, **kind), asked).collect())


EDGES = [(1, None), (2, ""), (3, " \n."), (4, "a b"), (4, "a b"), (5, "A-b_c"), (7, "é\U0001f600 ß Éa b"), (8, "x" * 30_000), (9, "one two three four b. " * 3_000), (10, "0.0.0.0 a@b.c"), (None, "a null id b"), (11, "a b\x00c")]


@pytest.mark.parametrize("chars", [10, 1 << 20])
def test_search_edges(spark, chars):
    items = [(0, "a B b"), (1, None), (2, ""), (3, "nowhere"), (4, "É\U0001f600 ß"), (5, "b " * 40), (5, "one"), (6, "x" * 30_000 + " c")]
    assert searched(spark, EDGES, items, shard_chars=chars) == ranked(EDGES, items)


def test_search_of_tables(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert searched(spark, docs, items) == ranked(docs, items)


@pytest.mark.parametrize("seed", [1, 2])
def test_search_of_skewed_words(spark, seed):
    """Frequent words, copies in a third of all rows, ties; several windows in a shard."""
    rng = np.random.default_rng(seed)
    words = [f"w{min(int(x), 400)}" for x in rng.zipf(1.3, 60_000)]
    docs, at = [], 0
    for i in range(3_500):
        n = int(rng.integers(1, 25))
        docs.append((3 * i % 3_499, "w1 w2 w9 same" if i % 3 == 0 else " ".join(words[at : at + n])))
        at = (at + n) % 59_000
    items = [(i, " ".join(words[7 * i : 7 * i + 6])) for i in range(20)] + [(99, "same w9")]
    assert searched(spark, docs, items) == ranked(docs, items)


def test_search_empty_and_clashing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b", "x", 5, "y")], "doc_id long, text string, term string, q long, shard string")
    asked = spark.createDataFrame([(3, "b", 1)], "item_id long, text string, q int")
    assert op11_search.search(op11_search.build_index(none), asked).count() == 0
    assert op11_search.search(op11_search.build_index(some), asked.filter("false")).count() == 0
    assert [(r.item_id, r.doc_id) for r in op11_search.search(op11_search.build_index(some), asked).collect()] == [(3, 1)]


def test_blocks_are_skipped():
    """A rare word decides: blocks of the frequent one stay packed, and results are those of a full scan."""
    shard = op11_search.Shard()
    for i in range(20 * op11_search.WINDOW):
        shard.add(i, "common rare rare" if i % 5_000 == 7 else "common other words here")
    batch = shard.rows("s")
    table = batch.to_pydict()
    at = {t: i for i, t in enumerate(table["term"])}
    rows = [at["common"], at["rare"]]
    unpack = lambda c: op11_search.unpack(b"".join(table[c][i] for i in rows))
    n, total = table["df"][at[None]], table["total"][at[None]]
    lengths = op11_search.unpack(table["front_sizes"][at[None]])
    searcher = op11_search.Searcher(lengths, np.array([1, 5_000]), np.array([table["n_blocks"][i] for i in rows]), unpack("windows"), unpack("sizes"), unpack("front_sizes"), unpack("fronts"), [table["postings"][i] for i in rows], n, total)
    (places, scores), = searcher.search([(np.array([0, 1]), np.array([1, 1]))], 3)
    assert places.tolist() == [7, 5_007, 10_007] and len(set(scores)) == 1
    assert searcher.unpacked < 0.5 * searcher.blocks and searcher.windows_tried < searcher.n_windows


@given(st.lists(st.integers(0, 2**40), max_size=50))
def test_packed_numbers(values):
    data, at = op11_search.pack(np.array(values, np.int64))
    assert op11_search.unpack(data).tolist() == values and at[-1] == len(data)


def test_long_texts_are_cut_between_terms():
    text = "ab, " * 400_000 + "c" * 1_200_000 + " ab"
    found = op11_search.Terms()
    assert collections.Counter(op11_search.numbers_of(text, found).tolist()) == {0: 400_001, 1: 1}


# --- exact products ----------------------------------------------------------------


@settings(deadline=None)
@given(st.integers(1, 40), st.sampled_from([3, 12, 30, 45, 62]), st.integers(0, 9))
def test_products_are_exact(width, bits, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(1 << bits), 1 << bits, (5, width)), rng.integers(-(1 << bits), 1 << bits, (3, width))
    a[0, 0], b[0, 0] = -(1 << bits), -(1 << bits)
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert [[int(v) for v in r] for r in exact_gemm.product(a, b)] == want
    assert [int(v) for v in exact_gemm.squares(a)] == [sum(int(x) ** 2 for x in r) for r in a]


# --- product codes -----------------------------------------------------------------


def codes_brute(rows, scale=4096, parts=8, entries=16, rounds=6):
    """Plain k-means over Python integers."""
    good = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in good), default=0) // parts) * parts
    good = [(i, v + [0] * (width - len(v)), label) for i, v, label in good]
    w = width // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    first = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            joined = collections.defaultdict(list)
            for _, v, _ in good:
                joined[nearest(cut(v, p), books[p])].append(cut(v, p))
            for e, xs in joined.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out, by_label = [], collections.Counter()
    for i, v, label in good:
        code = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(far(cut(v, p), books[p][c]) for p, c in enumerate(code))
        by_label[label] += error
        out.append((i, code, error, label))
    text = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(str((i, c, e, by_label[label])) for i, c, e, label in out), hashlib.sha256(text.encode()).hexdigest()


def compressed(frame):
    rows, books = op12_vector_codes.compressed(frame)
    return sorted(str((r.id, list(r.code), r.error, r.label_error)) for r in rows.collect()), books.sha256()


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("size", [5, 200])
def test_codes(spark, size):
    rng = np.random.default_rng(size)
    rows = [(i, [float(x) for x in rng.normal(size=16)], int(i % 3)) for i in range(size)]
    rows += [(1_000, None, 1), (1_001, [1.0, None] + [0.0] * 14, 1), (1_002, [math.nan] * 16, 1), (1_003, [math.inf] + [0.0] * 15, 2), (3, rows[3][1], None), (None, rows[4][1], None)] + [(2_000 + i, [0.5] * 16, 0) for i in range(size // 2)]
    assert compressed(spark.createDataFrame(rows, SCHEMA).repartition(3)) == codes_brute(rows)


def test_codes_of_large_and_ragged_vectors(spark):
    rows = [(i, [(-1.0) ** i * 10.0 ** (i % 11)] * (5 + i % 7), i % 2) for i in range(40)] + [(90, [], None)]
    assert compressed(spark.createDataFrame(rows, SCHEMA)) == codes_brute(rows)


def test_codes_of_nothing_and_clashing_columns(spark):
    frame = spark.createDataFrame([(1, [0.5] * 8, 0, 7, "x", 1)], SCHEMA + ", id int, code string, error int")
    rows, books = op12_vector_codes.compressed(frame)
    assert [(r.id, list(r.code), r.error) for r in rows.collect()] == [(1, [0] * 8, 0)] and len(books.books) == 8
    near = op12_vector_codes.decoded(rows, books).first().approximation
    assert near == [2048] * 8
    assert op12_vector_codes.compressed(frame.filter("false"))[0].count() == 0


# --- exact top-k -------------------------------------------------------------------


def top_brute(rows, scale=1024, k=10, modulus=100):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in good:
        if q is None or q % modulus:
            continue
        scores = sorted((-sum(a * b for a, b in zip(x, y)), math.inf if i is None else i) for i, y in good if i != q)
        out += [(q, r, None if i == math.inf else i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(map(str, out))


def top(frame, modulus=100):
    found = op13_exact_topk.top_products(frame, F.col("id") % modulus == 0)
    return sorted(str((r.query_id, r["rank"], r.vec_id, r.score)) for r in found.collect())


def planted(seed, n=900):
    """Lengths over four orders of magnitude, tight bundles, copies in a third of all rows, and unusable vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 12))
    rows = []
    for i in range(n):
        v = centres[i % 6] + 0.02 * rng.normal(size=12) if i % 2 else rng.normal(size=12) * 10.0 ** -int(rng.integers(0, 4))
        rows.append((i, [float(x) for x in (centres[0] if i % 3 == 0 else v)]))
    return rows + [(2_000, None), (2_100, [1.0, None]), (2_200, [math.nan] * 12), (2_300, [0.0] * 12), (None, rows[1][1]), (5, rows[5][1]), (2_400, [5.0, 1.0])]


@pytest.mark.parametrize("seed", [1, 2])
def test_top_products(spark, seed, monkeypatch):
    monkeypatch.setattr(op13_exact_topk, "SEEDS", 64)
    rows = planted(seed)
    assert top(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)) == top_brute(rows)


def test_both_ways_of_pruning_are_used():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8)) * 1000
    x = np.round(np.concatenate([centres[i % 40] + rng.normal(size=(1, 8)) * 5 for i in range(2_000)])).astype(np.int64)
    lengths = np.sqrt((x.astype(float) ** 2).sum(1))
    order = np.argsort(-lengths)
    x, lengths, stats = x[order], lengths[order], {}
    bucket = op13_exact_topk.Bucket(np.arange(len(x)), x, lengths)
    products = x[:100] @ x.T
    for i in range(100):
        products[i, i] = -(1 << 60)
    least = np.sort(products, axis=1)[:, -10].astype(float)
    least[50:70] = -np.inf
    least[70:] = lengths[70:100] * lengths[0] * 2
    for i, rows, scores in bucket.search(np.arange(100), x[:100], lengths[:100], least, 10, stats):
        want = sorted(((-int(products[i, j]), j) for j in range(len(x)) if products[i, j] >= least[i] and j != i))[:10]
        assert [(-int(s), int(j)) for s, j in zip(scores, rows)] == want
    assert stats["coordinate"] > 20 and stats["length"] >= 20 and stats["skipped"] == 30


def test_top_products_edges(spark):
    schema = "vec_id long, embedding array<float>, q string, length int, score string"
    one = spark.createDataFrame([(100, [1.0, 2.0], "a", 1, "b")], schema)
    assert top(one) == [] and top(one.filter("false")) == []
    twice = spark.createDataFrame([(100, [1.0, 2.0]), (100, [3.0, 0.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert top(twice) == sorted(map(str, [(100, 1, 7, 1024 * 1024 * 3), (100, 1, 7, 1024 * 1024 * 3)]))
    large = [(i, [1e18 * (i + 1), -1.0]) for i in range(3)]
    assert [t.split(",")[2].strip() for t in top(spark.createDataFrame([(100 * i, v) for i, v in large], "vec_id long, embedding array<double>"))][:2] == ["200", "100"]

"""The kept index and the word index against plain versions."""

import collections
import os
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from abundara.operators import retrieval, search_index, substrings
from abundara.plans import queries as Q


def bm25_brute(docs, items, k, least=0.0, strict=True, bonus=0.0, only=None):
    found = [(i, search_index.text_tokens(t), (topic or "").lower()) for i, t, topic in docs]
    held = [x for x in found if x[1]]
    n = len(held)
    avgdl = round(sum(len(t) for _, t, _ in held) / n, 6) if n else 0
    df = collections.Counter(w for _, t, _ in held for w in set(t))
    out = []
    for item, text in items:
        named = set(re.split(r"[^a-z0-9_-]+", text.lower())) if text and bonus else set()
        scores = []
        for i, t, topic in found:
            if only and topic != only.lower():
                continue
            tf, s = collections.Counter(t), 0.0
            for w in search_index.text_tokens(text):
                if w in tf:
                    s += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / avgdl))
            s += bonus if topic and topic in named else 0
            if (s > least) if strict else (s >= least):
                scores.append((-round(s, 9), i))
        out += [(item, r, i, round(-s, 6)) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def planted(n=3_000):
    rng = np.random.default_rng(4)
    words = [f"w{min(int(x), 300)}" for x in rng.zipf(1.4, 40_000)]
    docs, at = [], 0
    for i in range(n):
        size = int(rng.integers(0, 20))
        text = "w1 w2 same w9" if i % 3 == 0 else " ".join(words[at : at + size])
        docs.append((i, None if i % 101 == 0 else text, [None, "en", "De", ""][i % 4]))
        at = (at + size) % 39_000
    return docs, [(i, " ".join(words[5 * i : 5 * i + 5]) + (" en" if i % 2 else " de")) for i in range(15)] + [(90, "same"), (91, None), (92, ""), (93, "the en"), (94, "w1 w1 w1")]


@pytest.mark.parametrize("kind", [{}, {"only": "EN"}, {"bonus": 0.2, "least": 0.2, "strict": False}])
def test_top_hits_equal_all_pairs(spark, kind, monkeypatch):
    monkeypatch.setattr(search_index, "QUERY_BLOCK", 6)
    docs, items = planted()
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(2)
    index = search_index.built(frame, "doc_id", topic="lang")
    asked = spark.createDataFrame(items, "item_id long, text string")
    rows = search_index.top_hits(asked, index, "item_id", 10, **kind, **({"named": "text"} if "bonus" in kind else {})).collect()
    got = sorted((r.item_id, r["rank"], r.doc_id, round(r.score, 6)) for r in rows)
    want = bm25_brute(docs, items, 10, **kind)
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(g[3] == pytest.approx(w[3], abs=2e-6) for g, w in zip(got, want))


def test_statistics_of_the_index(spark):
    index = search_index.built(spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, "the and of"), (4, None)], "doc_id long, text string"), "doc_id")
    assert (index.n_docs, index.avgdl) == (2, 2.5)
    assert {r.token: r.df for r in index.document_frequency().collect()} == {"alpha": 2, "beta": 1, "gamma": 1}
    none = search_index.built(spark.createDataFrame([], "doc_id long, text string"), "doc_id")
    asked = spark.createDataFrame([(1, "beta beta")], "item_id long, text string")
    assert search_index.top_hits(asked, none, "item_id", 3).count() == 0
    assert search_index.top_hits(asked.filter("false"), index, "item_id", 3).count() == 0
    assert search_index.top_hits(asked, index, "item_id", 3).first().doc_id == 1


def test_index_is_kept_until_files_change(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "alpha")], "doc_id long, text string").write.parquet(path)
    one = search_index.kept(spark.read.parquet(path), "doc_id")
    assert search_index.kept(spark.read.parquet(path), "doc_id") is one
    spark.createDataFrame([(2, "beta")], "doc_id long, text string").write.mode("append").parquet(path)
    two = search_index.kept(spark.read.parquet(path), "doc_id")
    assert two is not one and (one.n_docs, two.n_docs) == (1, 2)


def test_queries_share_the_index(spark, sf_dir):
    built = len(search_index._kept)
    Q.QUERIES["bm25_search"](spark, sf_dir)
    size = len(search_index._kept)
    for name in ("bm25_search", "bm25_search_boosted", "bm25_search_topic", "evidence_merge"):
        plan = Q.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "documents.parquet" not in plan
    assert len(search_index._kept) == size <= built + 1


def test_blocks_are_passed_over(spark):
    docs = [(i, "rare rare common" if i % 4_000 == 5 else "common other words here") for i in range(20_000)]
    index = search_index.built(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), "doc_id")
    asked = spark.createDataFrame([(1, "common rare")], "item_id long, text string")
    row = search_index.blocks_read(asked, index, "item_id", 2).first()
    assert 0 < row.read < 0.6 * row.blocks
    assert [r.doc_id for r in search_index.top_hits(asked, index, "item_id", 2).orderBy("rank").collect()] == [5, 4_005]


# --- word index --------------------------------------------------------------------


def keyword_brute(chunks, items, k, preferred):
    split = lambda text: {t for t in re.split("[\\s,.;:!?()\\[\\]\"'/|，。；：！？、（）]+", text.lower()) if len(t) >= 2}
    out = []
    for item, text in items:
        scores = []
        for i, library, title, body in chunks:
            points = sum(1.8 if t in (title or "").lower() else 1.0 if t in (body or "").lower() else 0 for t in split(text or ""))
            s = round(points + (0.35 if library in preferred else 0), 2)
            if s > 0:
                scores.append((-s, library, title or "", i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def test_keyword_search_equals_nested_loops(spark):
    rng = np.random.default_rng(6)
    parts = ["ab", "abc", "bca", "cabx", "xx", "ñandú", "菌群", "a", "-b-", "x" * 40]
    text = lambda n: " ".join("".join(rng.choice(parts, int(rng.integers(1, 4)))) for _ in range(n))
    chunks = [(i, f"lib{i % 3}", text(2), text(int(rng.integers(0, 12)))) for i in range(200)] + [(900, "lib1", "", ""), (901, "lib2", "Ab", None)]
    items = [(1, "AB, bc"), (2, "菌群。xx"), (3, "cabx|abc abc"), (4, "nowhere zz"), (5, ""), (6, None), (7, "a b"), (8, "x" * 40), (9, "ndú -b"), (10, "x" * 41 + "q")]
    index = substrings.built(spark.createDataFrame(chunks, "id long, library string, title string, content string").repartition(3))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("liked", F.array(F.lit("lib1"), F.lit("lib1")))
    for preferred in (None, "liked"):
        rows = substrings.keyword_top(asked, index, "item_id", 7, preferred=preferred).collect()
        got = sorted((r.item_id, r["rank"], r.id, r.score) for r in rows)
        assert got == keyword_brute(chunks, items, 7, ["lib1"] if preferred else [])


def test_only_words_of_the_rarest_gram_are_verified(spark):
    index = substrings.built(spark.createDataFrame([(1, "l", "t", "abcd abce abcf"), (2, "l", "t", "zabc qabcd")], "id long, library string, title string, content string"))
    found = substrings.matching_words(spark.createDataFrame([("abcd",), ("bc",), ("none",)], "token string"), index)
    got = collections.defaultdict(set)
    for r in found.collect():
        got[r.token].add(r.word)
    assert got == {"abcd": {"abcd", "qabcd"}, "bc": {"abcd", "abce", "abcf", "zabc", "qabcd"}}


def test_evidence_is_added_to_responses(spark):
    schema = "item long, cards array<struct<type:string,content:string>>, actions array<string>"
    answers = spark.createDataFrame([(1, [("a", "x"), ("b", "y"), ("b", "z")], ["view_web"]), (2, [], []), (3, [("a", "x")], None)], schema)
    hits = lambda rows: spark.createDataFrame(rows, "item long, position int, title string")
    rows = retrieval.augmented_responses(answers, {"web": hits([(1, 2, "w2"), (1, 1, None), (1, 4, "far")]), "knowledge": hits([(1, 1, "k"), (2, 1, "k2")])}, "item", "b").collect()
    got = {r.item: (r.n_knowledge, r.n_web, [(c.type, c.content) for c in r.cards], r.actions) for r in rows}
    assert got[1] == (1, 2, [("a", "x"), ("knowledge_support", "1. k"), ("web_evidence", "1. \n2. w2"), ("b", "y"), ("b", "z")], ["view_web", "view_knowledge", "explain_rules", "part_internal_from_web"])
    assert got[2] == (1, 0, [("knowledge_support", "1. k2")], ["view_knowledge", "explain_rules"])
    assert got[3] == (0, 0, [("a", "x")], None)


def test_keyword_search_neither_writes_nor_shuffles_words(spark):
    """Only the queries are written before the search, and its one shuffle gets k rows a query and task at most."""
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    chunks = [(i, "l", f"common t{i % 7}", f"common words w{i}x of text {i % 11}") for i in range(5_000)]
    index = substrings.built(spark.createDataFrame(chunks, "id long, library string, title string, content string").repartition(3))
    asked = spark.createDataFrame([(i, f"common w{i}x") for i in range(40)], "item_id long, text string")
    top = substrings.keyword_top(asked, index, "item_id", 2)
    rows = top.collect()
    assert len(rows) == 80 and all(r.id == r.item_id for r in rows if r["rank"] == 1)
    size = sum(os.path.getsize(os.path.join(at, f)) for n in set(os.listdir(folder)) - before for at, _, fs in os.walk(os.path.join(folder, n)) for f in fs)
    assert size < 50_000
    found = re.findall(r"Exchange hashpartitioning", top._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
    assert len(found) <= 1


def test_keyword_search_over_blocks_of_queries_and_forgotten_words(spark, monkeypatch):
    monkeypatch.setattr(substrings, "QUERY_BLOCK", 2)
    monkeypatch.setattr(substrings, "WORDS", 3)
    monkeypatch.setattr(substrings, "TEXTS", 4)
    asked = substrings.Asked([["ab", "bc"], [], ["bc"], ["abcd", "ab"], ["zz"]], [[], ["l"], ["l"], [], []])
    cells = asked.cells(["abc", None, "x"], ["zabcd abc q", "bc,ab", None], ["l", "m", None])
    assert np.concatenate([asked.scores(cells, 3, b) for b in range(len(asked.blocks))], axis=1).tolist() == [[360, 35, 215, 280, 0], [200, 0, 100, 100, 0], [0, 0, 0, 0, 0]]

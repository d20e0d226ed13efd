"""The pipeline's stages in a row on edge rows, and worker caches."""


import random

import pytest

import corpus_pipeline
from abundara.llm import common

RNG = random.Random(3)
GOOD = " ".join(" ".join(RNG.choice(("sea", "hill", "calmly", "river", "tree", "walks", "over", "under", "stone", "light", "evening", "from", "into")) + RNG.choice(("", "s", "y", "er")) for _ in range(9)).capitalize() + "." for _ in range(20))


def through(docs):
    """(name, rows, columns) after each stage."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.spill(stage(docs.sparkSession, docs, ""), name)
        out.append((name, docs.collect(), docs.columns))
    return out


@pytest.fixture(scope="module")
def wide(spark):
    """Null ids and texts, blanks, copies, repeated rows, a long text, and columns with the operators' own names."""
    texts = [(1, GOOD), (2, GOOD), (2, GOOD), (None, GOOD + " More words than before."), (3, None), (4, ""), (5, " \n"), (6, GOOD.replace("calmly", "slowly")), (7, "x" * 30_000), (8, GOOD + " " + "Another evening, other stones."), (9, GOOD[::-1])]
    rows = [(i, t, "en", "s", len(t or ""), "own", 7, "k", {"a": 1}, 5, "w", "r") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, digest long, kept string, extra map<string,int>, salt int, id string, rank string").repartition(3)


def test_stages_on_edge_rows(wide):
    found = through(wide)
    for name, rows, columns in found[:-1]:
        assert columns == wide.columns, name
        assert all(r.text for r in rows)  # nulls and blanks have no words
    sizes = [len(rows) for _, rows, _ in found[:-1]]
    assert sizes[0] > sizes[1] >= sizes[2] == sizes[3] > 0
    kept = {r.doc_id for r in found[1][1]}
    assert 2 not in kept and 1 in kept  # the least id of equal texts, repeated rows with it
    _, packed, columns = found[-1]
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(columns) and {r.doc_id for r in packed} == {r.doc_id for r in found[-2][1]}


def test_stages_on_nothing(wide):
    assert [len(rows) for _, rows, _ in through(wide.filter("false"))] == [0] * 5


def test_a_worker_keeps_one_operators_cache():
    one = common.worker_cache("a")
    one["x"] = 1
    assert common.worker_cache("a") is one
    common.worker_cache("b")
    assert common.worker_cache("a") == {} and common.worker_cache(None) == {}

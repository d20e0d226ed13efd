"""Boosting and nearest-neighbour information against plain versions."""

import math

import numpy as np
import pytest

from abundara.operators import boosting, information, ordination
from abundara.plans import queries as Q


def planted(n=300, width=6, classes=3, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(classes, width)) * 1.5
    return [(i, [float(x) for x in centres[i % classes] + rng.normal(size=width)], "ab1"[i % classes]) for i in range(n)]


SCHEMA = "vec_id long, embedding array<double>, label string"
QUICK = boosting.Params(rounds=6, patience=3, floor=2, depth=2, rate=0.3, rows=1.0, columns=1.0, least_hessian=0.5, bins=16)


# --- boosting ----------------------------------------------------------------------


def boosted_brute(rows, cuts, p, classes):
    """One model over all rows, row by row and cell by cell."""
    labels = sorted({label for *_, label in rows})
    y = [labels.index(label) for *_, label in rows]
    weight = [len(rows) / (classes * sum(a == b for a in y)) for b in y]
    bins = [[sum(v > c for c in cuts[f]) for f, v in enumerate(x)] for _, x, _ in rows]
    soft = lambda g: math.copysign(max(abs(g) - p.alpha, 0), g)
    margin = [[0.0] * classes for _ in rows]

    def leaf(own, g, h):
        return -p.rate * soft(sum(g[i] for i in own)) / (sum(h[i] for i in own) + p.lam)

    def grow(own, g, h, depth, out):
        if depth == p.depth:
            out.update(dict.fromkeys(own, leaf(own, g, h)))
            return
        worth = lambda s: soft(sum(g[i] for i in s)) ** 2 / (sum(h[i] for i in s) + p.lam)
        best = None
        for f in range(len(cuts)):
            for b in range(len(cuts[f])):
                left, right = [i for i in own if bins[i][f] <= b], [i for i in own if bins[i][f] > b]
                if min(sum(h[i] for i in left), sum(h[i] for i in right)) < p.least_hessian:
                    continue
                gain = 0.5 * (worth(left) + worth(right) - worth(own)) - p.gamma
                if gain > 0 and (best is None or gain > best[0] + 1e-12):
                    best = gain, left, right
        if best:
            grow(best[1], g, h, depth + 1, out)
            grow(best[2], g, h, depth + 1, out)
        else:
            out.update(dict.fromkeys(own, leaf(own, g, h)))

    for _ in range(p.rounds):
        steps = []
        for c in range(classes):
            soft_max = [[math.exp(v) / sum(math.exp(u) for u in m) for v in m] for m in margin]
            g = [(q[c] - (t == c)) * w for q, t, w in zip(soft_max, y, weight)]
            h = [max(2 * q[c] * (1 - q[c]), 1e-16) * w for q, w in zip(soft_max, weight)]
            out = {}
            grow(list(range(len(rows))), g, h, 0, out)
            steps.append(out)
        margin = [[m + steps[c][i] for c, m in enumerate(ms)] for i, ms in enumerate(margin)]
    return [[math.exp(v) / sum(math.exp(u) for u in m) for v in m] for m in margin]


def test_boosting_equals_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(boosting, "FLUSH", 2)  # margins are written in between
    rows = planted(120)[:-10]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    p = boosting.Params(rounds=5, depth=2, rate=0.4, rows=1.0, columns=1.0, least_hessian=1.0, bins=8)
    model = boosting.fitted(frame, "embedding", "label", "vec_id", p)
    want = boosted_brute(rows, model.cuts, p, 3)
    got = {r.vec_id: r.p for r in boosting.probabilities(model, frame, "embedding", "vec_id").collect()}
    assert model.rounds == 5 and model.labels == ["1", "a", "b"]
    assert np.allclose([got[i] for i, *_ in rows], want, atol=1e-9)


def test_folds_share_scans_and_stop(spark):
    """The final model of a run with folds is the model without folds; folds learn without their own rows."""
    rows = planted()
    frame = spark.createDataFrame(rows, SCHEMA)
    out, model = boosting.cross_validated(frame, "embedding", "label", "vec_id", QUICK, 3)
    got = {r.vec_id: (r.label, r.predicted_label) for r in out.collect()}
    assert set(got) == {i for i, *_ in rows} and all(got[i][0] == label for i, _, label in rows)
    assert sum(a == b for a, b in got.values()) > 0.85 * len(rows)
    assert len(model.best_rounds) == 3 and model.rounds == max(2, int(np.median(model.best_rounds)))
    assert all(b < a for a, b in zip(model.losses[0], model.losses[2]))
    alone = boosting.fitted(frame, "embedding", "label", "vec_id", boosting.replace(QUICK, rounds=model.rounds))
    p, q = ({r.vec_id: r.p for r in boosting.probabilities(m, frame, "embedding", "vec_id").collect()} for m in (model, alone))
    assert all(np.allclose(p[i], q[i]) for i in p)


def test_early_stop_drops_later_rounds(spark):
    """Labels that nothing explains: folds stop soon, and the final model keeps `floor` rounds."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=3)], "xy"[int(rng.integers(2))]) for i in range(120)]
    p = boosting.Params(rounds=40, patience=2, floor=3, depth=3, rate=0.8, gamma=0.0, alpha=0.0, least_hessian=0.1, bins=32)
    model = boosting.fitted(spark.createDataFrame(rows, SCHEMA), "embedding", "label", "vec_id", p, 2)
    assert model.rounds == max(3, int(np.median(model.best_rounds))) == len(model.trees) and len(model.losses) < 30


def test_samples_of_rows_and_columns_still_learn(spark):
    frame = spark.createDataFrame(planted(), SCHEMA)
    p = boosting.replace(QUICK, rounds=8, rows=0.7, columns=0.5)
    model = boosting.fitted(frame, "embedding", "label", "vec_id", p)
    got = boosting.predictions(model, frame, "embedding", "vec_id", {"a": "Alpha"}).collect()
    truth = {i: label for i, _, label in planted()}
    named = {"a": "Alpha", "b": "Group b", "1": "Group 1"}
    assert sum(r.top[0].label == named[truth[r.vec_id]] for r in got) > 0.85 * len(got)
    assert sum(boosting.importance(model)) == pytest.approx(1)


def test_boosting_edges(spark):
    rows = [*planted(30), (90, None, "a"), (91, [1.0] * 6, None), (92, [1.0], "b"), (93, [math.nan] * 6, "b"), (3, [0.5] * 6, "b")]
    frame = spark.createDataFrame(rows, SCHEMA)
    model = boosting.fitted(frame, "embedding", "label", "vec_id", QUICK)
    found = boosting.probabilities(model, frame, "embedding", "vec_id").collect()
    assert len(found) == len(rows) and all(sum(r.p) == pytest.approx(1) for r in found)
    one = boosting.fitted(frame.filter("label = 'a'"), "embedding", "label", "vec_id", QUICK)
    assert one.labels == ["a"] and boosting.probabilities(one, frame, "embedding", "vec_id").first().p == [1.0]
    with pytest.raises(ValueError):
        boosting.fitted(frame.filter("false"), "embedding", "label", "vec_id", QUICK)


def test_folds_by_rank(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(100)] + [(i, None) for i in range(100, 107)]
    got = {r.key: (r.label, r.fold) for r in boosting.folds_by_rank(spark.createDataFrame(rows, "key long, label string").repartition(5), "label", "key", 4).collect()}
    for label in ("a", "b", None):
        own = sorted(k for k, (x, _) in got.items() if x == label)
        assert [got[k][1] for k in own] == [i % 4 for i in range(len(own))]


# --- information -------------------------------------------------------------------


def information_brute(rows, k=5):
    """Every pair of values."""
    psi = lambda n: sum(1 / i for i in range(1, n)) - 0.5772156649015329
    out = {}
    for f in range(max(len(v) for _, v, _ in rows)):
        own = [(v[f], label) for _, v, label in rows if label is not None and len(v) > f and v[f] is not None and not math.isnan(v[f])]
        size = {x: sum(b == x for _, b in own) for x in {b for _, b in own}}
        own = [(v, b) for v, b in own if size[b] > 1]
        if not own:
            continue
        total = np.zeros(3)
        for i, (v, b) in enumerate(own):
            near = sorted(abs(v - w) for j, (w, c) in enumerate(own) if j != i and c == b)
            kk = min(k, size[b] - 1)
            r = near[kk - 1]
            m = sum(abs(v - w) < r or (r == 0 and v == w) for w, _ in own)
            total += (psi(kk), psi(size[b]), psi(m))
        n = len(own)
        out[f] = max(0.0, psi(n) + (total[0] - total[1] - total[2]) / n)
    return out


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_information_equals_pairs(spark, partitions):
    """Runs cross the borders of tasks; zeros, ties, rare labels and gaps."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(150):
        label = ["a", "b", "c"][i % 3] if i < 140 else ("d" if i < 143 else ("e" if i == 143 else None))
        v = [float(i % 3) + rng.normal() * 0.3, 0.0 if i % 2 else rng.random(), round(rng.normal(), 1), 1.0, rng.normal() * 1e-300, -0.0 if i % 5 else 0.0]
        rows.append((i, [None if rng.random() < 0.03 else math.nan if rng.random() < 0.02 else x for x in v][: 6 - i % 2], label))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.feature: r.information for r in information.knn_information(spark.createDataFrame(rows, SCHEMA).repartition(3), "embedding", "label").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = information_brute(rows)
    assert set(got) == set(want) and all(got[f] == pytest.approx(want[f], abs=1e-9) for f in want)
    assert max(got, key=got.get) == 0


def test_information_of_nothing(spark):
    frame = spark.createDataFrame([(1, [1.0], "a"), (2, [2.0], "b")], SCHEMA)
    assert information.knn_information(frame, "embedding", "label").count() == 0
    assert information.knn_information(frame.filter("false"), "embedding", "label").count() == 0


def test_interval_ends_are_the_last_doubles():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=50), [1.0, 0.0, 1e300, 1e-310, 5.0]])
    r = np.concatenate([np.abs(rng.normal(size=50)), [1.0, 2.5, 1e299, 1e-3, 0.0]])
    low, high = information.interval(x, r)
    inside = r > 0
    assert ((x - low)[inside] < r[inside]).all() and ((high - x)[inside] < r[inside]).all()
    with np.errstate(over="ignore"):
        assert ((x - np.nextafter(low, -np.inf))[inside] >= r[inside]).all() and ((np.nextafter(high, np.inf) - x)[inside] >= r[inside]).all()
    assert low[-1] == high[-1] == 5.0


# --- ordination --------------------------------------------------------------------


def singular(x, k=2):
    centred = x - x.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    axes = vt[:k] * np.sign(vt[:k][range(k), abs(vt[:k]).argmax(1)])[:, None]
    return axes, s[:k] ** 2 / (len(x) - 1), centred @ axes.T


def test_ordination_equals_singular_vectors(spark):
    rows = planted(240, 30)
    x = np.array([v for _, v, _ in rows])
    frame = ordination.dense_rows(spark.createDataFrame(rows, SCHEMA).repartition(3), "vec_id", "embedding")
    axes = ordination.fitted(frame, power=12)
    want, variances, points = singular(x)
    assert np.allclose(axes.components, want, atol=1e-6) and np.allclose(axes.mean, x.mean(0)) and np.allclose(axes.variances, variances)
    got = np.array([[r.pc1, r.pc2] for r in ordination.coordinates(frame, axes, "vec_id").orderBy("vec_id").collect()])
    assert np.allclose(got, points, atol=1e-5)


def test_ordination_of_ten_thousand_sparse_features(spark):
    """Two planted directions among 10,000 features, of which a row stores sixty."""
    rng = np.random.default_rng(8)
    n, features = 300, 10_000
    x = np.zeros((n, features))
    for i in range(n):
        x[i, rng.choice(features, 40, replace=False)] = rng.random(40)
        x[i, :10] += 8 * (i % 3 == 0)
        x[i, 10:20] += 5 * (i % 2)
    long = spark.createDataFrame([(int(i), int(f), float(x[i, f])) for i, f in zip(*np.nonzero(x))], "vec_id long, feature int, value double")
    rows = ordination.sparse_rows(long, "vec_id")
    axes = ordination.fitted(rows, features=features)
    want, variances, _ = singular(x)
    assert np.allclose(np.abs((axes.components * want).sum(1)), 1, atol=1e-6) and np.allclose(axes.variances, variances, rtol=1e-6)


def test_ordination_edges(spark):
    rows = [(1, [1.0, None, 3.0]), (2, None), (3, []), (4, [2.0])]
    frame = ordination.dense_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = ordination.coordinates(frame, ordination.fitted(frame), "vec_id").collect()
    assert sorted(r.vec_id for r in got) == [1, 3, 4]
    none = frame.filter("false")
    assert ordination.coordinates(none, ordination.fitted(none), "vec_id").count() == 0


def test_models_of_the_tables(spark, sf_dir):
    """Ten labels that the given vectors don't explain: the model learns them by heart, and no fold's model knows its own rows."""
    labels = {r.vec_id: str(r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    got = {r.vec_id: r.top1 for r in Q.QUERIES["train_predict"](spark, sf_dir).collect()}
    assert sum(got[i] == f"Group {x}" for i, x in labels.items()) > 0.75 * len(labels)
    out = Q.QUERIES["cv_oof"](spark, sf_dir).collect()
    assert {r.vec_id: r.label for r in out} == labels
    hits = sum(r.label == r.predicted_label for r in out)
    assert 0.03 * len(out) < hits < 0.2 * len(out)

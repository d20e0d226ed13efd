"""Multiclass gradient boosting over histograms, all folds and the final model in the same scans.

Features are cut into bins at quantiles, once, and the binned rows are written. A level of all trees of a round - every class of every fold's model, and of
the model over all rows - is one job: tasks sum gradients and Hessians by (model, class, node, feature, bin), the sums of tasks are
added in one grouping, and the best split of each node comes back. So scans depend on rounds and depth, not on the number of folds or classes,
and the driver holds trees only. A row's margins come from the trees since the table was last written (every FLUSH rounds).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import sinks
from . import vectors

#: Rounds after which margins are written with the rows; rows whose histograms are formed at once.
FLUSH, CHUNK = 20, 65_536
#: Ranks of quantiles are right to a part in so many.
SKETCH = 1000
SUMS = "model int, class int, node int, feature int, sums array<double>"
SPLIT = "model int, class int, node int, feature int, bin int, gain double, gl double, hl double, g double, h double"


@dataclass(frozen=True)
class Params:
    """Fixed values by default; a model that is to be trained quickly takes fewer rounds, a greater rate and shallower trees."""

    rounds: int = 900
    patience: int = 40
    floor: int = 120
    depth: int = 6
    rate: float = 0.05
    rows: float = 0.75
    columns: float = 0.55
    least_hessian: float = 5.0
    gamma: float = 0.25
    alpha: float = 0.3
    lam: float = 2.0
    bins: int = 64
    seed: int = 42


@dataclass
class Trees:
    """Complete trees of one round, by (model, class, node): the feature asked (-1: none), the last bin that goes left, leaf values."""

    feature: np.ndarray
    bin: np.ndarray
    leaf: np.ndarray


@dataclass
class Boosted:
    """The model over all rows: class labels in order of their text, cuts by feature, trees by round, and what the folds found."""

    labels: list[str]
    cuts: np.ndarray
    trees: list[Trees]
    rounds: int
    params: Params
    best_rounds: list[int] = field(default_factory=list)
    losses: list[list[float]] = field(default_factory=list)


def folds_by_rank(rows: DataFrame, label: str, key: str, k: int) -> DataFrame:
    """Adds `fold`, dealt in turn within each label in order of key: ranks from a range sort, so no task holds a label.

    A task numbers its rows of each label; the rows of a label in earlier tasks are added from counts by (task, label). Null labels are a group.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, F.col(label).asc_nulls_first(), F.col(key), F.monotonically_increasing_id())
    placed = sinks.written(dealt.withColumn("__task", F.spark_partition_id()), "folds")
    counts = placed.groupBy("__task", F.col(label).alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__task", "__of", (F.sum("__n").over(Window.partitionBy("__of").orderBy("__task")) - F.col("__n")).alias("__before"))  # a row per task and label
    number = F.row_number().over(Window.partitionBy("__task", label).orderBy(key))
    joined = placed.withColumn("__number", number).join(before.withColumnRenamed("__task", "__t"), (F.col("__task") == F.col("__t")) & F.col(label).eqNullSafe(F.col("__of")))
    return joined.select(*rows.columns, F.pmod(F.col("__number") + F.col("__before") - 1, F.lit(k)).cast("int").alias("fold"))


def quantile_cuts(rows: DataFrame, vector: str, bins: int) -> np.ndarray:
    """(features x bins - 1) upper edges of bins, from one approximate quantile sketch per feature; a value falls in the first bin whose edge it doesn't exceed."""
    at = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])
    found = vectors.long_form(rows, F.lit(0).alias("k"), vector).groupBy("feature").agg(F.percentile_approx("value", at, SKETCH).alias("cuts"))
    got = {r.feature: r.cuts for r in found.collect()}  # a row per feature
    out = np.full((max(got, default=-1) + 1, bins - 1), np.inf)
    for f, cuts in got.items():
        if cuts:
            edges = np.unique(cuts)
            out[f, : len(edges)] = edges
    return out


def binned(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Bin numbers; NaN goes to bin 0."""
    out = np.zeros(x.shape, np.uint8 if cuts.shape[1] < 256 else np.uint16)
    for f in range(x.shape[1]):
        out[:, f] = np.searchsorted(cuts[f], x[:, f], "left") * ~np.isnan(x[:, f])
    return out


def walked(bins: np.ndarray, feature: np.ndarray, edge: np.ndarray, levels: int) -> np.ndarray:
    """Node of each row after so many levels of one tree, numbered as in a heap. A node that doesn't split sends all rows left."""
    at = np.zeros(len(bins), np.int64)
    for _ in range(levels):
        f = feature[at]
        right = (f >= 0) & (bins[np.arange(len(bins)), np.maximum(f, 0)] > edge[at])
        at = 2 * at + 1 + right
    return at


def added(margins: np.ndarray, bins: np.ndarray, trees: Sequence[Trees], depth: int) -> np.ndarray:
    """Margins (rows x models x classes) with the leaves of the trees."""
    out = margins.copy()
    first = 2**depth - 1
    for t in trees:
        for m in range(out.shape[1]):
            for c in range(out.shape[2]):
                if t.leaf[m, c].any():
                    out[:, m, c] += t.leaf[m, c][walked(bins, t.feature[m, c], t.bin[m, c], depth) - first]
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def gradients(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the soft-max loss by margin: rows x models x classes."""
    p = softmax(margins)
    hit = np.arange(margins.shape[-1])[None, None, :] == y[:, None, None]
    w = weight[:, None, None]
    return (p - hit) * w, np.maximum(2 * p * (1 - p), 1e-16) * w


def drawn(hashes: np.ndarray, seed: int, share: float) -> np.ndarray:
    """The rows of a round: the same share of any rows, the same when a task runs again."""
    z = hashes.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) < share * 2.0**53


def score(g: np.ndarray, h: np.ndarray, p: Params) -> np.ndarray:
    t = np.sign(g) * np.maximum(np.abs(g) - p.alpha, 0)
    return t * t / (h + p.lam)


def leaf_value(g: float, h: float, p: Params) -> float:
    return -p.rate * math.copysign(max(abs(g) - p.alpha, 0.0), g) / (h + p.lam)


def best_splits(sums: np.ndarray, p: Params) -> tuple[np.ndarray, ...]:
    """For rows of (gradients by bin, Hessians by bin): best bin, its gain, and left and whole sums."""
    n = sums.shape[1] // 2
    gl, hl = np.cumsum(sums[:, :n], axis=1), np.cumsum(sums[:, n:], axis=1)
    g, h = gl[:, -1:], hl[:, -1:]
    gain = 0.5 * (score(gl, hl, p) + score(g - gl, h - hl, p) - score(g, h, p)) - p.gamma
    gain[(hl < p.least_hessian) | (h - hl < p.least_hessian)] = -np.inf
    at = np.argmax(gain, axis=1)
    pick = np.arange(len(sums)), at
    return at, gain[pick], gl[pick], hl[pick], g[:, 0], h[:, 0]


def histograms(bins: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, n_nodes: int, n_bins: int) -> np.ndarray:
    """(nodes x features x 2 n_bins): gradients by bin, then Hessians."""
    n, f = bins.shape
    cell = ((node[:, None] * f + np.arange(f)[None, :]) * n_bins + bins).ravel()
    size = n_nodes * f * n_bins
    out = [np.bincount(cell, np.repeat(v, f), size).reshape(n_nodes, f, n_bins) for v in (g, h)]
    return np.concatenate(out, axis=2)


class Trainer:
    """Rows with bins and margins in a written table, and the trees since it was written. Model k is the one over all rows."""

    def __init__(self, rows: DataFrame, vector: str, label: str, key: str, k: int, params: Params):
        usable = rows.filter(F.col(label).isNotNull() & F.col(vector).isNotNull())
        counts = usable.groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()  # a row per class
        if not counts:
            raise ValueError("no rows with a label")
        self.labels = [r.label for r in counts]
        total = sum(r.n for r in counts)
        weight = F.create_map(*[x for r in counts for x in (F.lit(r.label), F.lit(total / (len(counts) * r.n)))])
        number = F.create_map(*[x for i, r in enumerate(counts) for x in (F.lit(r.label), F.lit(i))])
        name = F.col(label).cast("string")
        self.params, self.k, self.key = params, k, key
        x = F.transform(vector, lambda v: v.cast("double"))
        table = usable.select(F.col(key).alias("key"), number[name].alias("y"), weight[name].alias("w"), F.xxhash64(key).alias("hash"), x.alias("x"))
        table = folds_by_rank(table, "y", "key", k) if k else table.withColumn("fold", F.lit(-1))
        self.cuts = quantile_cuts(table, "x", params.bins)
        self.models, self.classes, self.features = k + 1, len(counts), len(self.cuts)
        self.trees: list[Trees] = []
        self.fresh: list[Trees] = []
        self.table = sinks.written(self._with_bins(table), "boosting")
        self.random = np.random.default_rng(params.seed)

    def _with_bins(self, table: DataFrame) -> DataFrame:
        cuts, features, cells = self.cuts, self.features, self.models * self.classes

        def run(batches):
            import pyarrow as pa

            for b in batches:
                values = b.column(b.schema.get_field_index("x")).to_pylist()
                x = np.array([[np.nan if v is None else v for v in [*r, *[None] * (features - len(r))]] for r in values], np.float64).reshape(len(values), features)
                packed = binned(x, cuts)
                columns = [b.column(b.schema.get_field_index(c)) for c in ("key", "y", "w", "hash", "fold")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([r.tobytes() for r in packed], pa.binary()), pa.array([bytes(8 * cells)] * len(values), pa.binary())], names=["key", "y", "w", "hash", "fold", "bins", "margins"])

        kind = table.schema["key"].dataType.simpleString()
        return table.mapInArrow(run, f"key {kind}, y int, w double, hash long, fold int, bins binary, margins binary")

    def _rows(self):
        """A function from Arrow batches to chunks of (key, y, w, hash, fold, bins, margins with all trees so far)."""
        features, shape, fresh, depth = self.features, (self.models, self.classes), list(self.fresh), self.params.depth
        kind = np.uint8 if self.cuts.shape[1] < 256 else np.uint16

        def chunks(batches):
            for b in batches:
                for at in range(0, b.num_rows, CHUNK):
                    s = b.slice(at, CHUNK)
                    col = lambda c: s.column(s.schema.get_field_index(c))  # noqa: E731,B023
                    bins = np.frombuffer(b"".join(col("bins").to_pylist()), kind).reshape(s.num_rows, features)
                    margins = np.frombuffer(b"".join(col("margins").to_pylist()), np.float64).reshape(s.num_rows, *shape)
                    yield col("key"), *(col(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "hash", "fold")), bins, added(margins, bins, fresh, depth)

        return chunks

    def level(self, grown: Trees, depth: int, active: np.ndarray, sampled: np.ndarray, round_: int) -> tuple[dict, np.ndarray]:
        """Best split of each open node of a level, and (loss sum, rows) of each fold's model on its fold before this round."""
        chunks, p, models, classes = self._rows(), self.params, self.models, self.classes
        n_nodes, first, n_bins, seed = 2**depth, 2**depth - 1, self.cuts.shape[1] + 1, p.seed + round_

        def partial(batches):
            import pyarrow as pa

            sums, loss = {}, np.zeros((models, 2))
            for _, y, w, hashes, fold, bins, margins in chunks(batches):
                g, h = gradients(margins, y, w)
                if depth == 0:
                    own = np.flatnonzero((fold >= 0) & (fold < models - 1))
                    lost = -np.log(np.maximum(softmax(margins[own, fold[own]])[np.arange(len(own)), y[own]], 1e-15))
                    loss[:, 0] += np.bincount(fold[own], lost, models)
                    loss[:, 1] += np.bincount(fold[own], minlength=models)
                chosen = drawn(hashes, seed, p.rows)
                for m in np.flatnonzero(active):
                    rows = np.flatnonzero(chosen & (fold != m))
                    for c in range(classes):
                        columns = np.flatnonzero(sampled[m, c])
                        node = walked(bins[rows], grown.feature[m, c], grown.bin[m, c], depth) - first
                        found = histograms(bins[np.ix_(rows, columns)], node, g[rows, m, c], h[rows, m, c], n_nodes, n_bins)
                        sums[m, c] = found if (m, c) not in sums else sums[m, c] + found
            for (m, c), found in sums.items():
                columns = np.flatnonzero(sampled[m, c])
                for node in range(n_nodes):
                    if depth and grown.feature[m, c, (first + node - 1) // 2] < 0:
                        continue
                    flat = found[node]
                    n = len(columns)
                    const = lambda v: pa.array(np.full(n, v, np.int32))  # noqa: E731,B023
                    yield pa.RecordBatch.from_arrays([const(m), const(c), const(node), pa.array(columns.astype(np.int32)), lists(flat)], names=["model", "class", "node", "feature", "sums"])
            if depth == 0:
                wide = np.zeros((models, 2 * n_bins))
                wide[:, :2] = loss
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(models, dtype=np.int32)), *[pa.array(np.full(models, -1, np.int32))] * 3, lists(wide)], names=["model", "class", "node", "feature", "sums"])

        def choose(batches):
            import pyarrow as pa

            for b in batches:
                if not b.num_rows:
                    continue
                sums = b.column(4).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                ends = best_splits(sums, p)
                lost = b.column(1).to_numpy() < 0
                gl, hl = np.where(lost, sums[:, 0], ends[2]), np.where(lost, sums[:, 1], ends[3])
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ends[0].astype(np.int32)), *[pa.array(v) for v in (ends[1], gl, hl, ends[4], ends[5])]], names=["model", "class", "node", "feature", "bin", "gain", "gl", "hl", "g", "h"])

        parts = self.table.mapInArrow(partial, SUMS).groupBy("model", "class", "node", "feature").agg(Summarizer.sum(array_to_vector("sums")).alias("sums"))
        splits = parts.withColumn("sums", vector_to_array("sums")).mapInArrow(choose, SPLIT)
        best = splits.groupBy("model", "class", "node").agg(F.max_by(F.struct("feature", "bin", "gain", "gl", "hl", "g", "h"), F.struct("gain", -F.col("feature"))).alias("s"))
        rows = best.collect()  # a row per open node
        losses = np.full((models, 2), np.nan)
        for r in rows:
            if r["class"] < 0:
                losses[r.model] = r.s.gl, r.s.hl
        return {(r.model, r["class"], r.node): r.s for r in rows if r["class"] >= 0}, losses

    def round(self, active: np.ndarray) -> np.ndarray:
        """Grows one tree per active model and class; returns the losses before it."""
        p, inner = self.params, 2**self.params.depth - 1
        grown = Trees(np.full((self.models, self.classes, inner), -1), np.zeros((self.models, self.classes, inner), np.int64), np.zeros((self.models, self.classes, inner + 1)))
        keep = max(1, int(p.columns * self.features))
        sampled = np.zeros((self.models, self.classes, self.features), bool)
        for m in range(self.models):
            for c in range(self.classes):
                sampled[m, c, self.random.permutation(self.features)[:keep]] = True
        losses = None
        for depth in range(p.depth):
            found, lost = self.level(grown, depth, active, sampled, len(self.trees))
            losses = lost if depth == 0 else losses
            for (m, c, node), s in found.items():
                at, span = 2**depth - 1 + node, 2 ** (p.depth - depth)
                leaves = grown.leaf[m, c, node * span : (node + 1) * span]
                if s.gain > 0:
                    grown.feature[m, c, at], grown.bin[m, c, at] = s.feature, s.bin
                    leaves[: span // 2], leaves[span // 2 :] = leaf_value(s.gl, s.hl, p), leaf_value(s.g - s.gl, s.h - s.hl, p)
                else:
                    leaves[:] = leaf_value(s.g, s.h, p)
            if not found:
                break
        self.trees.append(grown)
        self.fresh.append(grown)
        if len(self.fresh) >= FLUSH:
            self.flush()
        return losses

    def flush(self) -> None:
        """Margins with all trees so far are written beside the rows."""
        chunks, names = self._rows(), self.table.columns

        def run(batches):
            import pyarrow as pa

            for key, y, w, hashes, fold, bins, margins in chunks(batches):
                flat = [r.tobytes() for r in np.ascontiguousarray(margins)]
                yield pa.RecordBatch.from_arrays([key, pa.array(y, pa.int32()), pa.array(w), pa.array(hashes, pa.int64()), pa.array(fold, pa.int32()), pa.array([r.tobytes() for r in bins], pa.binary()), pa.array(flat, pa.binary())], names=names)

        self.table = sinks.written(self.table.mapInArrow(run, self.table.schema), "boosting")
        self.fresh = []

    def train(self) -> Boosted:
        """Rounds until every fold has gone `patience` rounds without a better loss, then the model over all rows alone up to the median of their best rounds."""
        p, losses = self.params, []
        active = np.ones(self.models, bool)
        best, least = np.zeros(self.k, np.int64), np.full(self.k, np.inf)
        wanted = p.rounds if not self.k else None
        while len(self.trees) < (p.rounds if wanted is None else wanted):
            found = self.round(active)
            lost = found[: self.k, 0] / np.maximum(found[: self.k, 1], 1)
            losses.append(lost.tolist())
            at = len(self.trees) - 1  # rounds that these losses have seen
            better = active[: self.k] & (lost < least)
            best[better], least[better] = at, lost[better]
            active[: self.k] &= at - best < p.patience
            if self.k and wanted is None and not active[: self.k].any():
                wanted = self.final_rounds(best)
        if self.k:
            if active[: self.k].any():  # the last round's losses
                last = self.losses()
                losses.append(last.tolist())
                better = active[: self.k] & (last < least)
                best[better] = len(self.trees)
            wanted = min(self.final_rounds(best), len(self.trees))
        return Boosted(self.labels, self.cuts, [self.only(t, self.k) for t in self.trees[:wanted]], wanted, p, np.maximum(best, 1).tolist(), losses)

    def final_rounds(self, best: np.ndarray) -> int:
        """Median of the best rounds, rounded down, `floor` at least, no more than `rounds`."""
        return min(self.params.rounds, max(self.params.floor, int(np.median(np.maximum(best, 1)))))

    def losses(self) -> np.ndarray:
        log_p = F.log(F.greatest(F.get("p", F.col("y")), F.lit(1e-15)))
        rows = self.out_of_fold([len(self.trees)] * self.k).groupBy("fold").agg(F.avg(-log_p).alias("loss")).collect()  # a row per fold
        out = np.full(self.k, np.inf)
        for r in rows:
            out[r.fold] = r.loss
        return out

    def out_of_fold(self, rounds: Sequence[int]) -> DataFrame:
        """(key, y, fold, p): probabilities from the model that did not see the row, with the first `rounds` of its trees."""
        chunks, classes, depth = self._rows(), self.classes, self.params.depth
        own = [[self.only(t, m) for t in self.trees[:n]] for m, n in enumerate(rounds)]

        def run(batches):
            import pyarrow as pa

            for key, y, _, _, fold, bins, _ in chunks(batches):
                p = np.zeros((len(y), classes))
                for m, trees in enumerate(own):
                    rows = np.flatnonzero(fold == m)
                    p[rows] = softmax(added(np.zeros((len(rows), 1, classes)), bins[rows], trees, depth)[:, 0])
                yield pa.RecordBatch.from_arrays([key, pa.array(y, pa.int32()), pa.array(fold, pa.int32()), lists(p)], names=["key", "y", "fold", "p"])

        return self.table.mapInArrow(run, f"key {self.table.schema['key'].dataType.simpleString()}, y int, fold int, p array<double>")

    def only(self, t: Trees, m: int) -> Trees:
        return Trees(t.feature[m : m + 1], t.bin[m : m + 1], t.leaf[m : m + 1])


def lists(values: np.ndarray):
    """Rows of a matrix as an Arrow list column."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, max(1, values.shape[1]), dtype=np.int32)[: len(values) + 1]), pa.array(np.ascontiguousarray(values).ravel()))


def fitted(rows: DataFrame, vector: str, label: str, key: str, params: Params = Params(), k: int = 0) -> Boosted:
    """The model over all rows. With k folds its number of rounds is the median of theirs, else `params.rounds`. Rows without label or vector are left out."""
    return Trainer(rows, vector, label, key, k, params).train()


def probabilities(model: Boosted, rows: DataFrame, vector: str, key: str) -> DataFrame:
    """(key, probabilities by class). Features beyond a vector's end count as missing and fall in the first bin."""
    cuts, trees, depth, shape = model.cuts, model.trees, model.params.depth, (1, len(model.labels))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            values = b.column(1).to_pylist()
            x = np.array([[np.nan if v is None else v for v in [*(r or [])[: len(cuts)], *[None] * (len(cuts) - len(r or []))]] for r in values], np.float64).reshape(len(values), len(cuts))
            p = softmax(added(np.zeros((len(values), *shape)), binned(x, cuts), trees, depth)[:, 0])
            yield pa.RecordBatch.from_arrays([b.column(0), lists(p)], names=["key", "p"])

    kind = rows.schema[key].dataType.simpleString()
    plain = rows.select(F.col(key).alias("key"), F.transform(vector, lambda v: v.cast("double")).alias("x"))
    return plain.mapInArrow(run, f"key {kind}, p array<double>").withColumnRenamed("key", key)


def predictions(model: Boosted, rows: DataFrame, vector: str, key: str, names: dict[str, str] | None = None) -> DataFrame:
    """Three most probable classes of each row with display names, and the number of the first (the least of equals)."""
    shown = F.array(*[F.lit(vectors.class_name(x, names)) for x in model.labels])
    found = probabilities(model, rows, vector, key)
    return found.select(key, vectors.top_classes(shown, F.col("p")).alias("top"), (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("predicted"))


def cross_validated(rows: DataFrame, vector: str, label: str, key: str, params: Params = Params(), k: int = 5) -> tuple[DataFrame, Boosted]:
    """(key, label, predicted_label) out of fold, and the final model; all k + 1 models share every scan."""
    trainer = Trainer(rows, vector, label, key, k, replace(params))
    model = trainer.train()
    names = F.array(*[F.lit(x) for x in trainer.labels])
    guess = F.get(names, (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    return trainer.out_of_fold(model.best_rounds).select(F.col("key").alias(key), F.get(names, F.col("y")).alias("label"), guess.alias("predicted_label")), model


def importance(model: Boosted) -> list[float]:
    """Share of splits that ask each feature."""
    asked = np.concatenate([t.feature.ravel() for t in model.trees]) if model.trees else np.zeros(0, np.int64)
    n = np.bincount(asked[asked >= 0], minlength=len(model.cuts)).astype(float)
    return (n / max(1.0, n.sum())).tolist()

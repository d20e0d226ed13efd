"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators propose spans with high recall: the four base patterns whatever their checks say, and looser
forms (spelled-out e-mail addresses, local telephone numbers, credentials). Spans of different
generators may overlap. Each candidate gets a few small features of its format and context. Weak labels come from what isn't
among the features: a check of its kind (Luhn sum, number ranges, number of digits, letters in the last part of a
domain, mixture of characters in a credential), agreement with a base span of the same kind or of another, a cue
word before it (telephone, server, ...) or a word that speaks against it (order, version, ISBN, ...).
Candidates without such evidence have no label, but get a score like all others. Candidates with equal features are alike for
the trees, so one aggregate over all documents gives the whole training set as counts (at most the
product of the features' sizes), boosted trees are fitted to these, and a threshold for each kind is
calibrated on a held-out fold: the lowest score from which enough labelled candidates are right; a kind without such a score
adds nothing. The trees become one column expression. Base spans always stay; further candidates are
selected from the greatest score down if they reach their kind's threshold and overlap no base span and none selected before.

Candidates are made once and written with their documents; fitting reads only them.

No Python runs on the executors. Patterns are possessive where that changes nothing, so long runs of
digits or letters cost linear time and no recursion.

Edge cases: null text counts as empty and has no spans. Positions are code points, the end exclusive.
Long texts are searched whole. Repeated rows give repeated results. An empty table gives an empty result,
and a corpus without labelled candidates selects no further spans. `redact` carries other columns through.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "token")
BASE_KINDS = KINDS[:4]
#: A character that no pattern matches or excludes; marks the borders of matches.
MARK, STAND_IN = "", ""
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "token": r"(?i)(?<![a-z])(?:token|secret|passwd|password|api[_-]?key)\x20?[:=]\x20?[\"']?[A-Za-z0-9_./+=-]{6,}+[\"']?",
}
#: What a text must have for a pattern to match at all: characters to look for, or a cheap pattern.
NEEDS = {("email", 0): ("@",), ("phone", 0): ("+",), ("email", 1): ("t]", "t)", "T]", "T)"), ("token", 1): (":", "="), ("ip", 0): r"[0-9]\.[0-9]", ("card", 0): r"[0-9][\x20-]?[0-9]", ("phone", 1): r"[0-9][\x20.-][0-9]"}
#: Words before a span that speak for its kind, and words right before it that speak against any.
CUES = {"card": r"(?i)(?:card|visa|carte|karte|tarjeta)", "phone": r"(?i)(?:phone|\btel|call|fax|mobil)", "email": r"(?i)(?:mail|contact)", "ip": r"(?i)(?:\bip\b|host|server|addr)"}
AGAINST = r"(?i)(?:order|invoice|isbn|issn|version|build|serial|sku|part|item|page|fig|vol|ref|lot)\.?\x20?(?:no|nr|num|number|id)?\.?\x20?[:#=]?\x20?#?$"
DIGIT_EDGES, LENGTH_EDGES = (1, 7, 9, 13, 16, 17, 20), (8, 12, 16, 20, 28)
FEATURES = ("kind", "loose", "digits", "length", "separators", "left", "right", "near")
ROUNDS, RATE, FOLDS, PRECISION = 24, 0.4, 4, 0.95
#: Deviations of the lower bound of a precision.
CONFIDENCE = 1.0
BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` evaluated once, whatever the optimizer does with projections."""
    return F.element_at(F.transform(F.array(value), body), 1)


def may_match(text: Column, kind: str, loose: int) -> Column:
    needs = NEEDS[kind, loose]
    if isinstance(needs, str):
        return text.rlike(needs)
    out = F.contains(text, F.lit(needs[0]))
    for n in needs[1:]:
        out = out | F.contains(text, F.lit(n))
    return out


def matches(text: Column, pattern: str, possible: Column) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, value, left, right), with up to 24 characters of context.

    Texts that can't match (`possible`) aren't searched: most texts of a corpus pass at the price of a look for a character.
    """
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK)

    def total(lengths: Column) -> Column:
        return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)

    def place(s: Column) -> Column:
        def one(i: Column) -> Column:  # i: 0-based index of the match's part
            block = F.floor(i / BLOCK).cast("int")
            start = F.get(s["bases"], block) + total(F.slice(s["lengths"], block * BLOCK + 1, i % BLOCK))
            return F.struct(
                start.alias("start"), (start + F.get(s["lengths"], i)).alias("end"), F.get(s["parts"], i).alias("value"),
                F.substring(F.get(s["parts"], i - 1), -24, 24).alias("left"), F.substring(F.get(s["parts"], i + 1), 1, 1).alias("right"),
            )

        return F.transform(F.sequence(F.lit(1), F.size(s["parts"]) - 2, F.lit(2)), one)

    def with_bases(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s["lengths"]) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(s["lengths"], b * BLOCK + 1, BLOCK)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        bases = F.aggregate(blocks, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])
        return let(F.struct(s["parts"].alias("parts"), s["lengths"].alias("lengths"), bases.alias("bases")), place)

    def found(p: Column) -> Column:
        return F.when(F.size(p) > 1, let(F.struct(p.alias("parts"), F.transform(p, F.length).alias("lengths")), with_bases)).otherwise(none)

    none = F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>")
    return F.when(possible, let(parts, found)).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    if kind == "card":
        return F.when(n.between(13, 19), F.call_function("luhn_check", digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    if kind == "token":
        return (F.length(value) >= 20) & (n >= 3)
    return F.lit(True)


def binned(x: Column, edges: tuple[int, ...]) -> Column:
    return sum(((x >= e).cast("int") for e in edges), F.lit(0))


def side(char: Column) -> Column:
    """0 nothing or blank, 1 letter or digit, 2 bracket or quote, 3 sign of a field or a number, 4 other."""
    return (
        F.when((F.length(char) == 0) | char.rlike(r"^\s"), 0).when(char.rlike(r"^[\p{L}\p{N}]"), 1)
        .when(char.rlike(r"^[\[(<{\"'\])>}]"), 2).when(char.rlike(r"^[#=:/_&@$%*|-]"), 3).otherwise(4)
    )


def evidence(kind: str, loose: bool, m: Column) -> Column:
    """Weak label by the candidate alone: 1, 0, or -1 for none."""
    value = m["value"]
    if kind == "token":
        bare = F.regexp_replace(value, r"^[^:=]*[:=]\x20?[\"']?|[\"']$", "")
        distinct = F.size(F.array_distinct(F.split(bare, "")))
        own = F.when(bare.rlike("[0-9]") & bare.rlike("[A-Za-z]") & (distinct >= 9), 1).when(bare.rlike("^[A-Za-z]+$") | (distinct <= 4), 0).otherwise(-1)
    elif loose:
        own = F.when(m["left"].rlike(CUES[kind]), 1).otherwise(-1)
    elif kind == "email":
        own = value.rlike(r"\.[A-Za-z]{2,}$").cast("int")
    else:
        own = valid(kind, value).cast("int")
    return F.when(m["left"].rlike(AGAINST), 0).otherwise(own)


def candidate(kind: str, loose: bool) -> Callable[[Column], Column]:
    k = KINDS.index(kind)

    def make(m: Column) -> Column:
        value = m["value"]
        marks = F.regexp_replace(value, "[A-Za-z0-9]", "")
        base = valid(kind, value) if kind in BASE_KINDS and not loose else F.lit(False)
        return F.struct(
            m["start"].alias("start"), m["end"].alias("end"), F.lit(k).alias("kind"), F.lit(int(loose)).alias("loose"),
            binned(F.length(digits(value)), DIGIT_EDGES).alias("digits"), binned(F.length(value), LENGTH_EDGES).alias("length"),
            F.when(F.length(marks) == 0, 0).when(F.length(F.array_join(F.array_distinct(F.split(marks, "")), "")) == 1, 1).otherwise(2).alias("separators"),
            side(F.substring(m["left"], -1, 1)).alias("left"), side(m["right"]).alias("right"), m["left"].rlike("[0-9]").cast("int").alias("near"),
            evidence(kind, loose, m).alias("label"), base.alias("base"),
        )

    return make


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


#: Spans whose overlaps are decided in one go; longer lists go block by block.
SPANS = 128


def clusters(spans: Column) -> Column:
    """Arrays of spans that overlap, directly or through others, in order of place: one pass, so a text may hold any number of spans.

    Where clusters begin is found in blocks; a state that grew with every span would be copied with every span.
    """
    n = lambda s: F.size(s)
    ints = F.array().cast("array<int>")

    def step(state: Column, s: Column) -> Column:
        begins = F.when(s["start"] >= state["far"], F.concat(state["out"], F.array(state["at"]))).otherwise(state["out"])
        return F.struct(F.greatest(state["far"], s["end"]).alias("far"), (state["at"] + 1).alias("at"), begins.alias("out"))

    def block(s: Column):
        def one(acc: Column, k: Column) -> Column:
            inner = F.aggregate(F.slice(s, k * SPANS + 1, F.lit(SPANS)), F.struct(acc["far"].alias("far"), (k * SPANS).alias("at"), ints.alias("out")), step)
            return let(inner, lambda x: F.struct(x["far"].alias("far"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

        return one

    def cut(s: Column) -> Column:
        found = F.aggregate(F.sequence(F.lit(0), F.floor((F.greatest(n(s), F.lit(1)) - 1) / SPANS).cast("int")), F.struct(F.lit(-1).alias("far"), F.array().cast("array<array<int>>").alias("out")), block(s))
        return let(F.flatten(found["out"]), lambda b: F.transform(b, lambda at, i: F.slice(s, at + 1, F.coalesce(F.get(b, i + 1), n(s)) - at)))

    placed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s.alias("span"))))
    return F.transform(let(placed, cut), lambda c: F.transform(c, lambda x: x["span"]))


def candidates(text: Column) -> Column:
    """Array of candidate spans of `text` (a column without nulls), in order of kind."""
    clean = F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, STAND_IN)).otherwise(text)
    strict, loose = [], []
    for kind in KINDS:
        if kind in PATTERNS:
            found = matches(clean, PATTERNS[kind], may_match(text, kind, 0))
            if kind == "card":
                found = F.filter(found, lambda m: F.length(digits(m["value"])).between(12, 20))
            strict.append(F.transform(found, candidate(kind, False)))
        if kind in LOOSE:
            loose.append(F.transform(matches(clean, LOOSE[kind], may_match(text, kind, 1)), candidate(kind, True)))

    def agreed(s: Column) -> Column:
        """A cluster with labels of its loose candidates from the base spans that they overlap."""
        base = F.filter(s, lambda b: b["base"])

        def one(c: Column) -> Column:
            met = F.filter(base, lambda b: overlaps(b, c))
            label = F.when(F.exists(met, lambda b: b["kind"] == c["kind"]), 1).when(F.size(met) > 0, 0).otherwise(c["label"])
            return F.when(c["loose"] == 1, c.withField("label", F.when(c["label"] == 0, 0).otherwise(label))).otherwise(c)

        return F.when(F.size(base) > 0, F.transform(s, one)).otherwise(s)

    return F.flatten(F.transform(clusters(F.concat(*strict, *loose)), agreed))


# --- boosted trees over counts -------------------------------------------------


def fit_trees(x: np.ndarray, pos: np.ndarray, neg: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, list]:
    """Boosted trees of depth 2 for the logistic loss. x: a row per distinct feature vector, with its counts.

    A tree is (feature, edge, left, right); the left side has values up to the edge; leaves are numbers.
    """
    total = pos + neg
    bias = math.log((pos.sum() + 1) / (neg.sum() + 1))
    score, trees = np.full(len(x), bias), []

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray):
        top, cut = 1e-6, None
        for j in range(x.shape[1]):
            for edge in np.unique(x[rows, j])[:-1]:
                low = rows & (x[:, j] <= edge)
                high = rows & ~low
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (low, high)) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                if gain > top:
                    top, cut = gain, (j, int(edge), low, high)
        return cut

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        cut = best(rows, g, h) if depth else None
        if cut is None:
            value = rate * g[rows].sum() / (h[rows].sum() + 1)
            score[rows] += value
            return float(value)
        j, edge, low, high = cut
        return (j, edge, grow(low, g, h, depth - 1), grow(high, g, h, depth - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(np.ones(len(x), bool), pos - total * p, total * p * (1 - p), 2))
    return bias, trees


def predict(model: tuple[float, list], x: np.ndarray) -> np.ndarray:
    def walk(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    return np.array([1 / (1 + math.exp(-(model[0] + sum(walk(t, r) for t in model[1])))) for r in x])


def score_column(model: tuple[float, list], c: Column) -> Column:
    def walk(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        return F.when(c[FEATURES[tree[0]]] <= tree[1], walk(tree[2])).otherwise(walk(tree[3]))

    return F.lit(1.0) / (F.lit(1.0) + F.exp(-sum((walk(t) for t in model[1]), F.lit(model[0]))))


def lower_bound(hit: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Lower end of Wilson's interval for a share of `hit` in `n`, CONFIDENCE deviations wide."""
    z = CONFIDENCE
    n = np.maximum(n, 1e-9)
    p = hit / n
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def fit(found: DataFrame, id_col: str) -> tuple[tuple[float, list] | None, dict[int, float]]:
    """Model and thresholds by kind (none: nothing more is selected for it), from the `candidates` of all documents.

    Thresholds are cross-fitted: every candidate is scored by a model that didn't see its fold, so a kind is calibrated on all it has. A
    threshold is the least score above which the lower bound of precision is PRECISION, and PRECISION itself at least. The model that selects has seen all.
    """
    rows = found.select(common.fold(F.col(id_col), FOLDS).alias("fold"), F.explode("candidates").alias("c")).filter("c.label >= 0")
    counts = rows.groupBy("fold", *[F.col(f"c.{f}").alias(f) for f in FEATURES]).agg(F.sum("c.label").alias("pos"), F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return None, {}
    x = np.array([[r[f] for f in FEATURES] for r in counts])
    pos, n, fold = (np.array(v, float) for v in zip(*[(r["pos"], r["n"], r["fold"]) for r in counts]))
    p = np.zeros(len(x))
    for f in np.unique(fold):
        own, rest = fold == f, fold != f
        p[own] = predict(fit_trees(x[rest], pos[rest], (n - pos)[rest]), x[own]) if rest.any() else 0.0
    thresholds: dict[int, float] = {}
    for kind in np.unique(x[:, 0]):
        at = x[:, 0] == kind
        order = np.argsort(-p[at], kind="stable")
        score = p[at][order]
        good = np.flatnonzero((lower_bound(np.cumsum(pos[at][order]), np.cumsum(n[at][order])) >= PRECISION) & (np.append(np.diff(score), -1) < 0))
        if len(good):
            thresholds[int(kind)] = float(max(PRECISION, score[good[-1]]))
    return fit_trees(x, pos, n - pos), thresholds


# --- selection ------------------------------------------------------------------


def selected(model, thresholds: dict[int, float]) -> Column:
    """From a column `candidates`: array of (kind, start, end, base), by kind, then start."""
    cands = F.col("candidates")
    span = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"))
    base = F.transform(F.filter(cands, lambda c: c["base"]), span)
    if model is None or not thresholds:
        return F.array_sort(base)
    enough = lambda c, score: F.coalesce(*[F.when(c["kind"] == k, score >= t) for k, t in thresholds.items()], F.lit(False))
    able = F.transform(cands, lambda c: F.struct(F.when(c["base"], float("-inf")).otherwise(-score_column(model, c)).alias("less"), span(c).alias("span")))
    able = F.filter(able, lambda x: x["span"]["base"] | enough(x["span"], -x["less"]))

    def best(cluster: Column) -> Column:
        """Base spans, then others by falling score where they overlap nothing that is kept."""
        first = F.filter(cluster, lambda x: x["base"])
        others = F.array_sort(F.transform(F.filter(cluster, lambda x: ~x["base"]), lambda x: F.struct(x["less"].alias("less"), x["span"].alias("span"))))
        return F.aggregate(others, F.transform(first, lambda x: x["span"]), lambda acc, x: F.when(F.exists(acc, lambda b: overlaps(b, x["span"])), acc).otherwise(F.concat(acc, F.array(x["span"]))))

    flat = F.transform(able, lambda x: F.struct(x["span"]["start"].alias("start"), x["span"]["end"].alias("end"), x["span"]["kind"].alias("kind"), x["span"]["base"].alias("base"), x["less"].alias("less"), x["span"].alias("span")))
    return F.array_sort(F.flatten(F.transform(clusters(flat), best)))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds `spans`, an array of (kind, start, end, base), to the rows of `docs` (to their columns in `keep`, if given)."""
    names = docs.columns if keep is None else keep
    # under a name of their own, whatever the columns of `docs` are called
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(id_col).alias("id"), candidates(common.text_or_empty(text_col)).alias("candidates"))
    found = common.spill(held, "candidates")
    model, thresholds = fit(found, "id")
    return found.select(*[F.col("row")[c].alias(c) for c in names], selected(model, thresholds).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by <KIND>; spans that overlap become one, named by the first."""
    size = 4096
    def between(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / size).cast("int")
        return F.substring(F.array_join(F.slice(blocks, first + 1, F.floor(end / size).cast("int") - first + 1), ""), start - first * size + 1, end - start)

    def build(s: Column) -> Column:
        names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
        end_before = lambda i: F.when(i > 0, F.get(s["spans"], i - 1)["end"]).otherwise(0)
        piece = lambda i: F.concat(between(s["blocks"], end_before(i), F.get(s["spans"], i)["start"]), F.get(names, F.get(s["spans"], i)["kind"]))
        tail = between(s["blocks"], F.element_at(s["spans"], -1)["end"], s["n"])
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.size(s["spans"]) - 1), piece), ""), tail)

    n = F.length(text)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(n / size).cast("int")), lambda b: F.substring(text, b * size + 1, F.lit(size)))
    merged = F.transform(clusters(spans), lambda c: F.struct(F.get(c, F.lit(0))["start"].alias("start"), F.array_max(F.transform(c, lambda x: x["end"])).alias("end"), F.get(c, F.lit(0))["kind"].alias("kind")))
    return F.when(F.size(spans) > 0, let(F.struct(blocks.alias("blocks"), merged.alias("spans"), n.alias("n")), build)).otherwise(text)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of `docs` with selected spans redacted; `length_col`, if there, is counted anew. Null texts stay null."""
    names = docs.columns
    found = find_spans(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__id", "__text")
    done = found.select("__row", F.when(F.col("__text").isNotNull(), redacted(F.col("__text"), F.col("spans"))).alias("__text"))
    out = []
    for c in names:
        col = F.col("__row")[c]
        if c == text_col:
            col = F.col("__text")
        elif c == length_col:
            col = F.length("__text").cast(docs.schema[c].dataType)
        out.append(col.alias(c))
    return done.select(*out)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # only ids are written beside the candidates
    found = find_spans(common.documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"]).select("doc_id", "spans")
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))

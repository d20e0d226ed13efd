"""Document quality by weak supervision.

Each rule votes good, bad or abstains on a document. Documents with the same votes are alike for the
model, so one aggregate reduces the whole corpus to a table of vote patterns (at most 3^rules rows,
whatever the corpus size), and expectation-maximisation over that table estimates every rule's
accuracy and the share of good documents. The posterior probability of each pattern then replaces
"all rules must pass".

Edge cases: a null or empty text has no words: all counts are zero and it fails the base rule.
Texts of any length are read whole, one at a time. Repeated rows are scored alike. An empty table
gives an empty result. Other columns are carried through by `filter_quality`, whatever their names.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_alpha", "n_ended", "longest_run")
RULES = ("length", "symbols", "dup_lines", "repeats", "variety", "shouting", "line_ends", "runs", "word_length")
#: Posterior of the good class from which a document is kept.
KEEP_FROM = 0.5
EM_ROUNDS = 200
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def text_counts(data: bytes) -> tuple[int, ...]:
    """COUNTS of one text in UTF-8. bytes.split() cuts at exactly the six ASCII separators."""
    words = data.split()
    n = len(words)
    if not n:
        return (0,) * len(COUNTS)
    joined = b"".join(words)
    # continuation bytes are 0x80-0xBF
    word_chars = len(joined.decode("utf-8", "replace"))
    n_symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    n_dup_lines = len(lines) - len(set(lines))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    m = len(number)
    repeated = 0
    if n >= 3:
        pair = ids[:-1] * m + ids[1:]
        if m < 2_000_000:
            window = pair[:-1] * m + ids[2:]
        else:  # the product would pass 63 bits: number the pairs first
            window = np.unique(pair[:-1], return_inverse=True)[1] * m + ids[2:]
        order = np.sort(window)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            at = np.flatnonzero(np.isin(window, twice))
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + 3, -1)
            repeated = int((np.cumsum(cover[:n]) > 0).sum())
    change = np.flatnonzero(np.diff(ids)) + 1
    longest = int(np.diff(np.concatenate(([0], change, [n]))).max())
    n_upper = len(joined) - len(joined.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    n_lower = len(joined) - len(joined.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    n_ended = sum(x.rstrip()[-1:] in b".!?:;\"'" for x in lines)
    return n, word_chars, n_symbols, n_dup_lines, repeated, len(lines), m, n_upper, n_upper + n_lower, n_ended, longest


def with_counts(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of the input (all by default) in a struct `row`, and COUNTS in columns."""
    names = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*([F.col(f"`{c}`") for c in names] or [F.lit(0).alias("none")])).alias("row"), common.text_or_empty(text_col).cast("binary").alias("data"))
    schema = StructType([rows.schema["row"], *[StructField(c, LongType()) for c in COUNTS]])

    def count(batches):
        common.worker_cache(None)
        for batch in batches:
            table = np.array([text_counts(x.as_py()) for x in batch.column(1)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(table[:, i]) for i in range(len(COUNTS))]], names=["row", *COUNTS])

    return rows.mapInArrow(count, schema)


def votes() -> dict[str, F.Column]:
    """1 good, -1 bad, 0 abstain, by rule; expressions over COUNTS."""
    n, c = F.col, lambda a, b: F.when(a, F.lit(1)).when(b, F.lit(-1)).otherwise(F.lit(0))
    words, chars, lines = n("n_words"), F.greatest(n("word_chars"), F.lit(1)), F.greatest(n("n_lines"), F.lit(1))
    return {
        "length": c(words >= 80, words < 50),
        "symbols": c(n("n_symbols") * 100 <= words, n("n_symbols") * 4 > words),
        "dup_lines": c(n("n_dup_lines") == 0, (n("n_dup_lines") >= 3) & (n("n_dup_lines") * 3 > lines)),
        "repeats": c(n("n_repeat_words") * 10 <= words, n("n_repeat_words") * 10 > words * 3),
        "variety": F.when(words < 20, F.lit(0)).otherwise(c((n("n_distinct") * 3 >= words) | (n("n_distinct") >= 150), (n("n_distinct") * 5 < words) & (n("n_distinct") < 100))),
        "shouting": F.when(n("n_alpha") < 40, F.lit(0)).otherwise(c(n("n_upper") * 5 <= n("n_alpha"), n("n_upper") * 2 > n("n_alpha"))),
        "line_ends": c(n("n_ended") * 10 >= lines * 8, n("n_ended") * 10 < lines * 3),
        "runs": c(n("longest_run") <= 3, n("longest_run") >= 8),
        "word_length": F.when(words == 0, F.lit(0)).otherwise(c((chars >= words * 3) & (chars <= words * 9), (chars < words * 2) | (chars > words * 14))),
    }


def pattern() -> F.Column:
    """The votes as one number in base 3."""
    code = F.lit(0)
    for vote in votes().values():
        code = code * 3 + (vote + 1)
    return code.cast("int")


def unpack(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), len(RULES)), int)
    for j in reversed(range(len(RULES))):
        out[:, j], codes = codes % 3 - 1, codes // 3
    return out


def fit_posteriors(patterns: list[tuple[int, int]], rounds: int = EM_ROUNDS, false_alarm: float = 0.003, hit: float = 0.9, pseudo: float = 0.1) -> dict[int, float]:
    """Posterior of the good class by vote pattern, from (pattern, documents) rows.

    The latent classes are "good" and, as junk of one sort trips one rule and passes the others, one kind
    of bad document for each rule. Each class has a probability for each rule that its vote is bad, which is the
    rule's accuracy in that class; expectation-maximisation fits these and the shares to the counts.
    Pseudo-counts (a share `pseudo` of the documents) say what is known beforehand: a rule
    rarely votes bad on good documents (`false_alarm`), mostly does on its own kind (`hit`), and votes on other kinds as it
    does on good ones until the corpus says otherwise, so small corpora learn too. They also
    fix which class is the good one, so a corpus without junk isn't split in two.
    """
    if not patterns:
        return {}
    codes, n = (np.array(x) for x in zip(*patterns))
    v = unpack(codes)
    n = n.astype(float)
    r = len(RULES)
    bad = np.empty((r + 1, r))  # probability that a rule that votes votes bad; class 0 is good
    bad[:] = false_alarm
    bad[np.arange(1, r + 1), np.arange(r)] = hit
    strength = np.full(r + 1, pseudo * n.sum() / r / 5 + 5)
    strength[0] = pseudo * n.sum() + 5
    share = np.array([0.9] + [0.1 / r] * r)
    for _ in range(rounds):
        # an abstention says nothing of the class: rules about the same thing abstain together
        logp = np.log(share)[None] + (v == -1) @ np.log(bad).T + (v == 1) @ np.log1p(-bad).T
        post = np.exp(logp - logp.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        weight = post * n[:, None]
        expected = np.repeat(bad[:1], r + 1, 0)
        expected[0] = false_alarm
        expected[np.arange(1, r + 1), np.arange(r)] = hit
        voted_bad, voted = weight.T @ (v == -1), weight.T @ (v != 0)
        new = np.clip((voted_bad + expected * strength[:, None]) / (voted + strength[:, None]), 1e-9, 1 - 1e-9)
        moved = abs(new - bad).max()
        bad, share = new, (weight.sum(0) + 1) / (n.sum() + r + 1)
        if moved < 1e-9:
            break
    return {int(c): float(p) for c, p in zip(codes, post[:, 0])}


def judged(counted: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Adds base_failed, vote_pattern, posterior and kept. The model is fitted to `patterns`, by default the votes on `counted`."""
    counted = counted.withColumn("vote_pattern", pattern())
    seen = (patterns or counted).groupBy("vote_pattern").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3^9 rows
    posterior = fit_posteriors([(r[0], r[1]) for r in seen])
    lookup = F.create_map(*[F.lit(x) for x in chain(*posterior.items())]) if posterior else None
    score = F.lit(1.0) if lookup is None else F.coalesce(F.element_at(lookup, F.col("vote_pattern")), F.lit(0.5))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumns({"base_failed": failed, "posterior": score}).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_FROM))


def filter_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are kept, with all their columns. Two scans, no shuffle of texts."""
    seen = with_counts(docs, text_col, keep=[]).withColumn("vote_pattern", pattern())
    return judged(with_counts(docs, text_col), seen).filter("kept").select("row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = common.spill(with_counts(common.documents(spark, sf_dir), keep=["doc_id"]).select("row.doc_id", *COUNTS), "quality")
    return judged(counted).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")

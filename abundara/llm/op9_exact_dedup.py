"""Exact duplicates by skew-safe combining.

Texts are equal when they are identical after each run of ASCII white space becomes one space.
Stage 1 combines equal texts inside each map task (partial aggregate), stage 2 merges them by
(digest, salt, text), stage 3 combines the salt winners by (digest, text). The text itself is a
grouping key at every stage, so no decision rests on a digest. A group with a third of all rows
reaches stage 2 as at most one row per map task and salt, and stage 3 as one row per salt. Rows meet their
group by (digest, salt) too, so no task has all rows of a group.

Edge cases: null text counts as empty, and empty texts equal each other. A null id never wins over an
id; a group of null ids only has keep_id null and kept true. Repeated rows count each in group_size;
`deduplicate` returns one of them, the least in all columns. An empty table gives an empty result. Columns of the input besides
id and text are ignored by `exact_groups` and carried through by `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SALTS = common.SALTS


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def normalised(text_col: str = "text") -> Column:
    return F.regexp_replace(common.text_or_empty(text_col), common.SPACE_RUN, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per distinct normalised text: digest, norm, keep_id, group_size, and the salts of its rows."""
    rows = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    rows = rows.select("id", "norm", digest(F.col("norm")).alias("digest"), common.salt_of(F.col("id"), salts=salts).alias("salt"))
    salted = rows.groupBy("digest", "salt", "norm").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"), common.salt_bits("salt").alias("salts"))


def exact_membership(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Groups meet the rows again by digest; digests that stand for several texts (none with SHA-256, but
    the result does not rely on it) are joined by the text as well.
    """
    found = exact_groups(docs, id_col, text_col, salts, digest)
    groups = common.spill(found.select("digest", "keep_id", "group_size", "salts"), "exact-groups")
    clashes = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")
    rows = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    rows = rows.select("id", "norm", digest(F.col("norm")).alias("digest"), common.salt_of(F.col("id"), salts=salts).alias("salt"))
    by_salt = lambda g: common.by_salt(g, "salts", "salt")
    if clashes.isEmpty():
        joined = rows.drop("norm").join(by_salt(groups), ["digest", "salt"])
    else:
        clashes = common.spill(clashes, "exact-clashes")
        plain = rows.join(clashes, "digest", "left_anti").drop("norm").join(by_salt(groups), ["digest", "salt"])
        full = rows.join(clashes, "digest", "left_semi").join(by_salt(found.join(clashes, "digest", "left_semi")), ["digest", "norm", "salt"]).drop("norm")
        joined = plain.unionByName(full)
    return joined.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one per distinct normalised text, with all their columns."""
    winners = exact_groups(docs, id_col, text_col).select("digest", "keep_id")
    return common.one_row_each(docs, {"digest": sha256(normalised(text_col)), "keep_id": F.col(id_col)}, winners)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return exact_membership(docs).withColumnRenamed("digest", "text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
     g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""

"""Exact deduplication by skew-safe combining (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..session import written_table
from .common import SPACE

SALTS = 16
#: Winners are compared as one number: code points times this, plus a term that falls with the identifier.
_SHIFT, _TOP = 1 << 65, 1 << 63


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def normal_text(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS,
                digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after white space is removed; the row with the longest original text stays, then the
    one with the smallest id. Equal texts are first combined inside their map task, next per (digest, salt), where the
    salt is the map task, so a group holding much of the table meets in many tasks; then the salts' winners are combined
    over all. Each step groups by digest and full normalised text, so a digest shared by different texts doesn't merge
    them. The winners (no texts) are written once and joined back on the digest; where a digest stands for several texts,
    the join compares the texts too.

    A null text counts as empty. A null id loses every tie; a group of null ids only has a null keep_id. Rows that repeat
    an id and text are both marked kept when that id is their group's. An empty table gives no rows. Other columns are
    not read, whatever their names.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), normal_text(F.col(text_col)).alias("norm"),
                       F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n_chars"))
    base = base.withColumn("digest", digest(F.col("norm")))
    big = lambda v: F.lit(str(v)).cast("decimal(38,0)")
    score = (F.col("n_chars").cast("decimal(12,0)") * big(_SHIFT)).cast("decimal(38,0)") \
        + F.coalesce(big(_TOP) - F.col("id").cast("decimal(20,0)"), big(0))
    scored = base.select("digest", "norm", score.cast("decimal(38,0)").alias("score"),
                         F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"))
    salted = scored.groupBy("digest", "salt", "norm").agg(F.count("*").alias("n"), F.max("score").alias("score"))
    # by digest alone, so that the next grouping and the count of texts per digest need no further exchange
    merged = (salted.repartition("digest").groupBy("digest", "norm")
              .agg(F.sum("n").alias("group_size"), F.max("score").alias("score")))
    low = F.col("score") % big(_SHIFT)
    winners = merged.select("digest", "norm", "group_size", F.when(low > 0, (big(_TOP) - low).cast("long")).alias("keep_id"))
    small = written_table(winners.groupBy("digest").agg(
        F.count("*").alias("texts"), F.max("group_size").alias("group_size"), F.max("keep_id").alias("keep_id")), "dedup-winners")
    rows = base.select("id", "digest", "norm").join(small, "digest")
    single = rows.filter("texts = 1").select("id", "digest", "keep_id", "group_size", "norm")
    if not small.filter("texts > 1").isEmpty():
        collided = rows.filter("texts > 1").select("id", "digest", "norm")
        single = single.unionByName(collided.join(winners, ["digest", "norm"]).select(*single.columns))
    named = single.select(F.col("id").alias(id_col), "keep_id", "group_size", F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"),
                          (F.col("digest") if digest is sha256 else sha256(F.col("norm"))).alias("text_sha256"))
    return named

"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import written_table
from .common import fresh, running_sums, word_count


def source_targets(sizes: DataFrame, weights: Sequence[float], budget_share: float, max_repeats: int) -> DataFrame:
    """(source, source_size) -> source, source_size, weight, target.

    Sources ordered by code point, null last, take ``weights`` in turn. A target stops at ``max_repeats`` times its
    source; what is over goes to the others by weight. Sorted by cap per weight, the sources that stop come first, so
    running sums give the level at which the rest share what is left. The window runs over one row per source.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights)))
    weighed = sizes.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")).alias("weight"))
    order = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = (weighed.withColumn("_cap", F.col("source_size") * F.lit(float(max_repeats)))
              .withColumn("_left", F.sum("source_size").over(everything) * F.lit(float(budget_share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
              .withColumn("_share", F.sum("weight").over(after))
              .withColumn("_stops", F.col("_cap") * F.col("_share") <= F.col("_left") * F.col("weight")))
    # the first source that doesn't stop fixes the level of all from there on
    level = F.first(F.when(~F.col("_stops"), F.struct("_left", "_share")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    levels = levels.withColumn("_level", level)
    target = F.when(F.col("_stops") | F.col("_level").isNull(), F.col("_cap")).otherwise(F.col("_level._left") * F.col("weight") / F.col("_level._share"))
    return levels.select("source", "source_size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget_share: float = 1.0, max_repeats: int = 3, seed: int = 42,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, source, size (words), source_size, target, taken (words the mix takes), copies.

    ``row_col`` names a column of whole numbers that tells rows apart; it comes out as ``row``, and rows that repeat an id are then
    ordered by it.

    The rows of a source are shuffled by a seeded digest of their id; copy ``c`` of a document has the virtual finish time
    ``(c * source size + words up to and with the document) / target``. All copies are range-sorted by finish time and cut
    at the total budget (the sum of the targets). Running sums come from :func:`running_sums`, so a source may hold any
    share of the rows. The cut is a single row, the first copy that no longer fits; a document's copies before it are taken.

    Null texts have no words; documents without words take 0, and sources without words have target 0. A null source is a
    source, the last one. Rows that repeat an id are documents of their own, in a fixed order by their size. An empty
    table gives no rows. Reruns agree.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
                       *([F.col(row_col).cast("long").alias("row")] if row_col else []))
    tell = ["id", "size", *(["row"] if row_col else [])]
    rows = rows.withColumn("mix", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary")))
    rows = written_table(rows, "mix-rows")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget_share, max_repeats)
    placed = running_sums(rows, ["source"], ["mix", *tell], {"before": F.col("size")})
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    placed = written_table(placed.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "mix-placed")
    finish = lambda copy: (copy * F.col("source_size") + F.col("before") + F.col("size")).cast("double") / F.col("target")
    copies = (placed.filter("size > 0 and target > 0")
              .select("source", "mix", *tell, F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("copy"), "source_size", "before", "target")
              .withColumn("finish", finish(F.col("copy").cast("long"))))
    key = ["finish", "source", "copy", "mix", *tell]
    queue = running_sums(copies.select(*key), [], key, {"ahead": F.col("size")})
    budget = targets.agg(F.round(F.sum("target")).cast("long").alias("budget"))
    nulls_last = lambda c: [F.col(c).isNull(), F.col(c)]
    place = F.struct("finish", *nulls_last("source"), "copy", "mix", *nulls_last("id"), *tell[1:])
    cut = queue.crossJoin(F.broadcast(budget)).filter("ahead + size > budget").agg(F.min(place).alias("cut"))  # one row each
    marked = placed.crossJoin(F.broadcast(cut))
    taken = F.lit(0)
    for c in range(max_repeats):
        here = F.struct(finish(F.lit(c)), *nulls_last("source"), F.lit(c), F.col("mix"), *nulls_last("id"), *[F.col(c) for c in tell[1:]])
        taken = taken + F.when((F.col("size") > 0) & (F.col("target") > 0) & (F.col("cut").isNull() | (here < F.col("cut"))), 1).otherwise(0)
    return marked.withColumn("copies", taken).select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies",
        *(["row"] if row_col else []))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, each as often as the mix takes that row.

    The rows are numbered and written once, so that rows that share an id, or are equal, are told apart and the words that come
    out are those that the mix takes."""
    row = fresh(docs.columns, "mix_row")
    numbered = written_table(docs.withColumn(row, F.monotonically_increasing_id()), "mix-numbered")
    mixed = mix_sources(numbered, id_col=id_col, text_col=text_col, source_col=source_col, row_col=row, **options)
    copies = mixed.filter("copies > 0").select(F.col("row").alias(row), F.array_repeat(F.lit(0), F.col("copies")).alias(fresh([*docs.columns, row], "mix_copies")))
    repeated = numbered.join(copies, row)
    return repeated.select(*docs.columns, F.explode(copies.columns[1]).alias(fresh(repeated.columns, "mix_copy"))).select(*docs.columns)

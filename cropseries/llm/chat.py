"""Chat formatting by rotating the perspective through all participants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import running_sums


def escaped(text: Column) -> Column:
    """Text that can't hold a marker: a backslash is doubled, and ``<|`` becomes ``<\\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def rotate_perspectives(turns: DataFrame, instructions: Sequence[str] = ("system",), conv_col: str = "conv_id", turn_col: str = "turn",
                        speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """Every dialogue once per participant, that speaker as assistant and the others as named users.

    One row per perspective and turn: conversation, perspective, segment (from 0), turn, role (assistant, user or system),
    name (of users), rendered, start and end (code points in the rendered dialogue), loss_start and loss_end (the part that
    counts for the loss: the assistant's words and end marker; both null elsewhere). The segments of a perspective, put one
    after another, are the rendered dialogue; they stay apart so that a dialogue may have any length. Speakers in
    ``instructions`` take no perspective and are system messages in all; a dialogue of these only gives no rows.

    Turns go by number, then speaker and text, nulls last. A null speaker is named ``unknown``, a null text is empty, rows
    with a null conversation form one. Repeated rows are turns of their own. Line breaks in names become spaces.
    """
    name = F.regexp_replace(F.coalesce(F.col(speaker_col).cast("string"), F.lit("unknown")), r"[\r\n]", " ")
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), name.alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    system = F.col("speaker").isin(list(instructions))
    participants = (rows.filter(~system).select(F.col("conv").alias("_conv"), F.col("speaker").alias("perspective")).distinct())
    viewed = rows.join(participants, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(system, "system").when(own, "assistant").otherwise("user")
    head = F.concat(F.lit("<|"), F.col("role"), F.when(F.col("role") == "user", F.concat(F.lit(" name="), escaped(F.col("speaker")))).otherwise(""), F.lit("|>\n"))
    tail = "<|end|>\n"
    viewed = (viewed.withColumn("role", role).withColumn("head", head)
              .withColumn("rendered", F.concat("head", escaped(F.col("text")), F.lit(tail)))
              .withColumn("name", F.when(F.col("role") == "user", F.col("speaker"))))
    length = F.length("rendered").cast("long")
    placed = running_sums(viewed, ["conv", "perspective"], ["turn", "speaker", "text"], {"segment": F.lit(1), "start": length})
    end = F.col("start") + length
    mine = F.col("role") == "assistant"
    return placed.select(F.col("conv").alias(conv_col), "perspective", "segment", F.col("turn").alias(turn_col), "role", "name", "rendered", "start", end.alias("end"),
                         F.when(mine, F.col("start") + F.length("head")).alias("loss_start"), F.when(mine, end - 1).alias("loss_end"))


def join_segments(segments: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Rendered dialogues as one row each, with their loss spans; for dialogues that fit in a row."""
    whole = segments.groupBy(conv_col, "perspective").agg(F.array_sort(F.collect_list(F.struct("segment", "rendered", "loss_start", "loss_end"))).alias("s"))
    spans = F.filter(F.transform("s", lambda x: F.struct(x["loss_start"].alias("start"), x["loss_end"].alias("end"))), lambda x: x["start"].isNotNull())
    return whole.select(conv_col, "perspective", F.array_join(F.transform("s", lambda x: x["rendered"]), "").alias("text"), spans.alias("loss_spans"))

"""Class and crop codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# 21 land-cover classes in 7 groups.
LC_GROUPS = {
    "crops": [11, 12, 13, 20],
    "trees": [1, 2, 3, 4, 7, 8],
    "water": [17, 18],
    "soil": [16, 15],
    "urban": [14],
    "vegetation": [21, 5, 6],
    "others": [9, 10, 19],
}

# Crop words and their map codes.
CROP_CODES = {"unknown": 0, "maize": 1, "beans": 2, "sorghum": 3, "beans_double_season": 4}

# Stage names by position of the reference day.
STAGES = ("Greenup", "Maturity", "Senescence", "Dormancy")


def lc_group(cls: str | Column) -> Column:
    cls = F.col(cls) if isinstance(cls, str) else cls
    group = F.lit(None).cast("string")
    for name, members in LC_GROUPS.items():
        group = F.when(cls.isin(members), F.lit(name)).otherwise(group)
    return group


def is_crop(cls: str | Column) -> Column:
    cls = F.col(cls) if isinstance(cls, str) else cls
    return F.coalesce(cls.isin(LC_GROUPS["crops"]), F.lit(False))


def crop_code(word: str | Column) -> Column:
    word = F.col(word) if isinstance(word, str) else word
    codes = F.create_map(*[F.lit(v) for pair in CROP_CODES.items() for v in pair])
    return F.coalesce(F.try_element_at(codes, word), F.lit(0))


def argmax_class(scores: str | Column) -> Column:
    """0-based index of the largest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")

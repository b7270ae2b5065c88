"""Reference curve library kept as text files: one vi, one phe and optionally one crop file per index."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "ref_id int, vi array<double>, phen_days array<double>, crop string"

# Fixed value: file name pattern of the library.
FILE_NAME = r"ref_(vi|phe|crop)_6months_(\d+)"


def read_reference_library(spark: SparkSession, path: str) -> DataFrame:
    """One row per reference with both a vi and a phe file; crop defaults to ``unknown``. A missing folder gives no rows."""
    try:
        texts = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], SCHEMA)
    file = F.col("_metadata.file_path")
    parsed = texts.select(F.regexp_extract(file, FILE_NAME, 1).alias("kind"),
                          F.regexp_extract(file, FILE_NAME, 2).try_cast("int").alias("ref_id"),
                          F.trim(F.regexp_replace("value", r"\s+", " ")).alias("body")).filter(F.col("ref_id").isNotNull())
    by_ref = parsed.groupBy("ref_id").agg(*[F.max(F.when(F.col("kind") == k, F.col("body"))).alias(k)
                                            for k in ("vi", "phe", "crop")])
    numbers = lambda c: F.transform(F.split(c, r"[ ,]+"), lambda v: v.cast("double"))
    return by_ref.filter("vi IS NOT NULL AND phe IS NOT NULL").select(
        "ref_id", numbers("vi").alias("vi"), numbers("phe").alias("phen_days"),
        F.coalesce(F.nullif("crop", F.lit("")), F.lit("unknown")).alias("crop"))


def write_reference_library(references: DataFrame, path: str) -> None:
    """Write a library so that ``read_reference_library`` finds it: one text part per file name."""
    numbers = lambda c: F.concat_ws(" ", F.transform(c, lambda v: v.cast("string")))
    files = F.array(*[F.struct(F.concat(F.lit(f"ref_{kind}_6months_"), F.col("ref_id").cast("string")).alias("file"),
                               body.alias("value"))
                      for kind, body in (("vi", numbers("vi")), ("phe", numbers("phen_days")), ("crop", F.col("crop")))])
    references.select(F.inline(files)).repartition("file").write.partitionBy("file").text(path)

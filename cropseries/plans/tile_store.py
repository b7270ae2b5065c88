"""A store of finished tiles: batches committed with a record, reruns that change nothing, failed tiles set aside with their message.

Layout: ``data/batch=<name>`` holds the rows of one batch of tiles as a Parquet table, ``manifest`` is a Parquet table with a row per attempt at
a tile: the tile, ``status`` (done or failed), ``message``, ``n_rows``, ``attempt``, ``batch`` (where its rows are). A tile counts as its
last attempt says. So a store has as many folders as batches, however many tiles it holds.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..relational import first_per_key
from ..session import scratch_path, written_table

#: Tiles of a batch: as many as a job works on at once, and as many ids as the driver handles.
BATCH = 1000
#: Files of a batch's source rows.
SOURCE_FILES = 8


def _manifest_schema(tile: T.DataType, on: str) -> T.StructType:
    return T.StructType([T.StructField(on, tile), T.StructField("status", T.StringType()), T.StructField("message", T.StringType()),
                         T.StructField("n_rows", T.LongType()), T.StructField("attempt", T.LongType()), T.StructField("batch", T.StringType())])


def _ensure(spark: SparkSession, path: str, schema: T.StructType) -> None:
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/manifest")


def manifest(spark: SparkSession, path: str, on: str = "tile_id") -> DataFrame:
    """The last attempt at each tile."""
    rows = spark.read.parquet(f"{path}/manifest")
    return first_per_key(rows, [on], [-F.col("attempt")])


def finished(spark: SparkSession, path: str, on: str = "tile_id", schema: T.StructType | None = None) -> DataFrame:
    """The rows of all tiles that are done. What a batch wrote before it was committed doesn't count."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    done = manifest(spark, path, on).filter("status = 'done'").select(on, "batch")
    names = [r["batch"] for r in done.select("batch").distinct().orderBy("batch").collect()]  # a few for a run
    if None in names:
        raise ValueError(f"{path} was written with a folder for each tile: run its tiles again into a new store")
    batches = [f"{path}/data/batch={name}" for name in names]
    rows = reader.option("basePath", f"{path}/data").parquet(*(batches or [f"{path}/data"]))
    return rows.withColumn("batch", F.col("batch").cast("string")).join(done, [on, "batch"], "left_semi").drop("batch")


def _message(error: Exception) -> str:
    """The innermost message of a failed job, in one line."""
    lines = [line.strip() for line in str(error).splitlines() if line.strip()]
    causes = [line for line in lines if line.startswith(("Caused by:", "[", "pyspark", "ValueError", "RuntimeError")) or "Error" in line.split(":")[0]]
    return (causes or lines or [type(error).__name__])[0][:500]


def run_tiles(tiles: DataFrame, process: Callable[..., DataFrame], path: str, on: str = "tile_id", batch: int = BATCH,
              retry_failed: bool = True, source: DataFrame | None = None) -> DataFrame:
    """Process the tiles that aren't done and return the manifest of all.

    ``process`` maps rows of ``tiles`` to result rows that carry ``on``. Pending tiles are dealt to batches by their hash. A batch's
    result is written to a folder of its own and then one append to the manifest commits it, so a run that ends
    anywhere can be repeated: tiles without a record are done again, and what they left doesn't count. A batch that fails is
    halved, and its halves are run, until single tiles fail; those are recorded with their message and don't stop the others. They are
    tried again in the next run, unless ``retry_failed`` is false. A tile without result rows is done with 0 rows.

    ``source``: rows that the tiles are made from, with ``on``. Those of the pending tiles are dealt to the batches once, in a written
    table, and ``process`` gets them, of its tiles only, as its second argument: so a batch reads its own rows, and not the whole input.

    Equal rows of ``tiles`` count once, rows without an id not at all. One run at a time may write to ``path``.
    """
    spark = tiles.sparkSession
    schema = _manifest_schema(tiles.schema[on].dataType, on)
    _ensure(spark, path, schema)
    tiles = tiles.filter(F.col(on).isNotNull()).distinct()
    known = spark.read.schema(schema).parquet(f"{path}/manifest")
    attempt = (known.agg(F.max("attempt")).first()[0] or 0) + 1
    settled = manifest(spark, path, on).filter("status = 'done'" if retry_failed else "true").select(on)
    pending = written_table(tiles.join(settled, on, "left_anti"), "pending-tiles")  # read by every batch
    n = -(-pending.select(on).distinct().count() // batch)
    if not n:
        return manifest(spark, path, on)
    dealt = F.pmod(F.xxhash64(on), F.lit(n)).cast("int")
    rows_path = scratch_path(spark, "tile-rows")
    if source is not None:
        wanted = source.join(pending.select(on).distinct(), on, "left_semi").withColumn("_batch", dealt)
        wanted.repartition(F.col("_batch"), F.pmod(F.xxhash64(*source.columns), F.lit(SOURCE_FILES))).write.partitionBy("_batch").parquet(rows_path)

    def commit(rows: list[tuple]) -> None:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/manifest")

    def attempt_batch(ids: list, k: int, name: str) -> None:
        wanted = F.broadcast(spark.createDataFrame([(i,) for i in ids], T.StructType([tiles.schema[on]])))
        given = [pending.join(wanted, on, "left_semi")]
        if source is not None:
            rows = spark.read.schema(source.schema).parquet(f"{rows_path}/_batch={k}") if k in filled else spark.createDataFrame([], source.schema)
            given.append(rows.join(wanted, on, "left_semi"))
        place = f"{path}/data/batch={name}"
        try:
            process(*given).write.mode("overwrite").parquet(place)
        except (Py4JJavaError, PySparkException) as error:
            if len(ids) == 1:
                commit([(ids[0], "failed", _message(error), 0, attempt, None)])
                return
            half = len(ids) // 2
            attempt_batch(ids[:half], k, f"{name}a")
            attempt_batch(ids[half:], k, f"{name}b")
            return
        counts = {r[on]: r["count"] for r in spark.read.parquet(place).groupBy(on).count().collect()}  # about ``batch`` rows
        commit([(i, "done", None, counts.get(i, 0), attempt, name) for i in ids])

    filled = {r[0] for r in spark.read.parquet(rows_path).select("_batch").distinct().collect()} if source is not None else set()
    for k in range(n):
        ids = sorted(r[0] for r in pending.select(on).distinct().filter(dealt == k).collect())  # about ``batch`` ids
        if ids:
            attempt_batch(ids, k, f"r{attempt}-{k}-")
    return manifest(spark, path, on)

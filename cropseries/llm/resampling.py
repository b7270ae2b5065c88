"""Importance resampling towards a target text: hashed n-gram gains as an array, Gumbel scores, a cutoff found by bisection."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import written_table
from .common import DENSE, dense_rows, dense_total, running_sums, task_salt, text_slices, texts_of

BUCKETS = 10_000
SEED = 2024
#: Lower-cases A-Z and turns every other character below U+0080 that is neither digit nor letter into a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: Bytes of a text split at once, and features whose buckets a worker remembers.
PIECE, REMEMBERED = 1 << 20, 500_000
#: Halvings of the threshold's range that one count job decides.
HALVINGS = 4


def word_lists(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased, in lists of about ``piece`` bytes."""
    flat, at = text.translate(_TABLE), 0
    while at < len(flat):
        end = flat.find(b" ", at + piece)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


class Buckets(dict):
    """Feature -> bucket: its CRC-32 modulo the number of buckets."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        self[feature] = bucket = zlib.crc32(feature) % self.buckets
        return bucket

    def of(self, text: bytes, runs: int) -> Iterator[np.ndarray]:
        """Buckets of all runs of 1 to ``runs`` consecutive words, piece by piece; single words first in each."""
        if len(self) > REMEMBERED:
            self.clear()
        tail: list[bytes] = []
        for words in word_lists(text):
            yield np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
            for n in range(2, runs + 1):
                joined = tail[max(len(tail) - n + 1, 0):] + words
                yield np.fromiter((zlib.crc32(b" ".join(joined[i:i + n])) % self.buckets for i in range(len(joined) - n + 1)), dtype=np.int64)
            tail = (tail + words)[-(runs - 1):] if runs > 1 else []


def bucket_counts(texts: DataFrame, runs: int = 1, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """Occurrences of all features of all texts per bucket; tasks count densely and the tables are added up."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = np.zeros(buckets, dtype=np.int64), Buckets(buckets)
        for batch in batches:
            for part in text_slices(batch, "text"):
                found = [ids for text in texts_of(part) for ids in known.of(text, runs)]
                if found:
                    table += np.bincount(np.concatenate(found), minlength=buckets)
        yield from dense_rows(table, task_salt())

    return dense_total(texts.select(F.col(text_col).alias("text")).mapInArrow(count, DENSE), buckets)


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket in target and source, rounded down."""
    n = len(source)
    share = (target + 1.0) * (float(source.sum()) + n) / ((source + 1.0) * (float(target.sum()) + n))
    return np.floor(1000 * np.log(share)).astype(np.int64)


def _weigher(spark, gains: np.ndarray, runs: int):
    shared = spark.sparkContext.broadcast(gains)

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        gain, known = shared.value, Buckets(len(shared.value))
        for texts in batches:
            out = np.zeros((len(texts), 3), dtype=np.int64)
            batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], ["text"])
            row = 0
            for part in text_slices(batch, "text"):
                for text in texts_of(part):
                    total = features = words = 0
                    for k, ids in enumerate(known.of(text, runs)):
                        total, features = total + int(gain[ids].sum()), features + len(ids)
                        words += len(ids) if k % runs == 0 else 0
                    out[row] = words, features, total // features if features else 0
                    row += 1
            yield pd.DataFrame(out, columns=["n_words", "n_features", "weight"])

    return weigh


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel number, rounded down, drawn from the SHA-256 of seed and id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(uniform))).cast("long")


def first_rows(rows: DataFrame, order: Sequence[Column], k: int) -> Column:
    """A condition on ``rows`` that holds for exactly the first ``k`` by ``order`` (long columns, ascending, without nulls).

    The ``k``-th value of the first column is found by bisection: a job counts the rows up to each of a few thresholds
    between the bounds, which narrows them by ``HALVINGS`` halvings. Rows before it are in, and among the rows tied on it
    the next column decides likewise. ``rows`` should be a written table; only counts reach the driver.
    """
    chosen, tied = F.lit(False), F.lit(True)
    if k <= 0:
        return chosen
    for key in order:
        left = rows.filter(tied)
        low, high = left.agg(F.min(key), F.max(key)).first()
        if low is None:
            return chosen
        while low < high:
            steps = min(1 << HALVINGS, high - low + 1)
            thresholds = [low + (high - low) * i // steps for i in range(1, steps)]
            counts = left.agg(*[F.count(F.when(key <= t, 1)) for t in thresholds]).first()
            for t, n in zip(thresholds, counts):
                if n >= k:
                    high = t
                    break
                low = t + 1
        before, upto = left.agg(F.count(F.when(key < low, 1)), F.count(F.when(key <= low, 1))).first()
        chosen = chosen | (tied & (key < low))
        if upto <= k:
            return chosen | (tied & (key == low))
        k -= before
        tied = tied & (key == low)
        if not k:
            return chosen
    raise ValueError("the order doesn't tell rows apart")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, runs: int = 1, buckets: int = BUCKETS,
                        seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
                        carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: id, the columns of ``carry``, n_features, weight, score, rank.

    Features are all runs of 1 to ``runs`` consecutive words, hashed to ``buckets``. A bucket's gain compares its smoothed
    shares in ``target`` and ``docs``; a document's weight is the mean gain of its features, rounded down. Adding a Gumbel
    number drawn from seed and id makes the highest scores a sample without replacement by weight. Of the documents with
    ``min_words`` words at least, ``percent`` of a hundred are drawn (rounded down); their rank counts from 1, others have none.

    Every text is read twice, for the counts and for the weights; both counts have a fixed size, and so has the array of gains
    that goes to the tasks. Scores are written once; the cutoff comes from counts (:func:`first_rows`), and the drawn
    rows are range-sorted for their ranks. Ties go to the smaller id, then (repeated ids) to fewer features.

    Null and empty texts have no features and weight 0; they are drawn only where ``min_words`` is 0. A null id comes after
    the others and draws its number as an empty one. Repeated rows are documents of their own. An empty table gives no rows,
    an empty target gains from smoothing alone. ``carry`` must not name a column of the result.
    """
    results = {id_col, "n_features", "weight", "score", "rank"}
    if results & set(carry):
        raise ValueError(f"columns of the result can't be carried: {sorted(results & set(carry))}")
    gains = bucket_gains(bucket_counts(docs, runs, buckets, text_col), bucket_counts(target, runs, buckets, target_text_col))
    kept = [F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *kept, _weigher(docs.sparkSession, gains, runs)(F.col(text_col)).alias("w"))
    rows = rows.select("id", *[c for c in rows.columns if c.startswith("_c")], "w.*", (F.col("w.weight") + gumbel(F.col("id"), seed)).alias("score"))
    rows = written_table(rows.withColumn("row", F.monotonically_increasing_id()), "resampling-scores")
    fit = rows.filter(F.col("n_words") >= min_words)
    order = [-F.col("score"), F.col("id").isNull().cast("long"), F.coalesce("id", F.lit(0)), F.col("n_features"), F.col("row")]
    drawn = (F.col("n_words") >= min_words) & first_rows(fit, order, percent * fit.count() // 100)
    placed = running_sums(rows.filter(drawn).withColumn("falling", -F.col("score")), [], ["falling", "id", "n_features", "row"], {"before": F.lit(1)})
    out = [F.col("id").alias(id_col), *[F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)], "n_features", "weight", "score"]
    rest = rows.filter(~drawn).select(*out, F.lit(None).cast("long").alias("rank"))
    return rest.unionByName(placed.select(*out, (F.col("before") + 1).alias("rank")))

"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import DENSE, dense_rows, dense_total, fresh, task_salt, text_slices
from .grams import mix64

BUCKETS = 1 << 16
SIZES = (1, 2, 3)
#: Code points hashed at once; longer texts are scored in pieces that overlap by the longest n-gram.
PIECE = 1 << 19


def features(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Hash buckets of the n-grams of the lower-cased text, repeats kept, in arrays of bounded size."""
    lap = max(SIZES) - 1
    for a in range(0, max(len(text), 1), PIECE):
        from_before = min(a, lap)
        points = np.frombuffer(text[a - from_before:a + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        for n in SIZES:
            # an n-gram counts where it ends; those that end before this piece were counted with the one before
            skip = max(from_before - (n - 1), 0)
            m = len(points) - n + 1 - skip
            if m <= 0:
                continue
            gram = np.full(m, n, dtype=np.uint64)
            for j in range(n):
                gram = (gram ^ points[skip + j:skip + j + m]) * np.uint64(0x9E3779B97F4A7C15)
                gram ^= gram >> np.uint64(29)
            yield (mix64(gram) % np.uint64(buckets)).astype(np.int32)


def has_letters(text: str) -> bool:
    return any(c.isalpha() for c in text)


@dataclass
class LanguageModel:
    languages: list[str]
    #: log P(bucket | language), one row per bucket
    log_probs: np.ndarray
    #: log P(language)
    log_priors: np.ndarray

    def scores(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Predicted language and its posterior probability of each text.

        The bucket ids of many texts form one sparse row each; a row's log likelihood is the sum of its buckets' rows
        of the matrix, taken with one segmented sum per language.
        """
        known = len(self.languages) > 0
        names, values = ["und"] * len(texts), np.zeros(len(texts))
        live = [i for i, t in enumerate(texts) if known and t and has_letters(t)]
        total = np.zeros((len(live), len(self.languages)))
        ids, owners, held = [], [], 0

        def flush() -> None:
            nonlocal held
            if ids:
                starts = np.cumsum([0, *map(len, ids[:-1])])
                flat = np.concatenate(ids)
                for k in range(len(self.languages)):
                    np.add.at(total[:, k], owners, np.add.reduceat(self.log_probs[:, k][flat], starts))
            ids.clear(), owners.clear()
            held = 0

        for row, i in enumerate(live):
            for part in features(texts[i], self.log_probs.shape[0]):
                ids.append(part)
                owners.append(row)
                held += len(part)
                if held > 1 << 19:
                    flush()
        flush()
        if live:
            total += self.log_priors
            best = np.argmax(total, axis=1)  # of equal scores the first, languages being sorted
            share = 1 / np.exp(np.clip(total - total[np.arange(len(live)), best][:, None], -745, 0)).sum(axis=1)
            for row, i in enumerate(live):
                names[i], values[i] = self.languages[best[row]], share[row]
        return names, values


def train_language_model(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS, alpha: float = 0.1,
                         max_languages: int = 1000) -> LanguageModel:
    """Count n-grams per language over all rows with a language and a text; Laplace-smoothed log probabilities.

    Each task counts into one dense table (languages x buckets), and the tables are added up. More than ``max_languages``
    labels raise an error: the matrix that every task gets has at most that many columns.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull())
    languages = sorted((r[0] for r in rows.select("lang").distinct().limit(max_languages + 1).collect()), key=lambda s: s.encode("utf-8", "surrogatepass"))
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    index = {name: k for k, name in enumerate(languages)}
    width = buckets + 1  # the last entry counts documents

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(len(index) * width, dtype=np.int64)
        for batch in batches:
            for part in text_slices(batch, "text"):
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    at = index[lang] * width
                    table[at + buckets] += 1
                    for ids in features(text or "", buckets):
                        # few n-grams against many buckets: adding at the ids beats a full histogram
                        u, c = np.unique(ids, return_counts=True)
                        table[at + u] += c
        yield from dense_rows(table, task_salt())

    total = dense_total(rows.mapInArrow(count, DENSE), len(languages) * width).reshape(len(languages), width)
    counts = total[:, :buckets].astype(np.float64) + alpha
    documents = total[:, buckets].astype(np.float64)
    return LanguageModel(languages, np.ascontiguousarray(np.log(counts / counts.sum(axis=1, keepdims=True)).T) if languages else np.zeros((buckets, 0)),
                         np.log(documents / documents.sum()) if languages else np.zeros(0))


def predictor(spark, model: LanguageModel):
    """A column function text -> struct(lang string, score double); the matrix (of fixed size) is broadcast once."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, values = shared.value.scores([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang": names, "score": values})

    return predict


def held_out(id_col: Column, fold: int = 2, folds: int = 4) -> Column:
    """Whether crc32(id as text) mod ``folds`` is ``fold``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit_on_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    return train_language_model(docs.filter(~held_out(F.col(id_col))), text_col, lang_col)


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       model: LanguageModel | None = None) -> DataFrame:
    """One row per row of ``docs``: id, held_out, lang_pred, score.

    The model learns from rows outside the held-out fold that have a language. ``und`` with score 0 stands for null and
    empty texts, texts without letters, and everything when there is nothing to learn from. Of equal scores the smallest
    language wins. Rows that repeat an id are judged alone. An empty table gives no rows.
    """
    model = model or fit_on_documents(docs, id_col, text_col, lang_col)
    predict = predictor(docs.sparkSession, model)
    return (docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), predict(F.col(text_col)).alias("p"))
            .select(id_col, "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")))


def keep_identified(docs: DataFrame, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is known with ``min_score`` at least."""
    predict = predictor(docs.sparkSession, fit_on_documents(docs, id_col, text_col, lang_col))
    name = fresh(docs.columns, "language_guess")
    judged = docs.withColumn(name, predict(F.col(text_col)))
    return judged.filter((F.col(f"{name}.lang") != "und") & (F.col(f"{name}.score") >= min_score)).drop(name)

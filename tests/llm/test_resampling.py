import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cropseries.llm.resampling import first_rows, importance_resample
from helpers import LOWER

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, runs):
    w = WORDS.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i:i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


def expected(rows, target, percent=10, min_words=20, runs=1, buckets=10000, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for table, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            for f in features(text, runs)[1]:
                table[bucket(f)] += 1
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets))))
    out = []
    for doc, text, *_ in rows:
        w, found = features(text, runs)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([len(w), doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[0] >= min_words), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    for rank, row in enumerate(fit[:percent * len(fit) // 100], 1):
        row[5] = rank
    return sorted((tuple(r[1:]) for r in out), key=str)


def collected(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def corpus():
    rnd = random.Random(3)
    vocabulary = ["alpha", "Beta", "été", "x1", "naïve", "GAMMA", "σίγμα", "don't", "a-b", "İ"]
    rows = [(i, rnd.choice([" ", "\n", ", "]).join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    return rows + [(400, None), (401, ""), (402, " ,. "), (None, "no id " * 12), (403, "long words " * 20_000), (5, "alpha " * 25), (5, "alpha " * 25), (5, "beta " * 30)]


@pytest.mark.parametrize("runs, percent, min_words", [(1, 10, 20), (3, 50, 0)])
def test_same_as_plain_scores(spark, documents, runs, percent, min_words):
    rows, target = corpus(), ["alpha beta alpha", "été, GAMMA x1", None, ""]
    items = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    got = importance_resample(documents(rows).repartition(3), items, percent, min_words, runs)
    assert collected(got) == expected(rows, target, percent, min_words, runs)


def test_all_copies_of_one_row_share_the_cut(spark, documents):
    rows = [(7, "same words here " * 10)] * 40 + [(None, "same words here " * 10)] * 20
    items = spark.createDataFrame([(1, "same")], "item_id long, text string")
    got = collected(importance_resample(documents(rows), items, 50))
    assert got == expected(rows, ["same"], 50) and sorted(r[4] for r in got if r[4]) == list(range(1, 31))


def test_empty_tables(spark, documents):
    items = spark.createDataFrame([], "item_id long, text string")
    assert importance_resample(documents([]), items).count() == 0
    rows = [(1, "one two three " * 10), (2, "four five " * 20)]
    assert collected(importance_resample(documents(rows), items, 50)) == expected(rows, [], 50)


def test_carried_columns(spark, documents):
    items = spark.createDataFrame([(1, "b")], "item_id long, text string")
    got = importance_resample(documents([(1, "a b"), (2, "b b")]), items, 100, 1, carry=["text", "score_", "id"][::2]).collect()
    assert {(r.doc_id, r.text, r.id) for r in got} == {(1, "a b", "x"), (2, "b b", "x")}
    with pytest.raises(ValueError):
        importance_resample(documents([(1, "a")]), items, carry=["score"])


def test_exactly_k_rows(spark):
    rows = spark.range(1000).select((F.col("id") % 7 - 3).alias("a"), (F.col("id") % 11 * (1 << 58)).alias("b"), "id")
    order = [F.col("a"), -F.col("b"), F.col("id")]
    want = [r.id for r in rows.orderBy(*order).collect()]
    for k in (0, 143, 1000):
        assert {r.id for r in rows.filter(first_rows(rows, order, k)).collect()} == set(want[:k])

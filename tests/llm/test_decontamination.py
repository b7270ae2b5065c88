import random
from collections import Counter

import pytest

from cropseries.llm.decontamination import ItemIndex, drop_contaminated, find_contamination
from helpers import shingles, words


def best_windows(docs, items, least=0.75):
    """Every window of every item's size, compared directly."""
    out = {}
    for doc, text in docs:
        w = words(text)
        for item, target in items:
            size = len(words(target))
            if not size or not w:
                continue
            want = Counter(shingles(target))
            if size >= 5 and not want.keys() & set(shingles(text)):
                continue
            best = 0.0
            for first in range(max(len(w) - size, 0) + 1):
                part = " ".join(w[first:first + size])
                have = Counter(shingles(part))
                best = max(best, sum((want & have).values()) / sum((want | have).values()))
            if best >= least:
                out[doc, item] = round(best, 9)
    return out


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(rnd.randint(8, 60))) for i in range(25)] + [(100, "only three words"), (101, None), (102, ""), (103, "go go go go go go go go go")]
    docs = []
    for i in range(120):
        parts = [text(rnd.randint(0, 120)), text(rnd.randint(0, 120))]
        if i % 2:
            w = items[rnd.randrange(25)][1].split()
            for _ in range(i % 5):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            if i % 7 == 0:
                w = w[: len(w) * 4 // 5]
            parts.insert(1, " \n".join(w).title())
        docs.append((i, " ".join(parts)))
    return docs + [(500, items[0][1]), (501, None), (502, ""), (503, "Only  three WORDS"), (504, "with only three words here"), (505, "go " * 12),
                   (None, items[1][1]), (506, ("z " * 200) + items[2][1] + (" z" * 200))], items


@pytest.mark.parametrize("seed", [3, 4])
def test_same_as_all_windows(documents, spark, seed):
    docs, items = corpus(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in find_contamination(documents(docs), bench).collect()}
    assert got == best_windows(docs, items)


def test_blocks_of_items_give_the_same(documents, spark):
    docs, items = corpus(5)
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, find_contamination(documents(docs[:60]), bench).drop("doc_id").collect()))
    assert whole == sorted(map(tuple, find_contamination(documents(docs[:60]), bench, block_bytes=500).drop("doc_id").collect()))


def test_clean_documents_stay_with_their_columns(documents, spark):
    docs, items = corpus(6)
    table = documents(docs)
    kept = drop_contaminated(table, spark.createDataFrame(items, "item_id long, text string"))
    dirty = {d for d, _ in best_windows(docs, items)}
    assert kept.columns == table.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(d or -1 for d, _ in docs if d not in dirty)


def test_long_text(documents, spark):
    bench = spark.createDataFrame([(7, "one two three four five six seven eight nine ten")], "item_id long, text string")
    text = "z " * 40_000 + "One two three four five six seven\neight nine ten" + " z" * 40_000
    got = find_contamination(documents([(506, text), (507, "z " * 80_000)]), bench).collect()
    assert [(r.doc_id, r.item_id, r.similarity, r.first_word, r.hamming) for r in got] == [(506, 7, 1.0, 40_000, 0)]


def test_empty_tables(documents, spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    docs = documents([(1, "a b c d e")])
    assert find_contamination(docs, bench).count() == 0 and drop_contaminated(docs, bench).count() == 1
    assert find_contamination(documents([]), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")).count() == 0


def test_hamming_blocks_find_all_within_the_radius():
    import numpy as np
    rnd = random.Random(1)
    index = ItemIndex([(i, " ".join(f"w{rnd.randrange(900)}" for _ in range(20))) for i in range(200)], radius=9)
    prints = np.array([rnd.getrandbits(64) for _ in range(50)] + [int(p) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 12))) for p in index.prints], dtype=np.uint64)
    w, k = index.near(prints, 20, np.ones(200, dtype=bool))
    want = {(i, j) for i in range(len(prints)) for j in range(200) if (int(prints[i]) ^ int(index.prints[j])).bit_count() <= 9}
    assert set(zip(w.tolist(), k.tolist())) == want and len(want) > 100


def test_many_items_of_one_size_take_little_memory():
    import tracemalloc
    from cropseries.llm.decontamination import search_texts
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    # all items begin alike, so a text with that beginning holds a shingle of each
    items = [(i, "all of them begin like this " + " ".join(rnd.choices(words, k=20))) for i in range(20_000)]
    text = " ".join(rnd.choices(words, k=3000)) + " all of them begin like this " * 40 + " ".join([items[77][1], *rnd.choices(words, k=3000), items[13_000][1]])
    tracemalloc.start()
    index = ItemIndex(items)
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    found = next(search_texts(index, [text.encode()]))
    assert {items[k][0]: round(v, 6) for k, (v, _, _) in found.items()} == {77: 1.0, 13_000: 1.0}
    assert tracemalloc.get_traced_memory()[1] - before < 60 << 20
    tracemalloc.stop()

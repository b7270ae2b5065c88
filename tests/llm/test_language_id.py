import zlib

import numpy as np

from cropseries.llm.language_id import features, fit_on_documents, identify_languages, keep_identified


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = identify_languages(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert len(held) > 20 and (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_held_out_labels_are_not_learned(documents):
    rows = [(i, "uno dos tres" if i % 2 else "one two three", "es" if i % 2 else "en") for i in range(40)]
    poisoned = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else l) for i, t, l in rows]
    assert fit_on_documents(documents(poisoned)).languages == ["en", "es"]
    assert {r.lang_pred for r in identify_languages(documents(poisoned)).collect()} == {"en", "es"}


def test_odd_texts(documents):
    rows = [(i, "uno dos tres cuatro" if i % 2 else "one two three four", "es" if i % 2 else "en") for i in range(40)]
    odd = [(100, None), (101, ""), (102, "12 !?"), (103, "four " * 300_000, None), (None, "uno dos", None), (104, "one", None), (105, None, "en"), (1, "uno dos tres cuatro", "es")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_languages(documents(rows + odd)).collect()}
    assert got[100] == got[101] == got[102] == got[105] == ("und", 0.0)
    assert got[103][0] == got[104][0] == "en" and got[None][0] == "es"
    kept = keep_identified(documents(rows + odd))
    assert {r.doc_id for r in kept.collect()} == {*range(40), 103, 104, None} and kept.columns == documents(rows).columns


def test_matches_the_textbook_formula(documents):
    rows = [(i, t, l) for i, (t, l) in enumerate([("abba", "x"), ("bccb", "y"), ("aabb", "x"), ("ccaa", "y"), ("abcabc", "y"), ("bbbb", "x")] * 3)]
    model = fit_on_documents(documents(rows))
    learn = [(t, l) for i, t, l in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    buckets = model.log_probs.shape[0]
    for text in ("abca", "cc"):
        ids = np.concatenate(list(features(text)))
        totals = []
        for lang in model.languages:
            counts = np.bincount(np.concatenate([np.concatenate(list(features(t))) for t, l in learn if l == lang]), minlength=buckets) + 0.1
            totals.append(np.log(counts / counts.sum())[ids].sum() + np.log(sum(l == lang for _, l in learn) / len(learn)))
        share = np.exp(totals - np.max(totals)) / np.exp(totals - np.max(totals)).sum()
        names, scores = model.scores([text])
        assert names == [model.languages[int(np.argmax(totals))]] and abs(scores[0] - share.max()) < 1e-9


def test_pieces_count_each_gram_once(monkeypatch):
    from cropseries.llm import language_id
    text = "abcdefghij" * 20
    whole = sorted(np.concatenate(list(features(text))).tolist())
    monkeypatch.setattr(language_id, "PIECE", 7)
    assert sorted(np.concatenate(list(features(text))).tolist()) == whole


def test_nothing_to_learn(documents):
    assert identify_languages(documents([])).count() == 0
    assert [r.lang_pred for r in identify_languages(documents([(1, "text", None)])).collect()] == ["und"]

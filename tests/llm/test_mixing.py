import pytest

from cropseries.llm.mixing import mix_sources, mixed_documents
from helpers import WORD


def targets(sizes, weights=(5, 2, 1), repeats=3):
    """Share the total by weight; what is over a cap is reshared until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        rest, share = total - sum(capped.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / share >= repeats * sizes[s]]
        if not over:
            return {**capped, **{s: rest * weight[s] / share for s in open_}}
        capped |= {s: repeats * sizes[s] for s in over}
        if len(capped) == len(names):
            return capped


def corpus():
    rows = []
    for i in range(900):
        source = "big" if i % 3 == 0 else ["a", "B", None, "", "zz", "\U0001F600"][i % 6]
        rows.append((i, "w " * (1 + i * 7 % 23), "en", source))
    return rows + [(1000, None, "en", "a"), (1001, "  ", "en", "nothing"), (1, "again and again", "en", "a"), (1, "again and again", "en", "a"), (None, "no id here", "en", "B")]


def test_targets_and_taken(documents):
    data = corpus()
    got = mix_sources(documents(data)).toPandas()
    assert len(got) == len(data)
    sizes = {}
    for _, text, _, source in data:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    want = targets(sizes)
    for source, size in sizes.items():
        mine = got[got.source.isna()] if source is None else got[got.source == source]
        assert set(mine.source_size) == {size}
        assert mine.target.iloc[0] == pytest.approx(want[source])
        assert abs(mine.taken.sum() - want[source]) <= mine["size"].max()
    assert (got.taken <= 3 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    assert got.taken.sum() <= sum(sizes.values()) and got.taken.sum() > sum(sizes.values()) - 30


def test_reruns_agree_whatever_the_partitions(documents):
    a = mix_sources(documents(corpus())).toPandas().sort_values(["doc_id", "size", "taken"]).reset_index(drop=True)
    b = mix_sources(documents(corpus()).repartition(5)).toPandas().sort_values(["doc_id", "size", "taken"]).reset_index(drop=True)
    assert a.equals(b)


def test_mixed_rows_repeat(documents):
    data = [(i, "one two three", "en", "small" if i < 3 else "large") for i in range(60)]
    docs = documents(data)
    taken = {r.doc_id: r.copies for r in mix_sources(docs).collect()}
    out = mixed_documents(docs).collect()
    assert {i: sum(r.doc_id == i for r in out) for i in range(60)} == taken and set(out[0].asDict()) == set(docs.columns)
    assert max(taken.values()) == 3


def test_repeated_ids_and_clashing_columns(documents):
    from pyspark.sql import functions as F
    data = [(i // 2, f"w{i % 2} " * 10, "en", "small" if i < 40 else "large") for i in range(400)]
    docs = documents(data).withColumns({"_copies": F.lit("c"), "mix_row": F.lit("m"), "row": F.lit("r"), "mix_copy": F.lit(0)})
    out = mixed_documents(docs)
    got = out.collect()
    assert out.columns == docs.columns and {(r._copies, r.mix_row, r.row) for r in got} == {("c", "m", "r")}
    assert 10 * len(got) == sum(r.taken for r in mix_sources(docs).collect()) == 4000
    assert 10 * sum(r.source == "small" for r in got) == 1140  # two sevenths of 4000, in whole documents
    equal = documents([(1, "same words", "en", "a")] * 30 + [(2, "other text here", "en", "b")] * 30)
    assert sum(len(r.text.split()) for r in mixed_documents(equal).collect()) == sum(r.taken for r in mix_sources(equal).collect())


def test_empty_and_wordless(documents):
    assert mix_sources(documents([])).count() == 0
    assert [r.taken for r in mix_sources(documents([(1, None), (2, " ")])).collect()] == [0, 0]

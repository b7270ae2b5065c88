import hashlib
import re

import pytest
from pyspark.sql import functions as F

from cropseries.llm.exact_dedup import dedup_exact


def expected(rows):
    norm = {}
    for doc, text in rows:
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((doc, text or ""))
    out = []
    for text, members in norm.items():
        ids = [(-len(t), d) for d, t in members if d is not None]
        longest = max(len(t) for _, t in members)
        best = min(((-len(t), d is None, d) for d, t in members), key=lambda x: (x[0], x[1], x[2] or 0))
        keep = best[2]
        for d, _ in members:
            out.append((d, keep, len(members), d is not None and d == keep, hashlib.sha256(text.encode()).hexdigest()))
        assert longest == -best[0] and (ids or keep is None)
    return out


CASES = [(5, "a b  c"), (3, "abc"), (9, "a bé"), (1, "abé "), (2, None), (4, " \t\n"), (7, ""), (8, "x" * 50_000), (11, "x " * 50_000),
         (20, "dup"), (20, "dup"), (None, "lonely"), (None, "abc"), (30, "\U0001F600 a"), (31, "\U0001F600a "), (-4, "dup"), (40, " abc")]


def test_same_as_plain_loop(documents, rows):
    got = rows(dedup_exact(documents(CASES)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(expected(CASES), key=key)


def test_texts_that_share_a_digest_stay_apart(documents, rows):
    first_letter = lambda text: F.substring(text, 1, 1)
    got = rows(dedup_exact(documents(CASES), digest=first_letter), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(expected(CASES), key=key)


def test_one_group_holds_most_rows(documents, rows):
    data = [(i, "same text" if i % 3 else f"own {i}") for i in range(600)]
    got = {r[0]: r[1:] for r in rows(dedup_exact(documents(data).repartition(7)), "doc_id", "keep_id", "group_size")}
    assert got[5] == (1, 400) and got[3] == (3, 1) and len(got) == 600


def test_empty_table(documents):
    assert dedup_exact(documents([])).count() == 0


@pytest.mark.parametrize("node", ["Python", "Arrow", "Pandas"])
def test_no_python_in_the_plan(documents, node):
    assert node not in dedup_exact(documents(CASES, clash=False))._jdf.queryExecution().executedPlan().toString()

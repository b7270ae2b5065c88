import random
import string
import zlib
from collections import Counter

import numpy as np
import pytest

from cropseries.llm.token_files import FILE_DDL, MIN_COUNT, WordEncoder, decode_block, read_token_files, read_tokens, repair, tokenizer_path, write_token_files


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def corpus():
    rnd = random.Random(5)
    syllables = ["an", "on", "the", "ti", "é", "Ü", "sh", "re", "ß", "ñ"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) + rnd.choice(["", "", ".", ",", "!?", "'s", "'S", "...", ".5", "-"])
    rows = [(i * 7 % 501, rnd.choice([" ", "\n", "  \t"]).join(word() for _ in range(rnd.randint(0, 60)))) for i in range(400)]
    return rows + [(900, None), (901, ""), (902, " \n "), (903, "x <|endoftext|> y<|startoftext|>z <|ENDOFTEXT|>"), (904, "a\u0301 A\u0301\u00a0K\u2028b ſ K İ"),
                   (905, "the same " * 20_000), (906, "don't DON'T can.t 12,5 a.,b a.é"), (None, "no id"), (907, "..., .,"), (908, "twice"), (908, "twice"), (909, "ΟΔΟΣ ΣΑΣ.")]


def test_round_trip(documents, spark, tokenizer, tmp_path):
    data = corpus()
    write_token_files(documents(data).repartition(3), str(tmp_path / "t"), block_ids=5000)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_token_files(spark, str(tmp_path / "t")).collect()))
    want, at = [], 0
    for doc, text in sorted(data, key=lambda r: (r[0] is None, r[0] or 0, len(r[1] or ""))):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((at, doc, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert got == want
    for row in spark.read.schema(FILE_DDL).parquet(str(tmp_path / "t")).limit(3).collect():
        row = row.asDict()
        docs, n, ids = decode_block(row)
        ends = np.cumsum(n)
        for k in range(0, len(docs), 7):
            whole = ids[ends[k] - n[k]:ends[k]]
            assert read_tokens(row, k).tolist() == whole.tolist()
            a, b = len(whole) // 3, max(len(whole) * 2 // 3, len(whole) // 3)
            assert read_tokens(row, k, a, b).tolist() == whole[a:b].tolist()


def test_repeats_are_replaced_and_expand_again():
    rnd = np.random.default_rng(1)
    phrase = rnd.integers(10, 2000, 40)
    ids = np.concatenate([np.concatenate((phrase, rnd.integers(10, 2000, 5), [1])) for _ in range(300)] + [np.full(5001, 7), [1]]).astype(np.uint32)
    symbols, grammar = repair(ids, 5000)
    assert len(symbols) < len(ids) / 4 and grammar.expand(symbols).tolist() == ids.tolist()
    assert all(a < 5000 + r and b < 5000 + r for r, (a, b) in enumerate(grammar.rules.tolist()))
    assert 1 not in grammar.rules


def test_nothing_to_replace():
    ids = np.array([5, 6, 7, 1], dtype=np.uint32)
    symbols, grammar = repair(ids, 5000)
    assert symbols.tolist() == ids.tolist() and grammar.expand(symbols).tolist() == ids.tolist()


def test_empty_table(documents, spark, tmp_path):
    write_token_files(documents([]), str(tmp_path / "t"))
    assert read_token_files(spark, str(tmp_path / "t")).count() == 0


def test_random_access_where_a_text_holds_the_end_id(documents, spark, tokenizer, tmp_path):
    data = [(1, "plain words"), (2, '"$5 and "$6'), (3, None), (4, '"'), (5, 'the same ' * 200 + '"$5'), (6, "after it"), (7, '"$5')]
    assert 1 in tokenizer.encode('"$5', add_special_tokens=False).ids
    write_token_files(documents(data).coalesce(1), str(tmp_path / "t"))
    seen = {}
    for row in spark.read.schema(FILE_DDL).parquet(str(tmp_path / "t")).collect():
        row = row.asDict()
        assert np.frombuffer(row["doc_symbols"], "<u4").sum() == len(row["symbols"]) // 2
        for k, doc in enumerate(decode_block(row)[0]):
            seen[doc] = read_tokens(row, k).tolist()
            assert read_tokens(row, k, 1, 3).tolist() == seen[doc][1:3]
    assert seen == {d: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for d, t in data}


def same_ids(tokenizer, texts):
    ids, n = WordEncoder.of(tokenizer_path()).encode([t.encode() for t in texts])
    ends = np.cumsum(n)
    return [t for t, a, b in zip(texts, ends - n, ends) if ids[a:b].tolist() != tokenizer.encode(t, add_special_tokens=False).ids + [1]]


def test_every_letter_before_every_punctuation_mark(tokenizer):
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    texts = [f"taks{a}{b}" for a in letters for b in string.punctuation] + [f"{a}{b}{a}" for a in letters for b in ".'-"]
    assert same_ids(tokenizer, texts) == [] and same_ids(tokenizer, ["TAKS\u0130.", "\u0130", "\u0130!", "a\u0130\u0307."]) == []


def test_random_strings(tokenizer):
    rnd = random.Random(6)
    alphabet = "abzAZ019'.,-!?\"#" + "\u00c4\u00df\u0130\u0131\u0149\u017f\u01c5\u0307\u0301\u212a\u00a0\u2028\u00ad\u00aa\u0660\u4e2d\U0001f600" + " \n\t"
    assert same_ids(tokenizer, ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 12))) for _ in range(20_000)]) == []


def test_no_frequent_pair_is_left():
    rnd = np.random.default_rng(7)
    phrase = rnd.integers(10, 2000, 400)
    ids = np.concatenate([np.concatenate((phrase, [1])) for _ in range(50)] + [rnd.integers(10, 2000, 3000)]).astype(np.uint32)
    symbols, grammar = repair(ids, 5000, per_round=64)
    pairs = Counter(zip(symbols[:-1].tolist(), symbols[1:].tolist()))
    assert grammar.lengths.max() > 32 and grammar.expand(symbols).tolist() == ids.tolist()
    assert all(n < MIN_COUNT or 1 in p or p[0] == p[1] for p, n in pairs.items())

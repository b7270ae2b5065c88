import pytest
from pyspark.sql import functions as F

from cropseries.llm.chat import join_segments, rotate_perspectives

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture
def turns(spark):
    def make(rows):
        return spark.createDataFrame(rows, SCHEMA).withColumn("start", F.lit("x")).withColumn("perspective", F.lit("x")).withColumn("speaker", F.lit(1))
    return make


def plain(rows):
    """conversation -> perspective -> (text, loss spans)"""
    out, esc = {}, lambda s: s.replace("\\", "\\\\").replace("<|", "<\\|")
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is None, t or 0, (s or "unknown").replace("\n", " "), x or "") for c, t, s, x in rows if c == conv))
        for view in {s for _, _, s, _ in mine} - {"system"}:
            text, spans = "", []
            for _, _, speaker, words in mine:
                role = "system" if speaker == "system" else "assistant" if speaker == view else "user"
                text += f"<|{role}" + (f" name={esc(speaker)}" if role == "user" else "") + "|>\n"
                begin = len(text)
                text += esc(words) + "<|end|>\n"
                if role == "assistant":
                    spans.append((begin, len(text) - 1))
            out[conv, view] = (text, spans)
    return out


ROWS = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi \U0001F600"), (1, 2, "bob", "Hello <|end|> \\ ann"), (1, 3, "ann", None), (1, 3, "ann", None),
        (2, 0, "user", "é"), (2, None, "assistant", "late"), (3, 0, "system", "alone"), (None, 0, "user", "no id"), (None, 1, None, "nobody"),
        (4, 0, "two\nlines", "x" * 70_000), (4, 1, "<|user|>", "")]


def test_same_as_plain_rendering(turns):
    segments = rotate_perspectives(turns(ROWS).repartition(3))
    got = {(r.conv_id, r.perspective): (r.text, [(s.start, s.end) for s in r.loss_spans]) for r in join_segments(segments).collect()}
    assert got == plain(ROWS)


def test_segments_are_gapless(turns):
    rows = [(7, t, f"p{t % 3}", f"turn {t}") for t in range(300)] + [(8, 0, "a", "b")]
    got = sorted((r.segment, r.start, r.end) for r in rotate_perspectives(turns(rows)).filter("conv_id = 7 and perspective = 'p1'").collect())
    assert [s for s, _, _ in got] == list(range(300)) and all(a[2] == b[1] for a, b in zip(got, got[1:]))


def test_empty_table(turns):
    assert rotate_perspectives(turns([])).count() == 0

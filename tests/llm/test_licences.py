import random
import re
import time

from cropseries.llm.licences import TEMPLATES, full_texts, scan_licences
from helpers import LOWER


def pairs(text):
    w = re.findall(r"[0-9]+(?:\.[0-9]+)+|[^\W_]+", text.translate(LOWER))
    return {" ".join(p) for p in zip(w, w[1:])} if len(w) > 1 else set(w)


def expected(rows, templates=TEMPLATES, least=0.75):
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        for no, unit in [*([(0, text)] if len(lines) > 1 else []), *enumerate(lines, 1)]:
            for name, template in templates.items():
                a, b = pairs(unit), pairs(template)
                dice = 2 * len(a & b) / (len(a) + len(b)) if a or b else 0
                if dice >= least:
                    out.append((doc, no, name, round(dice, 9)))
    return sorted(out, key=str)


ROWS = [(1, "text\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "released under the MIT licence!\n  RELEASED   under the mit License"), (3, None),
        (4, ""), (5, "This work is licensed under the\nGNU General Public License, version 3."), (6, "Licensed under CC BY-NC 4.0 now"), (None, "Released under the MIT License."),
        (7, "No licence here, under the sun.\n" * 2000), (8, "Licensed under the Apache License, Version 1.1."), (1, "Released under the MIT License."), (1, "Released under the MIT License.")]


def test_same_as_plain_comparison(documents):
    got = sorted(((r.doc_id, r.line_no, r.licence, round(r.dice, 9)) for r in scan_licences(documents(ROWS)).collect()), key=str)
    assert got == expected(ROWS) and len(got) >= 7


def test_own_templates(documents):
    own = {"one": "proprietary", "none": "", "two": "all rights reserved"}
    rows = [(1, "Proprietary"), (2, "All rights reserved."), (3, "x proprietary")]
    got = sorted(((r.doc_id, r.line_no, r.licence, r.dice) for r in scan_licences(documents(rows), own).collect()), key=str)
    assert got == [(1, 1, "one", 1.0), (2, 1, "two", 1.0)]


def test_empty(documents):
    assert scan_licences(documents([])).count() == 0 and scan_licences(documents([(1, "x")]), {}).count() == 0


def test_no_python_in_the_plan(documents):
    plan = scan_licences(documents(ROWS, clash=False))._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("Python", "Arrow", "Pandas"))


def test_statements_within_lines_wrapped_and_in_full(documents):
    fill = " ".join(f"word{i}" for i in range(300))
    mit, apache = full_texts()["MIT"][0], TEMPLATES["Apache-2.0"]
    rows = [(1, f"{fill} text. {apache} All rights reserved by the authors {fill}"),
            (2, f"{fill}\nThis work is licensed under the\nGNU General Public License, version 3.\n{fill}"),
            (3, f"{fill}\nCopyright someone\n\n{mit}\n{fill} {fill} {fill} {fill}"), (4, mit), (5, f"{fill}\n{apache}\n{fill}"),
            (6, f"{fill} {apache} {fill} {apache}\n{fill} {TEMPLATES['MIT']} {fill}"), (7, f"the apache license of {fill} version 2.0 licensed under"),
            (8, f"{fill} # {mit} # {fill} {fill} {fill} {fill}".replace("\n", " "))]
    got = sorted((r.doc_id, r.line_no, r.licence, round(r.dice, 3)) for r in scan_licences(documents(rows)).collect())
    assert got == [(1, 1, "Apache-2.0", 1.0), (2, 2, "GPL-3.0", 1.0), (3, 4, "MIT", 1.0), (4, 0, "MIT", 1.0), (5, 2, "Apache-2.0", 1.0),
                   (6, 1, "Apache-2.0", 1.0), (6, 1, "Apache-2.0", 1.0), (6, 2, "MIT", 1.0), (8, 1, "MIT", 1.0)]


def windows(rows, templates, least=0.75):
    """All windows, and of those that overlap the ones that the operator keeps."""
    found = re.compile(r"[0-9]+(?:\.[0-9]+)+|[^\W_]+")
    out = []
    for doc, text in rows:
        lines = text.split("\n")
        words = [(w, no) for no, line in enumerate(lines, 1) for w in found.findall(line.translate(LOWER))]
        chain = [(" ".join((a, b)), i, j) for (a, i), (b, j) in zip(words, words[1:])]
        dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 0
        for name, template in templates.items():
            t = pairs(template)
            if dice({p for p, _, _ in chain}, t) >= least:
                continue
            stated = {no for no, line in enumerate(lines, 1) if dice(pairs(line), t) >= least}
            best = []
            for start, (p, first, _) in enumerate(chain):
                here = [(dice({q for q, _, _ in chain[start:stop + 1]}, t), -stop) for stop in range(start, min(start + int(len(t) * (2 - least) / least + 1e-9), len(chain)))
                        if chain[stop][0] in t] if p in t else []
                if here and max(here)[0] >= least and not any(first <= no <= chain[-max(here)[1]][2] for no in stated):
                    best.append((start, -max(here)[1], max(here)[0]))
            while best:
                group = [w for w in best if w[0] <= best[0][1]]
                winner = max(group, key=lambda w: (w[2], -w[0]))
                out.append((doc, chain[winner[0]][1], name, round(winner[2], 9)))
                best = [w for w in best if w[0] > max(best[0][1], winner[1])]
    return out


def test_windows_as_all_windows(documents):
    rnd = random.Random(8)
    own = {k: TEMPLATES[k] for k in ("MIT", "Apache-2.0", "GPL-3.0")}
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randint(1, 6)):
            words = rnd.choice(list(own.values())).split()
            for _ in range(rnd.randint(0, 2)):
                words[rnd.randrange(len(words))] = rnd.choice(["other", "the", "", "License", "2.0", "3.1"])
            parts += words + [rnd.choice(["x", "y", "the", "under"]) for _ in range(rnd.choice([0, 1, 9]))]
        rows.append((i, "".join(w + rnd.choice([" ", " ", " ", " ", "\n"]) for w in parts)))
    got = sorted(((r.doc_id, r.line_no, r.licence, round(r.dice, 9)) for r in scan_licences(documents(rows), own).collect()), key=str)
    want = windows(rows, own)
    assert got == sorted(expected(rows, own) + want, key=str) and len(want) > 50


def test_time_grows_with_the_length_of_a_text(documents):
    rnd = random.Random(9)

    def seconds(n):
        fill = [" ".join(f"w{rnd.randint(0, 5000)}" for _ in range(n // 2)) for _ in range(2)]
        rows = documents([(1, f"{fill[0]} {TEMPLATES['MIT']} {fill[1]}")])
        start = time.perf_counter()
        assert [(r.licence, r.dice) for r in scan_licences(rows, {"MIT": TEMPLATES["MIT"]}).collect()] == [("MIT", 1.0)]
        return time.perf_counter() - start
    seconds(2000)
    assert seconds(40_000) < 20 * seconds(2000)


def test_repeated_statement_is_the_whole_text(documents):
    rows = [(1, "\n".join([TEMPLATES["MIT"]] * 30))]
    got = sorted((r.doc_id, r.line_no, r.licence, round(r.dice, 9)) for r in scan_licences(documents(rows), {"MIT": TEMPLATES["MIT"]}).collect())
    assert got == sorted(expected(rows, {"MIT": TEMPLATES["MIT"]})) and got[0][1:3] == (0, "MIT")

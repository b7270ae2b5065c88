"""Licence scans by Dice coefficient over word bigrams (DataFrame functions only)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from ..session import written_table

#: Names by SPDX and the statements they are usually declared with.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Full licence texts and longer notices, by file name; read on the driver.
TEXTS = Path(__file__).with_name("licence_texts")
DICE = 0.75
MAX_TEMPLATES = 10_000


def normal_words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of letters and digits; dots inside numbers stay, so versions are one word."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(r"([0-9]+(?:\.[0-9]+)+|[\p{L}\p{N}]+)"), F.lit(1))


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words; a single word is its own pair, nothing has none."""
    n = F.size(words)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat_ws(" ", F.element_at(words, i.cast("int")), F.element_at(words, (i + 1).cast("int"))))
    return F.array_distinct(F.when(n > 1, pairs).when(n == 1, words).otherwise(F.array().cast("array<string>")))


def bigrams_of(text: Column) -> Column:
    """Bigrams of a text; the lambda binds its words, so that they are extracted once and not for each pair."""
    return F.get(F.transform(F.array(normal_words(text)), bigrams), 0)


def dice_bounds(size: Column, threshold: float) -> tuple[Column, Column]:
    """Fewest and most bigrams that a set may have to reach the threshold with one of ``size`` bigrams."""
    return F.ceil(size * threshold / (2 - threshold) - 1e-9), F.floor(size * (2 - threshold) / threshold + 1e-9)


def full_texts() -> dict[str, list[str]]:
    """The texts of ``TEXTS`` by SPDX name; the Creative Commons licences have none there."""
    found: dict[str, list[str]] = {}
    for file in sorted(TEXTS.glob("*.txt")):
        found.setdefault(file.name.removesuffix(".txt").removesuffix(".notice"), []).append(file.read_text())
    return found


def _strings(values: Sequence[str]) -> Column:
    """A literal array of words or bigrams, which hold no line feed."""
    return F.split(F.lit("\n".join(values)), "\n")


def _least_shared(size: int, threshold: float) -> int:
    """Fewest bigrams that any set shares with one of ``size`` bigrams at the threshold: where it lies within the other."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9)


def _rare_grams(grams: Sequence[str], threshold: float) -> tuple[list[str], int]:
    """The longest bigrams of a template, some more than a text that reaches the threshold may lack, and how many of them it holds."""
    allowed = len(grams) - _least_shared(len(grams), threshold)
    taken = sorted(grams, key=lambda g: (-len(g), g))[:allowed + 1 + len(grams) // 10]
    return taken, len(taken) - allowed


def _possible(rows: DataFrame, known: Sequence[tuple[str, list[str]]], threshold: float) -> DataFrame:
    """The rows (_id, _text) whose text may state a licence in any unit or window, which all lie within its words.

    Such a text holds enough of the longest bigrams of a template, and so enough of the longer words of those; words go first, since
    bigrams cost more. A lambda binds the words, and a generator keeps the answer from being computed twice."""
    single = sorted({g for _, grams in known for g in grams if " " not in g})
    words, pairs = [], []
    for taken, least in [_rare_grams(grams, threshold) for _, grams in known if " " in grams[0]]:
        long = [max(g.split(" "), key=lambda w: (len(w), w)) for g in taken]
        words.append((sorted(set(long)), -(-least // max(map(long.count, long)))))
        pairs.append((taken, least))

    def enough(held: Column, asked: list[tuple[list[str], int]]) -> Column:
        some = F.lit(False)
        for values, least in asked:
            some = some | ((F.size(held) >= least) & (F.size(F.array_intersect(held, _strings(values))) >= least))
        return some

    def probe(df: DataFrame, of_words, asked: list[tuple[list[str], int]]) -> DataFrame:
        every = _strings(sorted({v for values, _ in asked for v in values}))
        value = lambda w: F.transform(F.array(F.array_intersect(of_words(w), every)), lambda held: enough(held, asked)) if asked else F.array(F.lit(False))
        test = lambda w: F.get(value(w), 0) | (F.arrays_overlap(w, _strings(single)) if single else F.lit(False))
        tested = df.select("_id", "_text", F.explode(F.transform(F.array(normal_words(F.col("_text"))), test)).alias("_some"))
        return tested.filter("_some").select("_id", "_text")

    joined = lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(
        " ", F.element_at(w, i.cast("int")), F.element_at(w, (i + 1).cast("int"))))).otherwise(F.array().cast("array<string>"))
    return probe(probe(rows.filter("_text <> ''"), lambda w: w, words), joined, pairs)


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that lambdas read: behind a generator it is computed once for a row, and not again for each element."""
    return rows.withColumn(name, F.explode(F.array(value)))


def _windows(rows: DataFrame, known: Sequence[tuple[str, list[str]]], threshold: float) -> DataFrame:
    """Statements within longer units or across lines: (_id, line_no, licence, dice) of the windows of ``scan_licences``."""
    known = [(name, grams) for name, grams in known if " " in grams[0]]
    if not known:
        return rows.filter("false").select("_id", F.lit(0).alias("line_no"), F.lit("").alias("licence"), F.lit(0.0).alias("dice"))
    words_of = lambda line, i: F.transform(normal_words(line), lambda w: F.struct(w.alias("w"), (i + 1).alias("line")))
    rows = rows.withColumn("_lines", F.split("_text", "\n")).withColumn("_w", F.flatten(F.transform("_lines", words_of))).filter(F.size("_w") > 1)
    word = lambda i: F.element_at("_w", i.cast("int"))
    rows = rows.withColumn("_pairs", F.transform(F.sequence(F.lit(1), F.size("_w") - 1), lambda i: F.struct(
        F.concat_ws(" ", word(i)["w"], word(i + 1)["w"]).alias("p"), word(i)["line"].alias("a"), word(i + 1)["line"].alias("b"))))
    rows = rows.withColumn("_set", F.array_distinct(F.col("_pairs.p")))
    every = sorted({g for _, grams in known for g in grams})
    rows = rows.withColumn("_known", F.array_intersect("_set", _strings(every)))

    per_licence = {}
    for name, grams in known:
        per_licence.setdefault(name, []).append(grams)
    candidates = []
    for name, several in per_licence.items():
        states, templates = F.lit(False), []
        for grams in several:
            t, need, shared = len(grams), _least_shared(len(grams), threshold), F.size(F.array_intersect("_known", _strings(grams)))
            # a text that states the licence as a whole (line_no 0, or its one line) is found already
            states = states | (2 * shared / (F.size("_set") + t) >= threshold)
            templates.append(F.when(shared >= need, F.struct(_strings(grams).alias("g"), F.lit(t).alias("t"), F.lit(need).alias("need"),
                                                             F.lit(math.floor(t * (2 - threshold) / threshold + 1e-9)).alias("most"))))
        templates = F.filter(F.array(*templates), lambda x: x.isNotNull())
        candidates.append(F.when(~states & (F.size(templates) > 0), F.struct(F.lit(name).alias("licence"), templates.alias("templates"))))
    rows = rows.select("_id", "_lines", "_pairs", F.explode(F.filter(F.array(*candidates), lambda c: c.isNotNull())).alias("_c"))

    # position of each pair's last occurrence before it: in a window only the first occurrence counts
    ordered = F.array_sort(F.transform("_pairs", lambda x, i: F.struct(x["p"].alias("p"), i.alias("i"))))
    rows = rows.withColumn("_o", ordered)
    earlier = lambda x, k: F.when((k > 0) & (F.get("_o", k - 1)["p"] == x["p"]), F.get("_o", k - 1)["i"]).otherwise(-1)
    rows = _once(rows, "_before", F.array_sort(F.transform("_o", lambda x, k: F.struct(x["i"].alias("i"), earlier(x, k).alias("before"))))).drop("_o")
    # of each template: which pairs it holds; windows start and end with such a pair
    marked = lambda t: F.struct(t.dropFields("g").alias("t"), F.transform("_pairs", lambda x, i: F.struct(
        i.alias("i"), F.get("_before", i)["before"].alias("before"), F.array_contains(t["g"], x["p"]).alias("hit"))).alias("marks"))
    rows = rows.withColumn("_m", F.transform("_c.templates", marked))
    rows = rows.withColumn("_m", F.transform("_m", lambda m: m.withField("hits", F.filter(m["marks"], lambda x: x["hit"])["i"])))

    def best_from(m: Column, start: Column) -> Column:
        """The best of the windows that begin at ``start``."""
        def step(acc: Column, x: Column) -> Column:
            new = x["before"] < start
            n = acc["n"] + new.cast("int")
            c = acc["c"] + (new & x["hit"]).cast("int")
            dice = 2 * c / (n + m["t"]["t"])
            better = x["hit"] & (dice > acc["dice"])
            return F.struct(n.alias("n"), c.alias("c"), F.when(better, dice).otherwise(acc["dice"]).alias("dice"), F.when(better, x["i"]).otherwise(acc["stop"]).alias("stop"))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("c"), F.lit(0.0).alias("dice"), start.alias("stop"))
        return F.aggregate(F.slice(m["marks"], start + 1, m["t"]["most"]), zero, step,
                           lambda acc: F.struct(start.alias("start"), acc["stop"].alias("stop"), acc["dice"].alias("dice")))

    def found_in(m: Column) -> Column:
        enough = F.filter(m["hits"], lambda start, h: F.get(m["hits"], h + m["t"]["need"] - 1) - start < m["t"]["most"])
        return F.filter(F.transform(enough, lambda start: best_from(m, start)), lambda w: w["dice"] >= threshold)

    rows = rows.withColumn("_found", F.array_sort(F.flatten(F.transform("_m", found_in)))).drop("_m", "_before")
    # lines that state the licence as they are
    states_one = lambda held: F.exists("_c.templates", lambda t: 2 * F.size(F.array_intersect(held, t["g"])) / (F.size(held) + t["t"]) >= threshold)
    stated = lambda line: F.get(F.transform(F.array(bigrams_of(line)), states_one), 0)
    rows = _once(rows, "_stated", F.filter(F.transform("_lines", lambda line, i: F.when(stated(line), i + 1)), lambda i: i.isNotNull()))
    first_line = lambda w: F.get("_pairs", w["start"])["a"]
    last_line = lambda w: F.get("_pairs", w["stop"])["b"]
    rows = rows.withColumn("_found", F.filter("_found", lambda w: ~F.exists("_stated", lambda i: i.between(first_line(w), last_line(w)))))

    # from left to right: of the windows that overlap the first one, the best; then on behind it
    none = F.lit(None).cast("struct<start:int,stop:int,dice:double>")
    def choose(acc: Column, w: Column) -> Column:
        opens = acc["best"].isNull() | ((w["start"] > acc["anchor"]) & (w["start"] > acc["best"]["stop"]))
        better = ~opens & (w["start"] <= acc["anchor"]) & (w["dice"] > acc["best"]["dice"])
        return F.struct(F.when(opens & acc["best"].isNotNull(), F.concat(acc["out"], F.array(acc["best"]))).otherwise(acc["out"]).alias("out"),
                        F.when(opens, w["stop"]).otherwise(acc["anchor"]).alias("anchor"), F.when(opens | better, w).otherwise(acc["best"]).alias("best"))
    begin = F.struct(F.array().cast("array<struct<start:int,stop:int,dice:double>>").alias("out"), F.lit(-1).alias("anchor"), none.alias("best"))
    chosen = F.aggregate("_found", begin, choose, lambda acc: F.when(acc["best"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["best"]))))
    rows = rows.select("_id", "_pairs", "_c.licence", F.explode(chosen).alias("_h"))
    return rows.select("_id", F.get("_pairs", F.col("_h.start"))["a"].alias("line_no"), "licence", F.col("_h.dice").alias("dice"))


def scan_licences(docs: DataFrame, templates: Mapping[str, str] | None = None, threshold: float = DICE, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per unit of text and licence it states: id, line_no, licence, dice.

    The units are the lines of each text (line_no from 1) and, where it has several lines, the whole text (line_no 0). Besides,
    windows of each text: runs of words within a line or across lines, of as many word pairs as the threshold allows, which begin
    and end with a pair of the template. A window's line_no is the line it begins in. Windows are left out where a line that they
    touch, or the whole text, states the licence already; of windows that overlap, the better goes. A template of one
    word has no windows. Without ``templates``, those of ``TEMPLATES`` and the full licence texts are taken.

    Both sides are normalised to words; a template is a candidate only if the sizes of the bigram sets allow the threshold. Cheap word
    counts go first, so bigrams are made only of units that some template may fit. Every text is read once, to find those that may state a
    licence at all; only they are written for the comparison of their units and windows. The templates are an argument of at
    most ``MAX_TEMPLATES`` entries, held in the plan; nothing is shuffled.

    Null and empty texts state nothing. A unit may state several licences. Null ids and repeated rows are scanned as they
    are; an empty table gives no rows.
    """
    known_as = list(templates.items()) if templates is not None else [*TEMPLATES.items(), *((k, t) for k, many in full_texts().items() for t in many)]
    if len(known_as) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    spark = docs.sparkSession
    listed = spark.createDataFrame(sorted(known_as), "licence string, template string")
    known = [(r["licence"], r["b"]) for r in listed.select("licence", bigrams_of(F.col("template")).alias("b")).collect() if r["b"]]
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = written_table(_possible(rows, known, threshold), "licence-texts") if known else rows
    lines = F.split(F.col("_text"), "\n")
    numbered = F.transform(lines, lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("unit")))
    whole = F.when(F.size(lines) > 1, F.array(F.struct(F.lit(0).alias("line_no"), F.col("_text").alias("unit")))).otherwise(F.array().cast("array<struct<line_no:int,unit:string>>"))
    units = rows.select("_id", F.explode(F.concat(whole, numbered)).alias("_u")).select("_id", F.col("_u.line_no").alias("line_no"), F.col("_u.unit").alias("unit"))
    if not known:
        return units.filter("false").select(F.col("_id").alias(id_col), "line_no", F.lit("").alias("licence"), F.lit(0.0).alias("dice"))
    sizes = [len(b) for _, b in known]
    low = min(-(-int(n * threshold * 1e6) // int((2 - threshold) * 1e6)) for n in sizes)
    # every word needs a character and, but for the last, one between: a text of c characters has at most (c + 1) / 2 words
    long_enough = F.length("unit") + 1 >= 2 * low
    words = units.filter(long_enough).withColumn("words", normal_words(F.col("unit"))).filter(F.size("words") >= max(low, 1))
    sets = words.select("_id", "line_no", bigrams(F.col("words")).alias("b")).withColumn("n", F.size("b"))
    tests = []
    for name, grams in known:
        least, most = dice_bounds(F.lit(len(grams)), threshold)
        dice = 2 * F.size(F.array_intersect("b", _strings(grams))) / (F.col("n") + len(grams))
        tests.append(F.when(F.col("n").between(least, most) & (dice >= threshold), F.struct(F.lit(name).alias("licence"), dice.alias("dice"))))
    hits = F.filter(F.array(*tests), lambda t: t.isNotNull())
    # several templates of a licence: the best
    best = F.filter(hits, lambda t, i: ~F.exists(F.transform(hits, lambda o, k: (o["licence"] == t["licence"]) & ((o["dice"] > t["dice"]) | ((o["dice"] == t["dice"]) & (k < i)))), lambda x: x))
    found = sets.select("_id", "line_no", F.explode(best).alias("hit"))
    units = found.select("_id", "line_no", F.col("hit.licence").alias("licence"), F.col("hit.dice").alias("dice"))
    return units.unionByName(_windows(rows, known, threshold)).select(F.col("_id").alias(id_col), "line_no", "licence", "dice")

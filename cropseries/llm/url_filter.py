"""URL filtering: rules by host and path, and gradient-boosted trees on lexical features for the rest.

DataFrame functions and Spark ML's tree learner only; nothing runs Python on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import written_table

#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "suffix_rate"]
MAX_RULES = 1000
#: Partitions of the training table.
TRAIN_PARTS = 8


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, (at + 3).cast("int")))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_matches(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits host (and its subdomains) and path; null where none does.

    Rules are one conditional expression, longest first, so at most ``MAX_RULES`` are taken."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def lexical_features(df: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """Adds the lexical features of a URL column (null counts as empty), as doubles."""
    text = F.coalesce(F.col(url), F.lit(""))
    n = F.length(text)
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    digits = F.length(F.regexp_replace(text, "[^0-9]", ""))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    values = {
        "length": n, "host_length": F.length(F.col(host)), "path_length": F.length(F.col(path)),
        "depth": F.size(F.filter(F.split(F.col(path), "/"), lambda s: s != "")),
        "labels": F.size(F.filter(F.split(F.col(host), r"\."), lambda s: s != "")),
        "digit_ratio": F.when(n > 0, digits / n).otherwise(0.0), "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "parameters": F.when(query != "", F.size(F.split(query, "&"))).otherwise(0),
        "hyphens": n - F.length(F.replace(text, F.lit("-"), F.lit(""))),
    }
    return df.withColumns({k: v.cast("double") for k, v in values.items()}).withColumn("suffix", F.substring_index(F.col(host), ".", -1))


def train_and_judge(known: DataFrame, unknown: DataFrame, key: str, train_rows: int, rounds: int, depth: int, seed: int) -> DataFrame:
    """``unknown`` with a ``guess`` column (allow or block) of trees trained on ``known`` (features, suffix, verdict).

    The trees are fitted on at most about ``train_rows`` rows, chosen by a seeded hash of ``key``; the suffix statistics
    cover all known rows. With one class only, that class is the guess; without known rows, allow.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    blocked = (F.col("verdict") == "block").cast("double")
    overall = known.agg(F.count("*").alias("n"), F.sum(blocked).alias("blocked")).first()
    n, positive = overall["n"], overall["blocked"] or 0.0
    if positive in (0.0, float(n)):
        return unknown.withColumn("guess", F.lit("block" if n and positive else "allow"))
    prior = positive / n
    # smoothed share of blocked URLs by suffix
    suffixes = known.groupBy("suffix").agg(((F.sum(blocked) + F.lit(10 * prior)) / (F.count("*") + 10)).alias("suffix_rate"))
    with_rate = lambda df: df.join(suffixes, "suffix", "left").fillna(prior, ["suffix_rate"])
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    chosen = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40)) < int(min(1.0, train_rows / n) * (1 << 40))
    # a bounded table, in one order and in few files: the learner sees the same partitions each time, and its many jobs are small
    rows = with_rate(known.filter(chosen)).select(*FEATURES, blocked.alias("label"))
    rows = rows.repartition(TRAIN_PARTS, *FEATURES).sortWithinPartitions(*FEATURES, "label").coalesce(TRAIN_PARTS)
    training = assembler.transform(written_table(rows, "url-training"))
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, stepSize=0.3, maxBins=64).fit(training)
    judged = trees.transform(assembler.transform(with_rate(unknown)))
    return judged.withColumn("guess", F.when(F.col("prediction") > 0.5, "block").otherwise("allow"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = tuple(RULES), id_col: str = "page_id", url_col: str = "url",
                train_rows: int = 200_000, rounds: int = 20, depth: int = 4, seed: int = 42) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict, source_of_verdict (rule or model).

    The longest rule that fits decides. URLs that a rule decides are the labelled ones that the trees learn from; the trees
    judge the others. Host and path are empty for null URLs and those without ``://``; such URLs are judged by the trees.
    Null ids and repeated rows are judged alone, an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    split = rows.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    ruled = split.withColumn("_hit", rule_matches(rules, F.col("host"), F.col("path")))
    ruled = ruled.withColumns({"rule": F.col("_hit.rule"), "verdict": F.col("_hit.verdict")}).drop("_hit")
    decided, open_ = ruled.filter("rule is not null"), ruled.filter("rule is null")
    features = lambda df: lexical_features(df, "_url", "host", "path")
    guessed = train_and_judge(features(decided), features(open_), "_url", train_rows, rounds, depth, seed)
    columns = [F.col("_id").alias(id_col), "host", "path", "rule", "verdict"]
    return (decided.select(*columns, F.lit("rule").alias("decided_by"))
            .unionByName(guessed.select(*columns[:4], F.col("guess").alias("verdict"), F.lit("model").alias("decided_by"))))

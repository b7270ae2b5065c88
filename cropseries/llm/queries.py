"""The registered queries of the text operators, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from . import chat, decontamination, exact_dedup, language_id, licences, mixing, ngram_join, phrases, resampling, secrets, sharding, token_files, url_filter
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn
    return register


@query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256 FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_exact(table(spark, sf_dir, "documents"))


@query(r"""
WITH r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('42:' || coalesce(doc_id::VARCHAR, '')) AS mix FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
             source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT *, sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM w),
f AS (SELECT *, cap * share <= rest * weight AS stops FROM l),
g AS (SELECT rest AS g_rest, share AS g_share FROM f WHERE NOT stops ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN stops OR g_rest IS NULL THEN cap ELSE g_rest * weight / g_share END AS target FROM f LEFT JOIN g ON true),
p AS (SELECT r.*, source_size, target,
             coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY mix, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
c AS (SELECT p.*, copy, (copy * source_size + before + size)::DOUBLE / target AS finish FROM p, unnest([0, 1, 2]) AS x(copy) WHERE size > 0 AND target > 0),
q AS (SELECT doc_id, source, copy, size, sum(size) OVER (ORDER BY finish, source NULLS LAST, copy, mix, doc_id, size ROWS UNBOUNDED PRECEDING) AS reached FROM c),
b AS (SELECT round(sum(target))::BIGINT AS budget FROM t),
k AS (SELECT doc_id, source, size, sum(size)::BIGINT AS taken FROM q, b WHERE reached <= budget GROUP BY ALL)
SELECT p.doc_id, p.source, p.size, p.source_size, round(p.target, 6) AS target, coalesce(k.taken, 0)::BIGINT AS taken,
       (CASE WHEN p.size > 0 THEN coalesce(k.taken, 0) // p.size ELSE 0 END)::INT AS copies
FROM p LEFT JOIN k ON p.doc_id = k.doc_id AND p.source IS NOT DISTINCT FROM k.source AND p.size = k.size""")
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.withColumn("target", F.round("target", 6))


@query()
def op3_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query()
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


@query(r"""
WITH r AS (SELECT conv_id, turn, regexp_replace(coalesce(role, 'unknown'), '[\r\n]', ' ', 'g') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM r WHERE speaker <> 'system'),
v AS (SELECT r.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS seen
      FROM r JOIN p ON r.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|' || seen || CASE WHEN seen = 'user' THEN ' name=' || replace(replace(speaker, '\', '\\'), '<|', '<\|') ELSE '' END || '|>' || chr(10) AS head FROM v),
x AS (SELECT *, head || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|end|>' || chr(10) AS rendered FROM h),
o AS (SELECT *, row_number() OVER w - 1 AS segment, coalesce(sum(length(rendered)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM x WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, speaker, text))
SELECT conv_id, perspective, segment, turn, seen AS role, CASE WHEN seen = 'user' THEN speaker END AS name, rendered, start, start + length(rendered) AS "end",
       CASE WHEN seen = 'assistant' THEN start + length(head) END AS loss_start, CASE WHEN seen = 'assistant' THEN start + length(rendered) - 1 END AS loss_end
FROM o""")
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


@query()
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 6))


_TEMPLATE_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in sorted(licences.TEMPLATES.items()))
_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '([0-9]+(?:\.[0-9]+)+|[\p{{L}}\p{{N}}]+)', 1)"
_PAIRS = "list_distinct(CASE WHEN len({0}) > 1 THEN list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]) ELSE {0} END)"


@query(rf"""
WITH t AS (SELECT licence, {_PAIRS.format('w')} AS tb FROM (SELECT licence, {_WORDS.format('template')} AS w FROM (VALUES {_TEMPLATE_ROWS}) AS v(licence, template))),
l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, text FROM documents),
u AS (SELECT doc_id, 0 AS line_no, text AS unit FROM l WHERE len(lines) > 1
      UNION ALL SELECT doc_id, unnest(range(1, len(lines) + 1))::INT, unnest(lines) FROM l),
w AS (SELECT doc_id, line_no, {_WORDS.format('unit')} AS w FROM u),
b AS (SELECT doc_id, line_no, {_PAIRS.format('w')} AS b FROM w WHERE len(w) >= 1),
d AS (SELECT doc_id, line_no, licence, 2 * len(list_intersect(b, tb)) / (len(b) + len(tb)) AS dice FROM b, t WHERE len(b) <= 40)
SELECT doc_id, line_no, licence, round(dice, 6) AS dice FROM d WHERE dice >= 0.75""")
def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 6))


@query()
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path)
    return token_files.read_token_files(spark, path)


@query()
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


@query()
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


@query(r"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                     '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, k, phrase, count(*) AS f FROM (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, range(1, 6) AS t(k) WHERE len(w) >= k) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 100),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS d WHERE d.lang = c.lang AND d.k > c.k AND 100 * d.a >= 100 * c.a AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS "left", array_to_string(w[cut + 1:], ' ') AS "right" FROM kept, range(1, 5) AS t(cut) WHERE cut < k),
s AS (SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM cuts JOIN g AS x ON x.lang = cuts.lang AND x.phrase = "left" JOIN g AS y ON y.lang = cuts.lang AND y.phrase = "right" JOIN n ON n.lang = cuts.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""")
def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf_dir, "documents"))


@query(r"""
WITH tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS v FROM range(256) AS b(i))),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS f FROM d),
y AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
h AS (SELECT f, hex(f) AS bytes FROM (SELECT DISTINCT f FROM (SELECT f FROM x UNION ALL SELECT f FROM y))),
b AS (SELECT f, xor(list_reduce(list_transform(range(len(bytes) // 2), lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT),
                                lambda c, k: xor(tab[(xor(c, k) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket FROM h, tab),
s AS (SELECT bucket, count(*) AS s FROM x JOIN b USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM y JOIN b USING (f) GROUP BY bucket),
g AS (SELECT f, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM x) + 10000.0::DOUBLE)
                                / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM y) + 10000.0::DOUBLE))))::BIGINT AS gain
      FROM b LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT doc_id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM x JOIN g USING (f) GROUP BY doc_id),
r AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
      FROM documents LEFT JOIN w USING (doc_id)),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM r WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM k) THEN place END AS rank FROM r LEFT JOIN k USING (doc_id)""")
def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(secrets.scan_secrets(table(spark, sf_dir, "documents")))

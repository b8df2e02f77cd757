"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ordinata.llm import bpe, filter_audit, html_text, lm_scoring, media, minmax_dedup, packing, quality_model, quality_rules, rans, spelling, token_counts, url_filter
from ordinata.llm.workspace import materialize

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PATTERN = public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), TOKENIZER, RANKS, PATTERN)


def op2_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and words, as the query's SQL has it."""
    return lm_scoring.score(_table(spark, sf_dir, "documents"), order=2)


def op2_trigram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"), order=3)


def op3_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op4_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = materialize(quality_model.describe(_table(spark, sf_dir, "documents")), "quality-statistics")
    model = quality_model.fit_on_labels(described, _table(spark, sf_dir, "labels"))
    scored = quality_model.score(described, model)
    held_out = F.coalesce(quality_model.bucket(F.col("doc_id")) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "quality_rules.*")


def op7_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op8_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op9_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_describe(_table(spark, sf_dir, "documents"))


def op10_bitmap_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op11_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.store_and_read(_table(spark, sf_dir, "documents"), WORD_TOKENIZER)


def op12_filter_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_retrieval_packing, op2_backoff_scores, op2_trigram_scores, op3_trie_token_counts, op4_text_density, op5_quality_discriminant,
        op6_quality_rules, op7_url_trees, op8_minmax_dedup, op9_media_archive, op10_bitmap_bpe,
        op11_rans_ids, op12_filter_cube, op13_spelling_variants,
    )
} | {"pipeline": corpus_pipeline.run}

_WORDS = "list_filter(regexp_split_to_array(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="text")} AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, ws FROM d),
t AS (SELECT doc_id, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS h FROM p),
n AS (SELECT count(*)::DOUBLE AS n FROM t),
c1 AS (SELECT w, count(*) AS c FROM t GROUP BY w),
c2 AS (SELECT h, w, count(*) AS c FROM t WHERE h IS NOT NULL GROUP BY h, w),
s AS (
  SELECT t.doc_id, c2.c IS NOT NULL AND c2.c < 2 AS off,
    CASE WHEN c2.c >= 2 THEN ln(c2.c / ch.c::DOUBLE) WHEN c2.c IS NULL THEN ln(cw.c / n.n) ELSE ln(0.4::DOUBLE) + ln(cw.c / n.n) END AS ls
  FROM t CROSS JOIN n JOIN c1 cw ON cw.w = t.w LEFT JOIN c1 ch ON ch.w = t.h LEFT JOIN c2 ON c2.h = t.h AND c2.w = t.w
),
g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE off) AS n_backoffs, round(avg(ls), 6) AS mean_log_score FROM s GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_backoffs, 0)::BIGINT AS n_backoffs, mean_log_score FROM documents LEFT JOIN g USING (doc_id)
"""

OP2_TRIGRAM_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="text")} AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, ws FROM d),
t AS (SELECT doc_id, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS h, CASE WHEN i > 2 THEN ws[i - 2] END AS g FROM p),
n AS (SELECT count(*)::DOUBLE AS n FROM t),
c1 AS (SELECT w, count(*) AS c FROM t GROUP BY w),
c2 AS (SELECT h, w, count(*) AS c FROM t WHERE h IS NOT NULL GROUP BY h, w),
c3 AS (SELECT g, h, w, count(*) AS c FROM t WHERE g IS NOT NULL GROUP BY g, h, w),
s2 AS (
  SELECT t.doc_id, t.g, t.h, t.w, (c2.c IS NOT NULL AND c2.c < 2)::INT AS off,
    CASE WHEN c2.c >= 2 THEN ln(c2.c / ch.c::DOUBLE) WHEN c2.c IS NULL THEN ln(cw.c / n.n) ELSE ln(0.4::DOUBLE) + ln(cw.c / n.n) END AS ls
  FROM t CROSS JOIN n JOIN c1 cw ON cw.w = t.w LEFT JOIN c1 ch ON ch.w = t.h LEFT JOIN c2 ON c2.h = t.h AND c2.w = t.w
),
s AS (
  SELECT s2.doc_id, CASE WHEN c3.c >= 2 THEN 0 WHEN c3.c IS NULL THEN off ELSE off + 1 END AS off,
    CASE WHEN c3.c >= 2 THEN ln(c3.c / cg.c::DOUBLE) WHEN c3.c IS NULL THEN ls ELSE ln(0.4::DOUBLE) + ls END AS ls
  FROM s2 LEFT JOIN c3 ON c3.g = s2.g AND c3.h = s2.h AND c3.w = s2.w LEFT JOIN c2 cg ON cg.h = s2.g AND cg.w = s2.h
),
g AS (SELECT doc_id, count(*) AS n_words, sum(off) AS n_backoffs, round(avg(ls), 6) AS mean_log_score FROM s GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_backoffs, 0)::BIGINT AS n_backoffs, mean_log_score FROM documents LEFT JOIN g USING (doc_id)
"""

_STOPS = ", ".join(f"'{w}'" for w in quality_rules.STOP_FORMS)
OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format(text="text")} AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents
),
wd AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, win FROM wd GROUP BY doc_id, win HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS i FROM wd JOIN twice USING (doc_id, win)),
r AS (SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
    (length(text) - length(regexp_replace(text, '[!?]', '', 'g'))) AS bangs,
    (length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g'))) AS upper,
    len(list_filter(ws, lambda x: x IN ({_STOPS}))) AS stops,
    len(list_filter(ls, lambda x: substr(ltrim(x, ' '), 1, 1) IN ('-', '*', '•', '|'))) AS list_lines
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id
),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words >= 1 AND (n_words < 5 OR word_chars / n_words::DOUBLE BETWEEN 1.5 AND 20)
  AND n_symbols <= 0.10 * word_chars AND (n_words < 3 OR bangs <= 0.12 * word_chars) AND (n_words < 5 OR upper <= 0.5 * word_chars)
  AND (n_words < 30 OR stops >= 0.02 * n_words) AND n_dup_lines <= 0.5 * n_lines AND (n_words < 20 OR list_lines <= 0.9 * n_lines) AS kept
FROM f
"""

OP8_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS doc_id, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id),
m AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m.root, doc_id)) AS component_id, doc_id <= coalesce(m.root, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

OP12_SQL = f"""
WITH l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS.format(text="text")} AS ws,
    coalesce(min(doc_id) OVER (PARTITION BY coalesce(text, '')) < doc_id, false) AS E FROM documents
),
f AS (
  SELECT part, len(ws) < 100 AS A, 100 * len(list_distinct(ws)) < 80 * len(ws) AS B,
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) AS C, regexp_matches(text, '[#$%&*|]') AS D, E,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM d LEFT JOIN l USING (doc_id)
),
c AS (SELECT part, [A, B, C, D, E] AS fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL),
o AS (
  SELECT [a, b, c, d, e] AS fs FROM range(1, 6) x1(a), range(1, 6) x2(b), range(1, 6) x3(c), range(1, 6) x4(d), range(1, 6) x5(e)
  WHERE len(list_distinct([a, b, c, d, e])) = 5
),
s AS (SELECT fs, unnest(range(1, 6)) AS step FROM o),
r AS (
  SELECT part, array_to_string(list_transform(fs, lambda i: substr('ABCDE', i::INT, 1)), '') AS filter_order, step::INT AS step, fs[step] AS own,
    sum(n) FILTER (WHERE NOT earlier AND NOT fails[fs[step]]) AS kept, sum(n) FILTER (WHERE NOT earlier AND fails[fs[step]]) AS removed,
    sum(n) FILTER (WHERE earlier AND fails[fs[step]]) AS redundant, sum(n) FILTER (WHERE fails[fs[step]] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
    sum(good) FILTER (WHERE NOT earlier AND fails[fs[step]]) AS good_lost, sum(toxic) FILTER (WHERE NOT earlier AND fails[fs[step]]) AS toxic_lost
  FROM (SELECT *, len(list_filter(fs[1:step - 1], lambda i: fails[i])) > 0 AS earlier FROM c, s) GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""

#: crc32 by the table of its bitwise rule; near words share what a deletion at one place leaves.
OP13_SQL = """
WITH RECURSIVE bits AS (
  SELECT i AS byte, i AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
),
t AS (SELECT list(v ORDER BY byte) AS crc FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents
),
own AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT *, hex(encode(id || ':' || run)) AS hx FROM own),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(hx), 2), lambda i: ('0x' || substr(hx, i, 2))::BIGINT)), lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) AS h
  FROM bytes, t
),
printed AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
w AS (SELECT word, sum(n)::BIGINT AS n FROM printed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM w)),
pairs AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT cut.word, w.word, w.n FROM cut JOIN w ON w.word = cut.rest
  UNION SELECT w.word, cut.word, cut.n FROM cut JOIN w ON w.word = cut.rest
),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM pairs GROUP BY word),
chosen AS (SELECT b.word, b.n_near, b.top, min(encode(p.near)) AS form FROM best b JOIN pairs p ON p.word = b.word AND p.near_n = b.top GROUP BY ALL),
judged AS (SELECT w.word, CASE WHEN top >= 2 * n THEN decode(form) END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN top END AS form_n FROM w LEFT JOIN chosen ON chosen.word = w.word),
chain AS (SELECT word, word AS root FROM judged UNION ALL SELECT chain.word, judged.form FROM chain JOIN judged ON judged.word = chain.root WHERE judged.form IS NOT NULL),
ends AS (SELECT chain.word, chain.root FROM chain JOIN judged ON judged.word = chain.root WHERE judged.form IS NULL)
SELECT judged.word, form, root, n, n_near::BIGINT AS n_near, form_n FROM judged JOIN ends ON ends.word = judged.word
"""

ORACLES = {"op12_filter_cube": OP12_SQL, "op13_spelling_variants": OP13_SQL, "op2_backoff_scores": OP2_SQL, "op2_trigram_scores": OP2_TRIGRAM_SQL, "op6_quality_rules": OP6_SQL, "op8_minmax_dedup": OP8_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

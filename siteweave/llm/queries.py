"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, decontamination, html_template, importance, line_rules, lsh_forest, packing, set_join, sharding, spelling, token_counts, toxicity, turns
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(key: str = "doc_id"):
    """Rows that no model may learn labels from."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 5 == 0


def op1_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards by the law `rows`. Null texts are empty ones; repeated rows and rows without an id or source are placed like any other; no rows, no result."""
    placed = sharding.interleave(table(spark, sf_dir, "documents"), shards=8)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return placed.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. Null, empty and broken pages give what text they have; repeated rows repeat; no rows, no result."""
    return html_template.extract(table(spark, sf_dir, "pages"))


def op3_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for each row whose id is divisible by 20; ties go to the smaller id. Unfit vectors and null ids take no part; repeated rows count once."""
    return lsh_forest.neighbours(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of 1024. A null or empty text is the end id alone; repeated rows are packed as often as they occur."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document. Null and empty texts have no words; null items match nothing; repeated rows repeat; ids of equal items are each named once."""
    found = decontamination.find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document. Null texts count as empty; repeated rows repeat; no rows, no result."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of every document and what the sample keeps. Null and empty texts have weight 1; rows that tie with the last one kept stay; repeated rows get equal keys."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = importance.fit(docs, labels.where(~held_out()))
    return importance.resample(docs, model, keep=["doc_id"]).select("doc_id", "n_grams", F.round("log_weight", 6).alias("log_weight"), "gumbel_key", "kept")


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by trigrams of all documents. Null and empty texts have no words, score 0 and a null mean; rows that share an id are one document."""
    got = backoff.score(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", (F.round("log_score", 3) + 0.0).alias("log_score"), (F.round("mean_log_score", 6) + 0.0).alias("mean_log_score"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled rows that are not held out. Null and empty texts get the score of no match; rows with a null id are not held out (null) and are scored; repeated rows repeat."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    lexicon = toxicity.fit(docs, labels.where(~held_out()))
    return toxicity.score(docs, lexicon).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op10_t_occurrence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of linked documents, a row for each document. Null and empty texts link with nothing; a null id has a null component; rows that share an id share their links."""
    return set_join.jaccard_components(table(spark, sf_dir, "documents"))


def op11_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules and common lines of every document. Null and empty texts fail; every row is one document of its source; no rows, no result."""
    return line_rules.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations with deliberate faults, as crc32(`conv_id:turn`) % 20 says; nulls are one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    h = F.crc32(F.encode(F.concat(told("conv_id"), F.lit(":"), told("turn")), "UTF-8")) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    rows = conversations.where(h != 0).select("conv_id", "turn", F.when(h == 4, "user").otherwise(told("role")).alias("role"), text.alias("text"), F.when(h == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.expr("sequence(1, times)"))).drop("times")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of every conversation after damage. A null conv_id is a conversation; rows that tie by turn come by role and text; a conversation without rows left has zeros and the digest of nothing."""
    given = table(spark, sf_dir, "conversations")
    found = turns.repair_report(damaged(given)).withColumnRenamed("conv_id", "id")
    nothing = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    out = [F.coalesce(c, nothing.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns if c != "id"]
    return given.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").select("conv_id", *out)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of all documents, of which some runs have lost a letter. Null texts have no words; rows that repeat count as often as they occur."""
    words = spelling.count_words(table(spark, sf_dir, "documents"), letters=6, least=5, lose=199)
    return spelling.variant_groups(words, ratio=5).select("word", "form", "root", "n", "n_near", "form_n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (op1_interleaved_shards, op2_template_extraction, op3_prefix_forest, op4_packing, op5_decontamination, op6_token_counts, op7_importance_resampling, op8_stupid_backoff, op9_toxicity, op10_t_occurrence_join, op11_line_frequency, op12_turn_repair, op13_spelling_variants)
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS5 = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WORDS10 = "regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+')"

OP5_SQL = f"""
WITH b AS (SELECT item_id, {_WORDS5.format("text")} AS w FROM benchmark),
bw AS (
  SELECT item_id, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS5.format("text")} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP8_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS10.format("text")} AS w FROM documents),
t AS MATERIALIZED (SELECT doc_id, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
n1 AS (SELECT c, count(*) AS n FROM t GROUP BY c),
n2 AS (SELECT b, c, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY b, c),
n3 AS (SELECT a, b, c, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY a, b, c),
s AS (
  SELECT t.doc_id, CASE WHEN t.a IS NOT NULL THEN ln(n3.n / x2.n) WHEN t.b IS NOT NULL THEN ln(n2.n / x1.n) ELSE ln(n1.n / (SELECT sum(n) FROM n1)) END AS g
  FROM t LEFT JOIN n1 ON t.c = n1.c LEFT JOIN n1 x1 ON t.b = x1.c LEFT JOIN n2 ON t.b = n2.b AND t.c = n2.c
  LEFT JOIN n2 x2 ON t.a = x2.b AND t.b = x2.c LEFT JOIN n3 ON t.a = n3.a AND t.b = n3.b AND t.c = n3.c)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(coalesce(sum(s.g), 0e0), 3) + 0e0 AS log_score,
       round(sum(s.g) / nullif(len(d.w), 0), 6) + 0e0 AS mean_log_score
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, d.w
"""

OP10_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS10.format("text")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM o JOIN n na ON o.a = na.doc_id JOIN n nb ON o.b = nb.doc_id WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON d.doc_id = m.x
"""


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
l AS (SELECT r, i, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw
      FROM (SELECT r, unnest(x) AS line, unnest(range(1, len(x) + 1)) AS i FROM (SELECT r, string_split(t, chr(10)) AS x FROM d))),
ls AS (SELECT r, i, line, len(lw) AS n, row_number() OVER (PARTITION BY r, line ORDER BY i) AS k,
       array_to_string(regexp_extract_all(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[^\x20\x09-\x0D]+'), ' ') AS norm
       FROM l WHERE len(lw) > 0),
dup AS (SELECT r, count(*) AS n FROM ls WHERE k > 1 GROUP BY r),
hosts AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
common AS (SELECT source, norm FROM ls JOIN d USING (r) JOIN hosts h USING (source) GROUP BY source, norm, docs
           HAVING count(DISTINCT r) > {line_rules.COMMON_DOCS} AND count(DISTINCT r) * 100 > docs * {line_rules.COMMON_PERCENT}),
gone AS (SELECT r, sum(n) AS n FROM ls JOIN d USING (r) JOIN common USING (source, norm) GROUP BY r),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) > 8)),
often AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM often) GROUP BY r),
f AS (SELECT d.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_common_words
      FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)),
b AS (SELECT *, n_words < {line_rules.LEAST_WORDS} OR 100 * n_repeat_words > {line_rules.REPEAT_PERCENT} * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND n_words - n_common_words >= {line_rules.LEFT_WORDS} AND 100 * (n_words - n_common_words) >= {line_rules.LEFT_PERCENT} * n_words AS kept FROM b
"""

#: CRC-32 of the texts k of a table keys, byte by byte, as crc(k, h).
_CRC = """
crc_steps(b, c, i) AS (SELECT b, b, 0 FROM range(256) t(b) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM crc_steps WHERE i < 8),
crc_table AS MATERIALIZED (SELECT b, c FROM crc_steps WHERE i = 8),
crc_walk(k, x, i, h) AS (
  SELECT k, hex(encode(k)), 0, CAST(4294967295 AS BIGINT) FROM keys
  UNION ALL
  SELECT k, x, i + 1, xor(h >> 8, c) FROM crc_walk JOIN crc_table ON b = xor(h & 255, CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)) WHERE 2 * i < length(x)),
crc AS MATERIALIZED (SELECT k, xor(h, 4294967295) AS h FROM crc_walk WHERE 2 * i = length(x))"""

OP12_SQL = rf"""
WITH RECURSIVE c AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
keys AS (SELECT DISTINCT k FROM c),{_CRC},
m AS (SELECT conv_id, turn, CASE WHEN h % 20 = 4 THEN 'user' ELSE role END AS role, CASE h % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(range(CASE WHEN h % 20 = 3 THEN 2 ELSE 1 END)) AS copy FROM c JOIN crc USING (k) WHERE h % 20 <> 0),
o AS (SELECT *, dense_rank() OVER (ORDER BY conv_id) AS v, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_replace(text, '[ 	-]+$', '') AS said FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY v, role, text ORDER BY i) AS nth, role[1] AS ini, lag(role[1]) OVER (PARTITION BY v ORDER BY i) AS before FROM o),
f AS MATERIALIZED (SELECT *, said = '' AS blank, said <> '' AND nth > 1 AS dup, said <> '' AND nth = 1 AND NOT regexp_matches(said, '[.!?]$') AS trunc FROM p),
nxt(q, q2, r) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
ins(q, k, q2, t) AS (
  SELECT q, 0, q, CAST([] AS VARCHAR[]) FROM nxt UNION ALL SELECT q, 1, q2, [r || ':'] FROM nxt
  UNION ALL SELECT a.q, 2, b.q2, [a.r || ':', b.r || ':'] FROM nxt a JOIN nxt b ON a.q2 = b.q),
w AS (
  SELECT 0 AS v, CAST(0 AS BIGINT) AS i, 0 AS q, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR[])) AS s WHERE false
  UNION ALL SELECT DISTINCT v, CAST(0 AS BIGINT), 0, {{'c': CAST(0 AS BIGINT), 'a': '', 't': CAST([] AS VARCHAR[])}} FROM f),
walk(v, i, q, s) AS (
  SELECT v, i, q, s FROM w
  UNION ALL
  SELECT v, i, q, min(s) FROM (
    SELECT k.v, f.i, e.q, {{'c': k.s.c + 2 * ins.k + e.c + CASE WHEN f.trunc AND e.op <> 'D' THEN 1 ELSE 0 END, 'a': k.s.a || repeat('I', ins.k) || e.op,
                        't': k.s.t || ins.t || CASE e.op WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [f.role || ':' || f.text] ELSE [nxt.r || ':' || f.text] END}} AS s
    FROM walk k JOIN f ON f.v = k.v AND f.i = k.i + 1 JOIN ins ON ins.q = k.q JOIN nxt ON nxt.q = ins.q2,
    LATERAL (SELECT 'D' AS op, 3 AS c, ins.q2 AS q UNION ALL SELECT 'R', 2, nxt.q2 WHERE NOT f.blank AND NOT f.dup
             UNION ALL SELECT 'K', 0, nxt.q2 WHERE NOT f.blank AND NOT f.dup AND f.ini = nxt.r[1]
             UNION ALL SELECT 'K', 0, 1 WHERE NOT f.blank AND NOT f.dup AND f.ini = 's' AND ins.q2 = 0) e)
  GROUP BY v, i, q),
ends AS (
  SELECT v, min({{'c': s.c + 2 * ins.k, 'a': s.a || repeat('I', ins.k), 't': s.t || ins.t}}) AS s
  FROM walk JOIN (SELECT v, max(i) AS i FROM f GROUP BY v) USING (v, i) JOIN ins USING (q) WHERE ins.q2 IN (0, 3) GROUP BY v),
g AS (SELECT v, min(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
             count(*) FILTER (WHERE trunc) AS truncated, count(*) FILTER (WHERE i > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY v)
SELECT x.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(ends.s.c, 0) AS cost, coalesce(ends.s.a, '') AS audit, sha256(coalesce(array_to_string(ends.s.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN g ON x.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN ends ON ends.v = g.v
"""

OP13_SQL = rf"""
WITH RECURSIVE runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY doc_id, run),
keys AS (SELECT DISTINCT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k FROM runs),{_CRC},
w AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n
      FROM runs JOIN crc ON k = coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS d FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
one AS (SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
        UNION SELECT c.word, v.word FROM cut c JOIN v ON c.d = v.word UNION SELECT v.word, c.word FROM cut c JOIN v ON c.d = v.word),
near AS (SELECT one.word, count(*) AS n_near, min({{'less': -v.n, 'form': v.word}}) AS best FROM one JOIN v ON v.word = one.other GROUP BY one.word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 5 * v.n THEN best.form END AS form, CASE WHEN -best.less >= 5 * v.n THEN -best.less END AS form_n
      FROM v LEFT JOIN near USING (word)),
way(word, root) AS (SELECT word, word FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, way.root, f.n, f.n_near, f.form_n FROM f JOIN way USING (word) JOIN f z ON z.word = way.root WHERE z.form IS NULL
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    own = {"op5_decontamination": OP5_SQL, "op8_stupid_backoff": OP8_SQL, "op10_t_occurrence_join": OP10_SQL, "op11_line_frequency": OP11_SQL, "op12_turn_repair": OP12_SQL, "op13_spelling_variants": OP13_SQL}
    return own | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

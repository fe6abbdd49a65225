"""The operators applied to the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collision_ann, language_mixture, line_winnowing, packing, quality_ledger, simhash_bktree, token_count, unigram_pieces, url_trees

WORDS, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT -1L AS conv_id, id AS turn, IF(id = 0, 'user', 'assistant') AS role, '{odd}' AS text FROM range(2)")
    return chat_format.digests(chat_format.expand(talks.unionByName(more)))


def op2_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_mixture.train(docs, ~F.coalesce(held_out(), F.lit(False)))
    said = language_mixture.predict(docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text"), model)
    return said.select("doc_id", "held_out", "lang_pred", "score", F.size("languages").alias("n_languages"))


def op4_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_pieces.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op5_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bktree.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_ledger.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("fail_bits").bitwiseAND(quality_ledger.BASE) != 0
    # version 3: the registered SQL keeps documents without any bit
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), quality_ledger.passes(3).alias("kept"), "n_lines", "fail_bits")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy costs, from the ledger's bits alone."""
    return quality_ledger.ablation(quality_ledger.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), size=2048)


def op8_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trees.judge(_table(spark, sf_dir, "pages"))


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count(_table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), limit=2048)


def op10_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_winnowing.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_collision_ann, op3_language_mixture, op4_unigram_pieces, op5_simhash_bktree, op6_quality_ledger, op7_mixture_packing, op8_url_trees, op9_token_count, op10_line_winnowing, quality_ablation)}

_MARKED = "x"
for _end in line_winnowing.ENDS:
    _e = "chr(10)" if _end == "\n" else f"'{_end}'"
    _MARKED = f"replace({_MARKED}, {_e}, {_e} || chr(1))"
_CONTROL = "".join(f" + (length(x) - length(replace(x, '{c}', ''))) // {len(c)}" for c in chat_format.CONTROL)
_MASKS = ", ".join(f"({v}, '{name}', {mask}, {1 << b})" for v, mask in quality_ledger.POLICIES.items() for b, (name, _) in quality_ledger.RULES.items() if mask >> b & 1)
_LEDGER = r"""WITH docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS x FROM documents),
cut AS (SELECT k, doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, string_split(x, chr(10)) AS l FROM docs),
counted AS (
  SELECT k, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(l, lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS lines, w FROM cut
),
windows AS (SELECT k, i, array_to_string(w[i:i + 4], chr(10)) AS g FROM counted, range(1, greatest(n_words - 3, 1)) AS t(i)),
twice AS (SELECT k, i FROM windows QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
covered AS (SELECT k, CAST(count(DISTINCT i + o) AS BIGINT) AS n FROM twice, range(5) AS t(o) GROUP BY k),
measured AS (
  SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM counted LEFT JOIN covered USING (k)
),
bits AS (
  SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 4 ELSE 0 END + CASE WHEN word_chars > 14 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 16 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 32 ELSE 0 END
    + CASE WHEN n_words > 1000000 THEN 64 ELSE 0 END AS INTEGER) AS fail_bits FROM measured
)"""
ORACLE_SQL = {
    "op1_chat_format": rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(x) + length(r) + 13 + (length(x) - length(replace(x, '\', ''))){_CONTROL} AS n FROM turns
), summed AS (
  SELECT *, sum(n) OVER w AS upto, lead(turn) OVER w IS NULL AS is_last
  FROM sized WINDOW w AS (PARTITION BY conv_id ORDER BY turn, r, x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn, r, x)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (r = 'assistant' OR is_last) AS BIGINT) AS formatted_chars
FROM summed GROUP BY conv_id
""",
    "op6_quality_ledger": f"""{_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, fail_bits FROM bits
""",
    "quality_ablation": f"""{_LEDGER}, rules AS (SELECT * FROM (VALUES {_MASKS}) t(policy, rule, mask, bit))
SELECT policy, rule, (count(*) FILTER (fail_bits & bit <> 0))::BIGINT AS failing, (count(*) FILTER (fail_bits & mask = bit))::BIGINT AS only_this,
  (count(*) FILTER (fail_bits & mask = 0))::BIGINT AS kept, (count(*) FILTER (fail_bits & mask & ~bit = 0))::BIGINT AS kept_without
FROM bits, rules GROUP BY policy, rule
""",
    # runs are compared as texts; a run goes where an earlier place (by document, then line) has the same
    "op10_line_winnowing": rf"""
WITH docs AS (SELECT doc_id, text, coalesce(text, '') AS x FROM documents),
cut AS (SELECT doc_id, unnest(list_zip(l, range(len(l)))) AS p FROM (SELECT doc_id, string_split({_MARKED}, chr(1)) AS l FROM docs)),
pieces AS (SELECT doc_id, p[2] AS i, p[1] AS piece, trim(lower(p[1]), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b FROM cut),
content AS (
  SELECT doc_id, i, b, row_number() OVER w AS j, sum(length(b)) OVER w AS upto, count(*) OVER (PARTITION BY doc_id) AS n
  FROM pieces WHERE b <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
reach AS (
  SELECT s.doc_id, s.j, s.n, e.j AS last FROM (SELECT *, upto - length(b) + {line_winnowing.MIN_CHARS} AS need FROM content) s
  ASOF JOIN content e ON s.doc_id = e.doc_id AND s.need <= e.upto
),
runs AS (
  SELECT doc_id, j, unnest(range(last, greatest(last, coalesce(lead(last) OVER (PARTITION BY doc_id ORDER BY j) - 1, n)) + 1)) AS k FROM reach
),
texts AS (SELECT r.doc_id, r.j, r.k, string_agg(c.b, chr(1) ORDER BY c.j) AS run FROM runs r JOIN content c ON c.doc_id = r.doc_id AND c.j BETWEEN r.j AND r.k GROUP BY 1, 2, 3),
later AS (SELECT doc_id, j, k FROM texts QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, j) > 1),
gone AS (SELECT DISTINCT c.doc_id, c.j, c.i FROM content c JOIN later l ON c.doc_id = l.doc_id AND c.j BETWEEN l.j AND l.k),
islands AS (SELECT doc_id, min(i) AS a, max(i) AS b FROM (SELECT *, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS g FROM gone) GROUP BY doc_id, g),
dead AS (SELECT p.doc_id, p.i FROM pieces p JOIN islands s ON p.doc_id = s.doc_id AND p.i BETWEEN s.a AND s.b),
kept AS (
  SELECT p.doc_id, string_agg(p.piece, '' ORDER BY p.i) FILTER (d.i IS NULL) AS rest, count(d.i) AS n
  FROM pieces p LEFT JOIN dead d ON p.doc_id = d.doc_id AND p.i = d.i GROUP BY p.doc_id HAVING count(d.i) > 0
)
SELECT doc_id, CASE WHEN kept.n IS NULL THEN text ELSE coalesce(rest, '') END AS text, coalesce(kept.n, 0)::BIGINT AS removed_lines,
  CASE WHEN kept.n IS NULL THEN 0 ELSE length(text) - length(coalesce(rest, '')) END::BIGINT AS removed_chars
FROM docs LEFT JOIN kept USING (doc_id)
""",
}

"""The queries opN_<name>, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, infill, language_id, manifest, mixing, ngram_join, packing, quality_classifier, quality_rules, sentencepiece_codec, token_counts, topk_search, toxicity
from .common import documents, fold_of


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT) AS point
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS turn FROM s),
x AS (SELECT *, 1 + turn % 3 AS weight, source_size * 3.0::DOUBLE / (1 + turn % 3) AS x FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY x, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / sum(weight) OVER (ORDER BY x, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM x),
f AS (SELECT (SELECT level FROM l WHERE level < x ORDER BY x, turn LIMIT 1) AS final),
t AS (SELECT source, source_size, CASE WHEN final IS NULL OR x <= final THEN source_size * 3.0::DOUBLE ELSE weight * final END AS target FROM l, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS n_full FROM t),
r AS (SELECT *, target - n_full * source_size AS rest FROM p),
h AS (SELECT source, point, sum(size)::BIGINT AS words FROM d GROUP BY source, point),
b AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY point ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h),
m AS (SELECT b.source, max(point) AS last FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source WHERE before + words / 2.0 <= rest GROUP BY b.source)
SELECT d.doc_id, d.size, r.source_size, round(r.target, 6) AS target,
       (least(r.n_full + CASE WHEN d.point <= m.last THEN 1 ELSE 0 END, 3) * d.size)::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN m ON d.source IS NOT DISTINCT FROM m.source
"""


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP3_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS who, replace(coalesce(text, ''), '<|', '< |') AS content FROM conversations),
s AS (SELECT DISTINCT conv_id, who AS speaker FROM t WHERE who <> 'system'),
m AS (SELECT t.*, speaker, CASE WHEN who = 'system' THEN 'system' WHEN who = speaker THEN 'assistant' ELSE 'user' END AS role
      FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
h AS (SELECT *, CASE WHEN role = 'user' THEN who END AS name,
             '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || who ELSE '' END || chr(10) AS head FROM m),
g AS (SELECT *, head || content || '<|im_end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, row_number() OVER w AS position, sum(length(segment)) OVER w AS stop FROM g
      WINDOW w AS (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, who, content ROWS UNBOUNDED PRECEDING))
SELECT conv_id, speaker, position, role, name, segment, (stop - length(segment))::BIGINT AS start, stop::BIGINT AS stop,
       CASE WHEN role = 'assistant' THEN (stop - length(segment) + length(head))::BIGINT END AS mask_start,
       CASE WHEN role = 'assistant' THEN stop::BIGINT END AS mask_stop
FROM o
"""


def _held_out(n: int, rest: int):
    return F.coalesce(fold_of(F.col("doc_id"), n) == rest, F.lit(False)).alias("held_out")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    models = language_id.learn(language_id.training_rows(docs))
    return language_id.identify(docs, models).select("doc_id", _held_out(4, 2), "lang_pred", "score", "bits", "rejected")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.learn(quality_classifier.training_rows(docs), quality_classifier.training_rows(labels))
    return quality_classifier.score(docs, model).select("doc_id", _held_out(5, 0), "score", "predicted")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk_search.top_k(rows, rows.filter("vec_id % 20 = 0"), "vec_id", "embedding")


OP6_SQL = r"""
WITH c AS (SELECT vec_id, [CASE WHEN x > 0 THEN 1 ELSE 0 END FOR x IN embedding] AS bits FROM embeddings),
p AS (SELECT q.vec_id AS query_id, r.vec_id AS id,
             list_sum(list_transform(range(1, len(q.bits) + 1), lambda i: abs(q.bits[i] - r.bits[i])))::INTEGER AS distance
      FROM c q JOIN c r ON q.vec_id <> r.vec_id AND len(q.bits) = len(r.bits) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p) WHERE rank <= 10
"""


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_classes(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, toxicity.training_labels(labels))
    return toxicity.score(docs, model).select("doc_id", _held_out(4, 2), "score", "predicted")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), spans=True)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = manifest.audit(documents(spark, sf_dir), fold_of(F.col("doc_id"), 7) == 0, {"n_chars": F.col("n_chars") + 1})
    siblings = F.array_join(F.col("proof.hash"), "")
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, n_chars, CASE WHEN doc_id IS NULL THEN '-' ELSE len(doc_id::VARCHAR) || ':' || doc_id END
           || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
           || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS front,
         CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS back,
         list_reduce([ord(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')],
           lambda s, x: list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(s, x)), 4294967295) AS state
  FROM documents),
e AS (
  SELECT doc_id, lang, sha256(front || coalesce(len(n_chars::VARCHAR) || ':' || n_chars, '-') || back) AS leaf,
         sha256(front || coalesce(len((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || back) AS changed,
         coalesce(xor(state, 4294967295) % 7 = 0, false) AS tampered
  FROM d),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM e),
tree AS (
  SELECT lang, 0 AS level, pos, n, leaf AS hash FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subroots AS (
  SELECT lang, hash AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
upper AS (
  SELECT 0 AS level, pos, n, subroot AS hash FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY level, pos // 2, n),
path AS (
  SELECT l.lang, l.doc_id, l.leaf, l.pos, t.level, (l.pos >> t.level) % 2 = 1 AS is_left, s.hash
  FROM leaves l JOIN tree t ON l.lang IS NOT DISTINCT FROM t.lang AND t.pos = l.pos >> t.level AND t.n > 1
  LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM t.lang AND s.level = t.level AND s.pos = xor(t.pos, 1)
  UNION ALL
  SELECT l.lang, l.doc_id, l.leaf, l.pos, 100 + t.level, (r.pos >> t.level) % 2 = 1, s.hash
  FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang JOIN upper t ON t.pos = r.pos >> t.level AND t.n > 1
  LEFT JOIN upper s ON s.level = t.level AND s.pos = xor(t.pos, 1)),
proofs AS (
  SELECT lang, pos, coalesce(string_agg(hash, '' ORDER BY level), '') AS siblings, list({'is_left': is_left, 'hash': hash} ORDER BY level) AS steps
  FROM path GROUP BY lang, pos),
folded AS (
  SELECT l.doc_id, l.leaf, r.subroot, (SELECT hash FROM upper WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
         list_reduce([{'is_left': false, 'hash': h} FOR h IN [CASE WHEN tampered AND changed IS NOT NULL THEN changed ELSE leaf END]] || coalesce(steps, []),
           lambda a, p: {'is_left': false, 'hash': sha256(CASE WHEN p.hash IS NULL THEN a.hash WHEN p.is_left THEN p.hash || a.hash ELSE a.hash || p.hash END)}).hash AS folded_root
  FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang LEFT JOIN proofs p ON l.lang IS NOT DISTINCT FROM p.lang AND l.pos = p.pos)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.split_middle(documents(spark, sf_dir))
    sha = lambda c: F.sha2(c, 256)
    return out.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
c AS (
  SELECT *, len(u)::BIGINT AS n, [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS r FROM d),
f AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 90 THEN 'plain'
              WHEN r[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM c),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN len(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_token_counts": op2_token_counts,
    "op3_chat_rotation": op3_chat_rotation,
    "op4_language_id": op4_language_id,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_topk_search": op6_topk_search,
    "op7_ngram_join": op7_ngram_join,
    "op8_quality_rules": op8_quality_rules,
    "op9_toxicity": op9_toxicity,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL = {
    "op1_mix_sources": OP1_SQL,
    "op3_chat_rotation": OP3_SQL,
    "op6_topk_search": OP6_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}

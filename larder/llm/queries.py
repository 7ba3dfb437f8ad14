"""The queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import byte_bpe, decontamination, hard_negatives, language_id, ngram_jaccard, pii_deobfuscation, prefix_trie, quality_gam, robust_outliers, secret_scan, superkmer_dedup, token_frames, toxic_grammar
from larder.llm.common import load, new_path


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is on this machine and on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robust_outliers.judge(load(spark, sf_dir, "documents"))


def op2_toxic_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_grammar.toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_deobfuscation.report(pii_deobfuscation.find_spans(load(spark, sf_dir, "documents")))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.link_clusters(load(spark, sf_dir, "documents"))


def op6_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    manifest = token_frames.write(load(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1, folder)
    return token_frames.summary(token_frames.read(manifest, folder))


def op7_superkmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = superkmer_dedup.remove_repeats(load(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(load(spark, sf_dir, "documents"), reject=False)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    file = vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.digests(byte_bpe.round_trip(load(spark, sf_dir, "documents"), *file))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(load(spark, sf_dir, "conversations"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(load(spark, sf_dir, "embeddings"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.find_secrets(load(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_robust_outliers": op1_robust_outliers,
    "op2_toxic_grammar": op2_toxic_grammar,
    "op3_quality_gam": op3_quality_gam,
    "op4_pii_deobfuscation": op4_pii_deobfuscation,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_token_frames": op6_token_frames,
    "op7_superkmer_dedup": op7_superkmer_dedup,
    "op8_language_id": op8_language_id,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_decontamination": op10_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_secret_scan": op13_secret_scan,
    "pipeline": pipeline,
}

ORACLE = {
    "op5_ngram_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
  FROM words),
shingle AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM shingle a JOIN shingle b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS c FROM documents
  UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.c)
SELECT s.doc_id, CAST(len(any_value(s.s)) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id""",
    "op7_superkmer_dedup": r"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS i, w FROM words WHERE len(w) >= 50),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM starts),
taken AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM taken WHERE first < doc_id),
lost AS (SELECT doc_id, list(i) AS l FROM gone GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM words WHERE len(w) > 0),
stay AS (SELECT p.doc_id, string_agg(x, ' ' ORDER BY p.i) AS t FROM pos p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i WHERE g.i IS NULL GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(len(l.l), 0) AS BIGINT) AS n_removed, sha256(coalesce(s.t, '')) AS kept_sha256
FROM words w LEFT JOIN lost l USING (doc_id) LEFT JOIN stay s USING (doc_id)""",
    "op11_prefix_trie": r"""
WITH own AS (
  SELECT CAST(conv_id AS BIGINT) AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc AS (
  SELECT c, s, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(c AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT))),
    lambda x, y: list_reduce(list_prepend(xor(x, y), range(8)), lambda p, q: CASE WHEN p % 2 = 1 THEN xor(p // 2, CAST(3988292384 AS BIGINT)) ELSE p // 2 END)), CAST(4294967295 AS BIGINT)) % 4 AS h
  FROM own),
made AS (SELECT a.c, list_concat(coalesce(b.s, [])[1:a.h], a.s[a.h + 1:]) AS s FROM crc a LEFT JOIN own b ON b.c = a.c - a.c % 20),
member AS (
  SELECT c, d, md5(CAST(to_json(s[1:d]) AS VARCHAR)) AS k, CASE WHEN d > 0 THEN md5(CAST(to_json(s[1:d - 1]) AS VARCHAR)) END AS up, len(s) = d AS ends,
    CASE WHEN d > 0 THEN len(list_filter(string_split_regex(s[d].t, '[ 	-]+'), lambda x: x <> '')) ELSE 0 END AS words
  FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM made)),
node AS (
  SELECT k, any_value(d) AS depth, any_value(up) AS up, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(words) AS v, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS e
  FROM member GROUP BY k),
kids AS (SELECT up AS k, count(*) AS n FROM node WHERE up IS NOT NULL GROUP BY up),
sub AS (
  SELECT m.k, sum(u.v) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
  FROM node u JOIN member m ON m.c = u.c AND m.d <= u.depth LEFT JOIN kids ON kids.k = u.k GROUP BY m.k)
SELECT node.c AS conv_id, node.depth, p.c AS parent_conv_id, node.n AS n_convs, coalesce(kids.n, 0) AS n_children, sub.leaves AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, node.e AS ends_sha256
FROM node JOIN sub USING (k) LEFT JOIN kids USING (k) LEFT JOIN node p ON p.k = node.up""",
    "op12_hard_negatives": """
WITH row AS (
  SELECT CAST(vec_id AS BIGINT) AS id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT a.id AS anchor_id, b.id AS other_id, a.label = b.label AS same,
    CAST(coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])), 0) AS BIGINT) AS score
  FROM row a, row b WHERE a.id % 50 = 0 AND a.id <> b.id),
positive AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN pair USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""",
}

"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from eventloom.llm import (
    byte_bpe,
    decontamination,
    exact_dedup,
    jaccard,
    language_model,
    lexical_search,
    packing,
    periodic_runs,
    quality,
    sentence_spans,
    suffix_dedup,
    top_k,
    toxicity,
)
from eventloom.llm.shared import documents


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode_documents(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda id_: id_ % 50 == 0)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(documents(spark, sf_dir))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(documents(spark, sf_dir))


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_spans.without_repeats(documents(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(documents(spark, sf_dir), plant=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_top_k": op2_top_k,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_language_model": op4_language_model,
        "op5_sentence_spans": op5_sentence_spans,
        "op6_quality": op6_quality,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_jaccard": op9_jaccard,
        "op10_toxicity": op10_toxicity,
        "op11_decontamination": op11_decontamination,
        "op12_lexical_search": op12_lexical_search,
        "op13_periodic_runs": op13_periodic_runs,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return pipeline | {
        "op2_top_k": TOP_K,
        "op3_suffix_dedup": SUFFIXES,
        "op5_sentence_spans": SPANS,
        "op7_exact_dedup": EXACT,
        "op9_jaccard": JACCARD,
        "op11_decontamination": LEAKS,
        "op12_lexical_search": RANKED,
    }


EXACT = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS body, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
             count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
      FROM documents)
"""

JACCARD = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])))
  END AS grams FROM split),
grams AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 90 * (na + nb - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT doc_id, len(grams) AS n_shingles, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id FROM sets
"""

TOP_K = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM fine q, fine c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 5
"""

SPANS = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?,;:\n]*[.!?,;:]+\n*|[^.!?,;:\n]+\n*|\n+') AS parts FROM documents),
plain AS (
  SELECT *, regexp_replace(part, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t,
         len(list_filter(string_split_regex(part, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
  FROM (SELECT doc_id, generate_subscripts(parts, 1) AS at, unnest(parts) AS part FROM split)),
sentences AS (
  SELECT doc_id, at, t, CAST(n AS BIGINT) AS n, row_number() OVER o AS pos, CAST(sum(n) OVER o AS BIGINT) AS upto
  FROM plain WHERE n > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY at)),
sizes AS (SELECT doc_id, count(*) AS many, list(t ORDER BY pos) AS texts FROM sentences GROUP BY doc_id),
ends AS (
  SELECT a.doc_id, a.pos AS first, greatest(b.pos, a.pos + 1) AS last
  FROM (SELECT doc_id, pos, upto - n + 12 AS want FROM sentences) a
  ASOF JOIN sentences b ON a.doc_id = b.doc_id AND a.want <= b.upto),
starts AS (
  SELECT a.doc_id, least(b.pos, a.pos - 1) AS first, a.pos AS last
  FROM (SELECT doc_id, pos, upto - 12 AS want FROM sentences) a
  ASOF JOIN (SELECT doc_id, pos, upto - n AS before FROM sentences) b ON a.doc_id = b.doc_id AND a.want >= b.before),
bounds AS (
  SELECT doc_id, first, last FROM ends JOIN sizes USING (doc_id) WHERE last <= many
  UNION SELECT doc_id, first, last FROM starts WHERE first >= 1),
runs AS (
  SELECT * FROM bounds UNION ALL
  SELECT doc_id, 1, many FROM sizes WHERE doc_id NOT IN (SELECT doc_id FROM bounds)),
later AS (
  SELECT doc_id, first, last,
         row_number() OVER (PARTITION BY list_slice(texts, first, last) ORDER BY doc_id, first) AS nth
  FROM runs JOIN sizes USING (doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM later WHERE nth > 1),
flagged AS (
  SELECT plain.doc_id, plain.at, part, sentences.pos IS NOT NULL AS worded, gone.pos IS NOT NULL AS out
  FROM plain LEFT JOIN sentences ON sentences.doc_id = plain.doc_id AND sentences.at = plain.at
  LEFT JOIN gone ON gone.doc_id = plain.doc_id AND gone.pos = sentences.pos)
SELECT split.doc_id, count(*) FILTER (WHERE worded) AS n_sentences, count(*) FILTER (WHERE out) AS n_removed,
       coalesce(string_agg(part, '' ORDER BY at) FILTER (WHERE NOT out), '') AS text
FROM split LEFT JOIN flagged USING (doc_id) GROUP BY split.doc_id
"""

SUFFIXES = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
parts AS (SELECT doc_id, n, c, substr(h, 2 * c + 1, 198) AS h FROM (SELECT *, unnest(range(0, n, 50)) AS c FROM bytes)),
places AS (SELECT doc_id, n, c + k AS p, k, h FROM (SELECT *, unnest(range(0, 50)) AS k FROM parts) WHERE c + k < n),
each AS (
  SELECT doc_id, p, substr(h, 2 * k + 1, 2) AS b, CASE WHEN p + 50 <= n THEN substr(h, 2 * k + 1, 100) END AS s FROM places),
firsts AS (SELECT s, min(doc_id) AS first_doc FROM each WHERE s IS NOT NULL GROUP BY s HAVING min(doc_id) < max(doc_id)),
marked AS (
  SELECT each.doc_id, p, b,
         coalesce(max(CASE WHEN first_doc < each.doc_id THEN p END) OVER (
           PARTITION BY each.doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), -1) >= 0 AS gone
  FROM each LEFT JOIN firsts ON each.s = firsts.s),
edged AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS edge FROM marked),
summed AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS removed, count(*) FILTER (WHERE edge) AS spans,
         string_agg(b, '' ORDER BY p) FILTER (WHERE NOT gone) AS kept
  FROM edged GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM bytes LEFT JOIN summed USING (doc_id)
"""

LEAKS = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(
    range(1, greatest(len(w) - 10, 0) + 2), lambda s: array_to_string(w[s:s + least(len(w), 10) - 1], ' '))) AS g
  FROM items WHERE len(w) > 0),
words AS (SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM split),
ahead AS (
  SELECT doc_id, p, list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS next
  FROM words),
grams AS (
  SELECT doc_id, p, k, array_to_string(next[1:k], ' ') AS g
  FROM ahead, (SELECT DISTINCT k FROM windows) WHERE len(next) >= k),
found AS (SELECT doc_id, p, k, item_id FROM grams JOIN windows USING (k, g)),
hits AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM split LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

RANKED = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
known AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM split WHERE len(w) > 0),
sized AS (SELECT doc_id, 10 + (90 * len(w) * docs) // total AS m, w FROM split, known WHERE len(w) > 0),
counted AS (
  SELECT doc_id, m, term, count(*) AS tf FROM (SELECT doc_id, m, unnest(w) AS term FROM sized) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), known),
scored AS (
  SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM wanted JOIN counted USING (term) JOIN weights USING (term) GROUP BY item_id, doc_id),
placed AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""

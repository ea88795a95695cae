"""The checked queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (op01_bpe, op02_jaccard_join, op03_phrases, op04_grid_join, op05_quality, op06_licenses, op07_suffix_trees,
               op08_secrets, op09_html, op10_decontaminate, op11_exact_dedup, op12_alignment, op13_whitening)
from .base import register, table


@register("op1_bpe_merge_replay")
def op1(spark, sf_dir):
    import public_tokenizers as public
    vocabulary = op01_bpe.Vocabulary(public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
    out = op01_bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary)
    return out.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op2_ngram_jaccard_join")
def op2(spark, sf_dir):
    return op02_jaccard_join.jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@register("op3_suffix_array_dedup")
def op3(spark, sf_dir):
    out = op03_phrases.dedup_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH w AS (SELECT r, doc_id, CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END AS w FROM (
  SELECT row_number() OVER () AS r, doc_id, trim(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS t FROM documents)),
win AS (SELECT r, doc_id, i, list_aggregate(w[i:i + 12], 'string_agg', ' ') AS k
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
dup AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY k) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT r, j FROM (SELECT r, unnest(range(i, i + 13)) AS j FROM dup)),
words AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM w),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY j) AS s, count(*) AS n FROM words ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""


@register("op7_substring_dedup", OP7_SQL)
def op7(spark, sf_dir):
    out = op07_suffix_trees.dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH RECURSIVE dw AS (
  SELECT rowid AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, m, list_aggregate(w[i:i + m - 1], 'string_agg', ' ') AS k
  FROM (SELECT item_id, w, least(len(w), 13) AS m, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM bw WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM win),
pos AS (
  SELECT r, m, i, list_aggregate(w[i:i + m - 1], 'string_agg', ' ') AS k
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, ms WHERE len(w) >= m)),
hit AS (SELECT r, pos.m, i, item_id FROM pos JOIN win USING (m, k)),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS j FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN its USING (r)
"""


@register("op10_benchmark_decontamination", OP10_SQL)
def op10(spark, sf_dir):
    found = op10_decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = op10_decontaminate.hit_words()
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        op10_decontaminate.contaminated(n_hit, F.col("n_words")).alias("contaminated"))


@register("op5_quality_classifier")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = op05_quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = op05_quality.score(docs, model)
    return scored.select("doc_id", op05_quality.held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


OP4_SQL = """
WITH RECURSIVE u AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
ok AS (SELECT * FROM u WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
  AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(v, lambda x: x * x)) > 0),
pair AS (SELECT a.r AS ra, b.r AS rb, a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r
  AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT DISTINCT a AS vec_id, a AS c FROM pair UNION SELECT reach.vec_id, pair.b FROM reach JOIN pair ON reach.c = pair.a),
comp AS (SELECT vec_id, min(c) AS c FROM reach GROUP BY vec_id),
n AS (SELECT ra AS r, count(*) AS n FROM pair GROUP BY ra)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id,
  coalesce(vec_id = coalesce(c, vec_id), false) AS kept
FROM u LEFT JOIN n USING (r) LEFT JOIN comp USING (vec_id)
"""


@register("op4_embedding_near_dedup", OP4_SQL)
def op4(spark, sf_dir):
    found = op04_grid_join.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", "component_id", "kept")


@register("op6_license_scans", op06_licenses.duckdb_sql())
def op6(spark, sf_dir):
    found = op06_licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join(F.col("sentence_ids").cast("array<string>"), ",").alias("sentence_ids"),
                        F.array_join("licenses", ",").alias("licenses"))


@register("op9_html_extraction")
def op9(spark, sf_dir):
    return op09_html.extract_text(table(spark, sf_dir, "pages"))


@register("op8_secret_scans")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = op08_secrets.scan(docs, op08_secrets.fit(docs))
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"),
                        F.transform("secrets", lambda x: x["start"]).alias("starts"),
                        F.transform("secrets", lambda x: F.sha2(x["value"], 256)).alias("values_sha256"))


@register("op12_cross_tokenizer_alignment")
def op12(spark, sf_dir):
    import public_tokenizers as public
    found = op12_alignment.align(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))
    found = found.withColumn("groups_sha256", op12_alignment.groups_sha256()).drop("groups")
    return op12_alignment.count_links(found).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


OP11_SQL = r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
"""


@register("op11_exact_dedup", OP11_SQL)
def op11(spark, sf_dir):
    found = op11_exact_dedup.find_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@register("op13_embedding_whitening")
def op13(spark, sf_dir):
    return op13_whitening.whiten(table(spark, sf_dir, "embeddings"))

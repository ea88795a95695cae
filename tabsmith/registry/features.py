"""Checked queries for preprocessing."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import features as fe
from ._base import register, table


def _holes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     F.when(F.col("l_quantity") > 45, None).otherwise(F.col("l_extendedprice")).alias("price"),
                     F.when(F.col("l_discount") == 0, None).otherwise(F.col("l_returnflag")).alias("flag"),
                     "l_quantity", "l_tax")


_HOLES_SQL = """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_quantity > 45 THEN NULL ELSE l_extendedprice END AS price,
  CASE WHEN l_discount = 0 THEN NULL ELSE l_returnflag END AS flag, l_quantity, l_tax FROM lineitem"""


@register("f1_mean_imputation", f"""
WITH t AS ({_HOLES_SQL})
SELECT l_orderkey, l_linenumber, coalesce(price, (SELECT avg(price) FROM t)) AS price FROM t
""")
def f1_mean_imputation(spark, sf_dir):
    t = _holes(spark, sf_dir)
    return fe.mean_impute(t, t, ["price"]).select("l_orderkey", "l_linenumber", "price")


@register("f2_mode_imputation", f"""
WITH t AS ({_HOLES_SQL}),
m AS (SELECT flag FROM t WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag ASC LIMIT 1)
SELECT l_orderkey, l_linenumber, coalesce(t.flag, (SELECT flag FROM m)) AS flag FROM t
""")
def f2_mode_imputation(spark, sf_dir):
    t = _holes(spark, sf_dir)
    return fe.mode_impute(t, t, ["flag"]).select("l_orderkey", "l_linenumber", "flag")


@register("f3_standard_scaling", """
SELECT l_orderkey, l_linenumber,
  (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS l_quantity,
  (l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER () AS l_tax,
  0.0 AS const_col
FROM lineitem
""")
def f3_standard_scaling(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax",
                                                  F.lit(3.0).alias("const_col"))
    return fe.standard_scale(li, li, ["l_quantity", "l_tax", "const_col"])


@register("f3_scaler_stage_population_std", """
SELECT l_orderkey, l_linenumber,
  (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS s_quantity,
  (l_discount - avg(l_discount) OVER ()) / stddev_pop(l_discount) OVER () AS s_discount
FROM lineitem
""")
def f3_scaler_stage_population_std(spark, sf_dir):
    """The Spark ML stage chain (StandardScaler + sqrt(n/(n-1)) product) of the column transformer."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    fit = fe.fit_features(li, fe.FeatureSpec(numerical=["l_quantity", "l_discount"]))
    out = fit.transform(li).select("l_orderkey", "l_linenumber", vector_to_array("features").alias("v"))
    return out.select("l_orderkey", "l_linenumber", F.col("v")[0].alias("s_quantity"),
                      F.col("v")[1].alias("s_discount"))


@register("f4_one_hot_positions", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS hot_index,
  CAST((SELECT count(DISTINCT o_orderpriority) FROM orders) AS INTEGER) AS n_slots
FROM orders
""")
def f4_one_hot_positions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    fit = fe.fit_features(o, fe.FeatureSpec(categorical=["o_orderpriority"], impute=False))
    v = fit.transform(o).select("o_orderkey", vector_to_array("features").alias("v"))
    return v.select("o_orderkey",
                    (F.coalesce(F.array_position("v", 1.0), F.lit(0)) - 1).cast("int").alias("hot_index"),
                    F.size("v").cast("int").alias("n_slots"))


@register("f5_tfidf_vocabulary", r"""
WITH tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}_]{2,}') AS toks
             FROM documents),
tf AS (SELECT t AS term, count(*) AS tf FROM (SELECT unnest(toks) AS t FROM tok) GROUP BY t),
dfq AS (SELECT t AS term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(toks) AS t FROM tok) GROUP BY t),
top AS (SELECT * FROM tf ORDER BY tf DESC, term ASC LIMIT 5000)
SELECT top.term, CAST(top.tf AS BIGINT) AS tf, CAST(dfq.df AS BIGINT) AS df,
  ln((1 + (SELECT count(*) FROM documents)) / (1 + dfq.df)) + 1 AS idf
FROM top JOIN dfq ON top.term = dfq.term
""")
def f5_tfidf_vocabulary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return fe.term_table(d, "text").select("term", "tf", "df", "idf")


@register("f5_tfidf_doc_norms", r"""
WITH tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}_]{2,}') AS toks
             FROM documents),
tf AS (SELECT t AS term, count(*) AS tf FROM (SELECT unnest(toks) AS t FROM tok) GROUP BY t),
dfq AS (SELECT t AS term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(toks) AS t FROM tok) GROUP BY t),
top AS (SELECT * FROM tf ORDER BY tf DESC, term ASC LIMIT 5000),
voc AS (SELECT top.term, ln((1 + (SELECT count(*) FROM documents)) / (1 + dfq.df)) + 1 AS idf
        FROM top JOIN dfq ON top.term = dfq.term),
cnt AS (SELECT doc_id, t AS term, count(*) AS c FROM (SELECT doc_id, unnest(toks) AS t FROM tok) GROUP BY 1, 2),
w AS (SELECT cnt.doc_id, c * idf AS x FROM cnt JOIN voc ON cnt.term = voc.term),
nrm AS (SELECT doc_id, sqrt(sum(x * x)) AS l2, max(x) AS mx FROM w GROUP BY doc_id)
SELECT d.doc_id, coalesce(mx / l2, 0.0) AS max_weight, CAST(coalesce(k, 0) AS INTEGER) AS n_terms
FROM documents d LEFT JOIN nrm ON d.doc_id = nrm.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS k FROM w GROUP BY doc_id) kk ON d.doc_id = kk.doc_id
""")
def f5_tfidf_doc_norms(spark, sf_dir):
    """Weights per document: largest L2-normalised tf-idf weight and number of vocabulary terms."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    fit = fe.fit_features(d, fe.FeatureSpec(text=["text"], tfidf=True))
    v = fit.transform(d).select("doc_id", vector_to_array("features").alias("v"))
    nz = F.filter("v", lambda x: x != 0)
    return v.select("doc_id", F.coalesce(F.array_max("v"), F.lit(0.0)).alias("max_weight"),
                    F.size(nz).cast("int").alias("n_terms"))


@register("f6_numeric_categorical_text", r"""
WITH d AS (SELECT doc_id, n_chars, lang, (n_chars - avg(n_chars) OVER ()) / nullif(stddev_pop(n_chars) OVER (), 0) AS scaled,
  (SELECT count(DISTINCT lang) FROM documents) AS n_langs FROM documents),
tok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}_]{2,}') AS toks FROM documents),
top AS (SELECT t AS term, count(*) AS tf FROM (SELECT unnest(toks) AS t FROM tok) GROUP BY t ORDER BY tf DESC, term ASC LIMIT 5000),
k AS (SELECT doc_id, count(DISTINCT t) AS k FROM (SELECT doc_id, unnest(toks) AS t FROM tok) x JOIN top ON top.term = x.t GROUP BY doc_id)
SELECT d.doc_id, coalesce(scaled, 0.0) AS scaled, lang AS encoded, CAST(coalesce(k, 0) AS INTEGER) AS n_terms, CASE WHEN k > 0 THEN 1.0 ELSE 0.0 END AS text_norm,
  CAST(1 + n_langs + (SELECT count(*) FROM top) AS INTEGER) AS width
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
""")
def f6_numeric_categorical_text(spark, sf_dir):
    """All three branches on every document: scaled number, one-hot language, tf-idf of the whole text, in this order."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "text")
    fit = fe.fit_features(d, fe.FeatureSpec(numerical=["n_chars"], categorical=["lang"], text=["text"], tfidf=True))
    langs = [n[len("lang_"):] for n in fit.names[1:] if n.startswith("lang_")]
    k = len(langs)
    v = fit.transform(d).select("doc_id", vector_to_array("features").alias("v"))
    text = F.slice("v", k + 2, F.greatest(F.size("v") - k - 1, F.lit(0)))
    hot = F.array_position(F.slice("v", 2, k), 1.0).cast("int")
    return v.select("doc_id", F.get("v", F.lit(0)).alias("scaled"), F.get(F.array(*[F.lit(x) for x in langs]), hot - 1).alias("encoded"),
                    F.size(F.filter(text, lambda x: x != 0)).cast("int").alias("n_terms"),
                    F.sqrt(F.aggregate(text, F.lit(0.0), lambda s, x: s + x * x)).alias("text_norm"), F.size("v").cast("int").alias("width"))


@register("f7_class_weights", """
SELECT toxic, count(*) * 0 + (SELECT count(*) FROM labels) / ((SELECT count(DISTINCT toxic) FROM labels) * count(*)) AS weight
FROM labels GROUP BY toxic
""")
def f7_class_weights(spark, sf_dir):
    return fe.class_weights(table(spark, sf_dir, "labels"), "toxic")


@register("f8_label_encoding", """
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS label_idx FROM orders
""")
def f8_label_encoding(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return fe.label_indexer("o_orderstatus").fit(o).transform(o).select("o_orderkey", "label_idx")

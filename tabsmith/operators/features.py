"""Feature preprocessing (F1-F8) as persistable Spark ML stages.

Statistics are fitted on the training part only; the result is a plain
``PipelineModel`` of built-in stages (``SQLTransformer``, ``Imputer``,
``StringIndexer``, ``OneHotEncoder``, ``VectorAssembler``, ``StandardScaler``,
``ElementwiseProduct``, ``RegexTokenizer``, ``CountVectorizerModel``,
``Normalizer``), so ``PipelineModel.save/load`` works and scoring is
JVM-side.  Where Spark's stage differs from the rule we need:

* F2 most-frequent: ``Imputer`` refuses strings; the mode is a grouped count
  per column + top-1 (count desc, value asc) — no per-value map in one task —
  applied by ``coalesce`` in a ``SQLTransformer``.
* F3 population std: ``StandardScaler`` divides by the sample std; an
  ``ElementwiseProduct`` by sqrt(n/(n-1)) turns it into the population std.
* F5 TF-IDF: vocabulary = top ``max_terms`` terms by corpus count (ties: term
  ascending) from a distributed ``groupBy(term)``; idf = ln((1+n)/(1+df)) + 1
  as an ``ElementwiseProduct`` after raw counts; then L2 ``Normalizer``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (CountVectorizerModel, ElementwiseProduct, Imputer, Normalizer,
                                OneHotEncoder, RegexTokenizer, SQLTransformer, StandardScaler,
                                StringIndexer, StringIndexerModel, VectorAssembler)
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import spread

# Token rule of the reference's text vectoriser (2+ word characters, lower case).
TOKEN_PATTERN = r"(?U)\b\w\w+\b"
MAX_TERMS = 5000


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _lit(v) -> str:
    if v is None:
        return "NULL"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


# ---------------------------------------------------------------- F1 / F2
def column_means(train: DataFrame, cols: list[str]) -> dict[str, float | None]:
    if not cols:
        return {}
    r = train.agg(*[F.avg(F.col(c).cast("double")).alias(f"_m{i}") for i, c in enumerate(cols)]).first()
    return {c: r[f"_m{i}"] for i, c in enumerate(cols)}


def most_frequent(train: DataFrame, col: str):
    """the most frequent non-null value; ties -> smallest value."""
    top = (train.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("v"))
           .agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("v").asc()).limit(1)
           .collect())
    return top[0]["v"] if top else None


def mean_impute(df: DataFrame, train: DataFrame, cols: list[str]) -> DataFrame:
    """F1 as a DataFrame step (means fitted on ``train``)."""
    means = column_means(train, cols)
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(means[c])) for c in cols})


def mode_impute(df: DataFrame, train: DataFrame, cols: list[str]) -> DataFrame:
    """F2 as a DataFrame step (modes fitted on ``train``)."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(most_frequent(train, c)))
                           for c in cols})


# ---------------------------------------------------------------- F3
def standard_scale(df: DataFrame, train: DataFrame, cols: list[str]) -> DataFrame:
    """F3 as a DataFrame step: (x - mean) / population std; zero std -> scale 1."""
    r = train.agg(*[F.avg(F.col(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                  *[F.stddev_pop(F.col(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        m, s = r[f"m{i}"], r[f"s{i}"]
        scale = s if (s is not None and s > 0) else 1.0
        out[c] = (F.col(c) - F.lit(m)) / F.lit(scale)
    return df.withColumns(out)


# ---------------------------------------------------------------- F5
def tokenize(text_col: str, out: str = "_tokens") -> RegexTokenizer:
    return RegexTokenizer(inputCol=text_col, outputCol=out, pattern=TOKEN_PATTERN, gaps=False,
                          toLowercase=True, minTokenLength=1)


def term_table(df: DataFrame, text_col: str, max_terms: int = MAX_TERMS) -> DataFrame:
    """F5 vocabulary: (term, tf, df, idf, term_index) for the top ``max_terms`` terms.

    Term counts and document frequencies are distributed aggregates; only the
    selected vocabulary (bounded by ``max_terms``) is ordered on one task.
    """
    text = spread(df.select(F.coalesce(F.col(text_col), F.lit("")).alias(text_col)))  # tokenising is CPU-heavy
    tok = tokenize(text_col).transform(text)
    tok = tok.withColumn("_d", F.monotonically_increasing_id())
    n_docs = F.lit(df.count())
    tf = tok.select(F.explode("_tokens").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf"))
    dfreq = (tok.select(F.explode(F.array_distinct("_tokens")).alias("term"))
             .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    top = tf.orderBy(F.col("tf").desc(), F.col("term").asc()).limit(max_terms)
    w = Window.orderBy(F.col("tf").desc(), F.col("term").asc())  # over <= max_terms rows
    voc = top.join(dfreq, "term").withColumn("term_index", F.row_number().over(w) - 1)
    return voc.withColumn("idf", F.log((n_docs + 1) / (F.col("df") + 1)) + 1)


def tfidf_stages(voc_rows: list, text_col: str, out: str) -> list:
    vocab = [r["term"] for r in sorted(voc_rows, key=lambda r: r["term_index"])]
    idf = [float(r["idf"]) for r in sorted(voc_rows, key=lambda r: r["term_index"])]
    if not vocab:
        vocab, idf = ["\u0000"], [0.0]
    return [
        tokenize(text_col, f"{out}_tok"),
        CountVectorizerModel.from_vocabulary(vocab, inputCol=f"{out}_tok", outputCol=f"{out}_tf"),
        ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol=f"{out}_tf", outputCol=f"{out}_tfidf"),
        Normalizer(p=2.0, inputCol=f"{out}_tfidf", outputCol=out),
    ]


# ---------------------------------------------------------------- F7
def class_weights(train: DataFrame, label: str) -> DataFrame:
    """weight = n / (k * n_class) per class ('balanced')."""
    counts = train.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n_class"))
    tot = counts.agg(F.sum("n_class").alias("n"), F.count(F.lit(1)).alias("k"))
    return (counts.withColumn("_j", F.lit(1)).join(tot.withColumn("_j", F.lit(1)), "_j")
            .select(label, (F.col("n") / (F.col("k") * F.col("n_class"))).alias("weight")))


def with_class_weights(df: DataFrame, weights: DataFrame, label: str, col: str = "weight",
                       max_broadcast_rows: int = 100_000) -> DataFrame:
    """Attach per-class weights (broadcast only after a size check of the class table)."""
    small = weights.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows
    w = F.broadcast(weights) if small else weights
    return df.join(w.withColumnRenamed("weight", col), label, "left").fillna({col: 1.0})


# ---------------------------------------------------------------- F8
def label_indexer(label: str, out: str = "label_idx") -> StringIndexer:
    """F8: label -> index in ascending value order.  Exactly the classes of the training part
    (``with_label_index`` keeps rows of other classes)."""
    return StringIndexer(inputCol=label, outputCol=out, stringOrderType="alphabetAsc",
                         handleInvalid="skip")


def with_label_index(df: DataFrame, label: str, labels: list[str], out: str = "label_idx") -> DataFrame:
    """F8 for every labelled row: a class that training never saw gets an index of its own beyond the
    model's classes (from its hash), so its rows are scored and count as errors.  Rows without a label go."""
    kept = StringIndexerModel.from_labels(labels, inputCol=label, outputCol="__idx", handleInvalid="keep")
    df = kept.transform(df.where(F.col(f"`{label}`").isNotNull()))
    beyond = (F.lit(len(labels)) + F.pmod(F.xxhash64(F.col(f"`{label}`").cast("string")), F.lit(1 << 52))).cast("double")
    index = F.when(F.col("__idx") < len(labels), F.col("__idx")).otherwise(beyond)
    return df.withColumn(out, index.alias(out, metadata={"ml_attr": {"type": "nominal", "name": out, "vals": list(labels)}})).drop("__idx")


# ---------------------------------------------------------------- F4 / F6: the column transformer
@dataclass
class FeatureSpec:
    numerical: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    impute: bool = True          # F1/F2 ("missing_value_imputation")
    scale: bool = True           # F3 ("feature_scaling")
    encode: bool = True          # F4 ("categorical_encoding")
    tfidf: bool = False          # F5 ("tfidf_vectorization", first text column only)
    max_terms: int = MAX_TERMS


@dataclass
class FittedFeatures:
    model: PipelineModel
    names: list[str]
    output_col: str = "features"

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


def fit_features(train: DataFrame, spec: FeatureSpec, output_col: str = "features") -> FittedFeatures:
    """numeric / categorical / text branches fitted on ``train``, other columns dropped.

    With no branch at all the numeric columns pass through unchanged.
    """
    stages: list = []
    parts: list[str] = []
    names: list[str] = []
    num, cat = list(spec.numerical), list(spec.categorical)

    # one SQL stage: cast numerics to double, fill categoricals with the train mode
    sel = ["*"]
    num_cols = [f"__num_{i}" for i in range(len(num))]
    for c, o in zip(num, num_cols):
        sel.append(f"CAST({_q(c)} AS DOUBLE) AS {_q(o)}")
    cat_cols = [f"__cat_{i}" for i in range(len(cat))]
    for c, o in zip(cat, cat_cols):
        if spec.impute:
            sel.append(f"COALESCE(CAST({_q(c)} AS STRING), {_lit(most_frequent(train, c))}) AS {_q(o)}")
        else:
            sel.append(f"CAST({_q(c)} AS STRING) AS {_q(o)}")
    if spec.tfidf and spec.text:
        sel.append(f"COALESCE(CAST({_q(spec.text[0])} AS STRING), '') AS `__text`")
    stages.append(SQLTransformer(statement=f"SELECT {', '.join(sel)} FROM __THIS__"))

    if num:
        cur = num_cols
        if spec.impute:
            imp_out = [f"{c}_imp" for c in num_cols]
            stages.append(Imputer(strategy="mean", inputCols=cur, outputCols=imp_out))
            cur = imp_out
        stages.append(VectorAssembler(inputCols=cur, outputCol="__num_vec", handleInvalid="keep"))
        if spec.scale:
            stages.append(StandardScaler(inputCol="__num_vec", outputCol="__num_std", withMean=True,
                                         withStd=True))
            n = train.count()
            corr = math.sqrt(n / (n - 1)) if n > 1 else 1.0
            stages.append(ElementwiseProduct(scalingVec=Vectors.dense([corr] * len(num)),
                                             inputCol="__num_std", outputCol="__num_out"))
            parts.append("__num_out")
        else:
            parts.append("__num_vec")
        names += num
    if cat and spec.encode:
        idx_cols = [f"{c}_idx" for c in cat_cols]
        oh_cols = [f"{c}_oh" for c in cat_cols]
        stages.append(StringIndexer(inputCols=cat_cols, outputCols=idx_cols, stringOrderType="alphabetAsc",
                                    handleInvalid="keep"))
        # the indexer's extra "unknown" slot is the last one, so dropLast removes
        # exactly that slot: an unseen value encodes as all zeros
        stages.append(OneHotEncoder(inputCols=idx_cols, outputCols=oh_cols, dropLast=True))
        parts += oh_cols
    if spec.tfidf and spec.text:
        voc = term_table(train, spec.text[0], spec.max_terms).collect()
        stages += tfidf_stages(voc, "__text", "__text_vec")
        parts.append("__text_vec")

    if not parts:
        # nothing selected: numeric columns as they are
        stages.append(VectorAssembler(inputCols=num_cols, outputCol="__num_vec", handleInvalid="keep"))
        parts.append("__num_vec")
        names += num
    stages.append(VectorAssembler(inputCols=parts, outputCol=output_col, handleInvalid="keep"))

    # fit stage by stage (fitted estimators replaced by their models)
    fitted = []
    cur_df = train
    for st in stages:
        if hasattr(st, "fit") and not hasattr(st, "transform"):
            st = st.fit(cur_df)
        elif isinstance(st, (Imputer, StandardScaler, StringIndexer, OneHotEncoder)):
            st = st.fit(cur_df)
        fitted.append(st)
        cur_df = st.transform(cur_df)
    model = PipelineModel(stages=fitted)
    if cat and spec.encode:
        si = next(s for s in fitted if s.__class__.__name__ == "StringIndexerModel")
        for c, labels in zip(cat, si.labelsArray):
            names += [f"{c}_{v}" for v in labels]  # dropLast removes the unknown slot
    if spec.tfidf and spec.text:
        names += [r["term"] for r in sorted(voc, key=lambda r: r["term_index"])] or ["\u0000"]
    return FittedFeatures(model, names, output_col)

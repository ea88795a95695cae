"""A corpus pipeline over ``documents``: from raw texts to token ids.

Each stage reads the rows that its predecessor kept (written as Parquet and reread)
and calls one operator of ``tabsmith.llm``:

1. quality    rows that the boosted-tree classifier scores under 0.5 go;
2. near_dups  of each group of near copies (five-word shingles, Jaccard 0.8 or more)
              the row with the smallest id stays; equal rows count once;
3. benchmark  rows go of which a twentieth or more of the words lies in benchmark windows;
4. secrets    secrets in the texts are replaced; every row stays;
5. tokens     texts become token ids, decoded again as a check.

Stages 1 to 4 return the columns that they were given.  Nulls, empty texts and
empty tables pass as the operators state it; a row with a null id is never a near copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions.ordering import materialize
from tabsmith.llm import op01_bpe, op02_jaccard_join, op05_quality, op08_secrets, op10_decontaminate
from tabsmith.llm.base import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SHINGLE, SIMILARITY = 5, (4, 5)
BROADCAST_IDS = 1_000_000   # ids (8 bytes each) that may be sent to all tasks; more are joined by shuffling


def _nested(docs: DataFrame) -> DataFrame:
    """(id, text, row): the row as one column, so that an operator's names can't clash with it."""
    return docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = op05_quality.fit(docs, table(spark, sf_dir, "labels"))
    return op05_quality.score(_nested(docs), model, "id", "text", keep=["row"]).filter("score >= 0.5").select("row.*")


def _checked(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = materialize(op02_jaccard_join.jaccard_join(docs, shingle=SHINGLE, similarity=SIMILARITY), "near_dups")
    gone = materialize(found.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    twice = materialize(found.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c"))
                        .filter("c > 1").select("doc_id"), "twice")
    kept = docs.join(_checked(gone), "doc_id", "left_anti").select(docs.columns)
    if twice.isEmpty():
        return kept
    again = _checked(twice)
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = op08_secrets.redact(docs, op08_secrets.fit(docs))
    if "n_chars" not in docs.columns:
        return clean
    kind = dict(docs.dtypes)["n_chars"]
    return clean.withColumn("n_chars", F.length("text").cast(kind)).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as public
    vocabulary = op01_bpe.Vocabulary(public.path(VOCABULARY), public.PATTERN)
    out = op01_bpe.encode_decode(docs, vocabulary)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_dups", near_dups), ("benchmark", benchmark), ("secrets", secrets), ("tokens", tokens)]

# Model scores, components and merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

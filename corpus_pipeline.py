"""A cleaning pipeline over ``documents``: quality, near-duplicates, repeated passages, benchmark leaks, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. Columns other than id, text and
language travel along untouched, except that ``n_chars`` follows a text that a stage shortens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from onledger.llm import anchors, chosen, pieces, quality, queries, winnow
from onledger.session import materialize

KEYS = ["__id", "__no_id", "__text"]


def keyed(docs: DataFrame) -> DataFrame:
    """Add what tells rows apart: the id, whether it is null, and a key of the text."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.withColumns({"__id": F.coalesce(docs["doc_id"].cast("long"), F.lit(0)), "__no_id": docs["doc_id"].isNull(), "__text": F.xxhash64(text)})


def wanted(decided: DataFrame, *more) -> DataFrame:
    return decided.select(F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__no_id"), F.col("text_key").alias("__text"), *more)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    good = wanted(quality.judge(docs).filter("kept"), F.col("lang").alias("__lang"))
    own = keyed(docs).withColumn("__lang", F.coalesce(docs["lang"].cast("string"), F.lit("")))
    return own.join(good, [*KEYS, "__lang"], "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document with the smallest id stays, once. Documents without words are in no class and stay."""
    found = materialize(chosen.groups(docs), "pipeline-classes")
    first = found.filter("class_key is not null").groupBy("class_key").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")).select("first.*")
    alone = found.filter("class_key is null").select(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    own = keyed(docs)
    kept = own.join(wanted(first), KEYS, "left_semi").dropDuplicates(KEYS)
    return kept.unionByName(own.join(wanted(alone), KEYS, "left_semi")).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word windows that occurred before are cut out of the texts."""
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = anchors.dedup(docs, 20, carry=other)
    if "n_chars" in other:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = winnow.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"), 10)
    return keyed(docs).join(wanted(found.filter("not contaminated")), KEYS, "left_semi").select(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return pieces.encode_decode(docs, queries.tokenizer_path(), full=True).drop("decoded")


STAGES = [("quality_rules", quality_rules), ("ngram_jaccard_join", near_duplicates), ("substring_dedup", substring_dedup),
          ("benchmark_decontamination", decontaminate), ("sentencepiece", sentencepiece)]

#: The stages' decisions cannot be put in SQL that would finish on whole tables; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read back before the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""The registered queries of this package: thin wrappers that apply an operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from onledger.llm import checks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(job):
        QUERIES[name] = job
        if sql:
            SQL[name] = sql
        return job

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """Where the public vocabulary files lie; the operator itself takes any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_sentencepiece")
def op1(spark, folder):
    from onledger.llm import pieces

    return pieces.encode_decode(table(spark, folder, "documents"), tokenizer_path())


@query("op8_ctw_score")
def op8(spark, folder):
    from onledger.llm import ctw

    return ctw.score(table(spark, folder, "documents"), 7, 2)


@query("op5_substring_dedup", checks.SUBSTRING_DEDUP)
def op5(spark, folder):
    from onledger.llm import anchors

    return anchors.dedup(table(spark, folder, "documents"), 20)


@query("op2_suffix_dedup")
def op2(spark, folder):
    from onledger.llm import suffixes

    return suffixes.remove_repeats(table(spark, folder, "documents"), 400)


@query("op9_quality_attention")
def op9(spark, folder):
    from onledger.llm import attention

    return attention.classify(table(spark, folder, "documents"), table(spark, folder, "labels"), "quality", 5, 0, 0.3)


@query("op10_toxicity_noisy_or")
def op10(spark, folder):
    from onledger.llm import noisyor

    return noisyor.classify(table(spark, folder, "documents"), table(spark, folder, "labels"), "toxic", 3, 1, 0.7)


@query("op7_quality_rules", checks.quality_rules())
def op7(spark, folder):
    from onledger.llm import quality

    out = quality.judge(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op6_jaccard_groups")
def op6(spark, folder):
    from onledger.llm import chosen

    return chosen.groups(table(spark, folder, "documents"))


@query("op3_winnowing", checks.DECONTAMINATION)
def op3(spark, folder):
    from onledger.llm import winnow

    return winnow.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"), 10).drop("text_key")


@query("op4_url_templates")
def op4(spark, folder):
    from onledger.llm import urls

    return urls.judge(table(spark, folder, "pages"))


@query("op11_tokenizer_alignment")
def op11(spark, folder):
    from onledger.llm import overlaps

    return overlaps.compare(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path())


@query("op13_spelling_variants")
def op13(spark, folder):
    from onledger.llm import variants

    return variants.group(table(spark, folder, "documents"))


@query("op12_minhash_groups")
def op12(spark, folder):
    from onledger.llm import collisions

    return collisions.groups(table(spark, folder, "documents"))

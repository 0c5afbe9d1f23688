"""Quality rules: base counts, and the distance of a document's histograms from those of its language. DataFrame functions only.

Two histograms describe a document: character classes, and its language's most common words with one bin for all others. The
references are the same histograms summed over every document of the language. A document is rejected if a base rule fails,
or if it is long enough to judge and the Jensen-Shannon distance of a histogram exceeds its limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onledger.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
#: What each class leaves of a text: a pattern that matches everything else.
CLASSES = {
    "upper": r"[^A-Z]+", "digit": r"[^0-9]+", "symbol": r"[^#*$%&|<>]+", "stop": r"[^.,;:]+", "mark": r"[^!?\"'()\-/@_=+~\[\]{}\\^`]+",
    "wide": r"[\x00-\x7F]+",
}
#: Up to so many rows and bytes of text a reference table is broadcast; larger ones are joined by shuffling.
LIGHT_ROWS = 20_000
LIGHT_BYTES = 4_000_000
COMMON = 40
MIN_WORDS = 50
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.45


def words(text: Column) -> Column:
    """Words of a text; one empty string where it has none."""
    return F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), SPACE)


def repeated_words(w: Column, n: Column, width: int) -> dict[str, Column]:
    """Steps of the count of words in windows that occur twice; each is a column of its own, as the next uses it repeatedly."""
    windows = F.when(n >= width, F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width))))
    h = F.col("_windows")
    again = F.size(F.array_distinct(h)) < F.size(h)
    placed = F.when(again, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    p = F.col("_placed")
    last = F.size(p) - 1
    near = lambda j: F.coalesce(p[j]["h"] == F.when(j > 0, p[j - 1]["h"]), F.lit(False)) | F.coalesce(
        p[j]["h"] == F.when(j < last, p[j + 1]["h"]), F.lit(False))
    starts = F.when(p.isNotNull(), F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), last), near), lambda j: p[j]["i"])))
    s = F.col("_starts")
    covered = F.when(F.size(s) > 0, F.aggregate(F.sequence(F.lit(1), F.size(s)), F.lit(width), lambda acc, j: acc + F.when(
        j < F.size(s), F.least(F.lit(width), s[j] - s[j - 1])).otherwise(0)))
    return {"_windows": windows, "_placed": placed, "_starts": starts, "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long")}


def measures(docs: DataFrame, id_col: str, text_col: str, lang_col: str, width: int = 8) -> DataFrame:
    """One row for each document: id, key of its text, language, base counts and character classes."""
    out = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[lang_col].cast("string"), F.lit("")).alias("lang"),
                      F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    out = out.withColumn("_w", words(F.col("text")))
    out = out.withColumn("n_words", F.when(F.col("_w")[0] == "", 0).otherwise(F.size("_w")).cast("long"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("_lines", F.when(F.col("text").contains("\n"), lines))
    for name, column in repeated_words(F.col("_w"), F.col("n_words").cast("int"), width).items():
        out = out.withColumn(name, column)
    left = {name: F.length(F.regexp_replace("text", pattern, "")).cast("long") for name, pattern in CLASSES.items()}
    return out.select(
        "doc_id", F.xxhash64("text").alias("text_key"), "lang", "n_words",
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        F.coalesce(F.size("_lines") - F.size(F.array_distinct("_lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        "n_repeat_words", F.length("text").cast("long").alias("n_chars"), *[c.alias(f"c_{n}") for n, c in left.items()])


def classes() -> dict[str, Column]:
    """Counts of all character classes, the last one being everything the others leave."""
    found = {n: F.col(f"c_{n}") for n in CLASSES}
    rest = F.col("word_chars")
    for c in found.values():
        rest = rest - c
    return found | {"space": F.col("n_chars") - F.col("word_chars"), "rest": F.greatest(rest, F.lit(0))}


def part(p: Column, q: Column) -> Column:
    """One bin's share of the Jensen-Shannon divergence in bits."""
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) / 2 + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0) / 2


def few(table: DataFrame, *texts: str) -> bool:
    """Whether the rows of a stored table and the bytes of its texts are counted and found few enough to broadcast."""
    found = table.agg(F.count("*").alias("n"), F.sum(sum((F.octet_length(c) for c in texts), F.lit(0)).cast("long")).alias("b")).first()
    return found["n"] <= LIGHT_ROWS and (found["b"] or 0) <= LIGHT_BYTES


def histogram_distances(base: DataFrame, docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(doc_id, text_key, lang) of ``base`` with char_distance and word_distance."""
    kinds = classes()
    sums = base.groupBy("lang").agg(*[F.sum(c).cast("double").alias(f"r_{n}") for n, c in kinds.items()], F.sum("n_words").alias("r_words"))

    token = docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
                        F.coalesce(docs[lang_col].cast("string"), F.lit("")).alias("lang"))
    token = token.select("lang", F.xxhash64("text").alias("text_key"), F.explode_outer(words(F.lower("text"))).alias("word"))
    token = token.filter(F.col("word") != "")
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    common = (token.groupBy("lang", "word").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(rank))
              .filter(F.col("r") <= COMMON).drop("r").join(sums.select("lang", "r_words"), "lang")
              .select("lang", "word", (F.col("n") / F.col("r_words")).alias("q")))
    common = materialize(common, "quality-common")
    total = common.groupBy("lang").agg(F.sum("q").alias("q_all"))
    references = materialize(sums.join(total, "lang", "left"), "quality-references")
    if few(common, "lang", "word"):
        seen = (token.join(F.broadcast(common), ["lang", "word"]).groupBy("text_key", "lang", "word")
                .agg(F.count("*").cast("double").alias("n"), F.first("q").alias("q")))
    else:  # counted first, so that a frequent word arrives once for each text and the join can be split where it is skewed
        seen = token.groupBy("text_key", "lang", "word").agg(F.count("*").cast("double").alias("n")).join(common, ["lang", "word"])
    # Equal texts of one language meet under one key; their counts are multiples of each other, their histograms equal.
    keyed = base.groupBy("text_key", "lang").agg(F.sum("n_words").cast("double").alias("all_words"))
    words_of = (seen.join(keyed, ["text_key", "lang"]).withColumn("p", F.col("n") / F.col("all_words"))
                .groupBy("text_key", "lang").agg(F.sum(part(F.col("p"), F.col("q")) - F.col("q") / 2).alias("js"), F.sum("p").alias("p_all")))
    out = base.join(F.broadcast(references) if few(references, "lang") else references, "lang").join(words_of, ["text_key", "lang"], "left")
    chars = F.lit(0.0)
    r_all = sum((F.col(f"r_{n}") for n in kinds), F.lit(0.0))
    for name, count in kinds.items():
        chars = chars + part(F.coalesce(count / F.nullif(F.col("n_chars"), F.lit(0)), F.lit(0.0)),
                             F.coalesce(F.col(f"r_{name}") / F.nullif(r_all, F.lit(0.0)), F.lit(0.0)))
    p_all, q_all = F.coalesce("p_all", F.lit(0.0)), F.coalesce("q_all", F.lit(0.0))
    other = part(F.greatest(1 - p_all, F.lit(0.0)), F.greatest(1 - q_all, F.lit(0.0)))
    word = F.coalesce("js", F.lit(0.0)) + q_all / 2 + other
    root = lambda c: F.sqrt(F.greatest(c, F.lit(0.0)))
    return out.withColumn("char_distance", root(chars)).withColumn("word_distance", root(word))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = MIN_WORDS,
          max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Measure every document and decide whether it stays.

    Result, one row for each input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    char_distance, word_distance, text_key and lang (null as empty). Null texts count as empty, which fails the word minimum.
    Documents under ``min_words`` words are judged by the base rules alone.
    """
    base = materialize(measures(docs, id_col, text_col, lang_col), "quality-base")
    out = histogram_distances(base, docs, text_col, lang_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    far = (F.col("n_words") >= min_words) & ((F.col("char_distance") > max_char) | (F.col("word_distance") > max_word))
    return out.select("doc_id", "n_words", "word_chars", F.col("c_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
                      failed.alias("base_failed"), (~failed & ~far).alias("kept"), "char_distance", "word_distance", "text_key", "lang")

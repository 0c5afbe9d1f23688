"""Benchmark decontamination by winnowing. DataFrame functions only.

Of every ``window - k + 1`` consecutive k-grams of a document and of an item the one with the smallest hash is kept. A shared
span of ``window`` words holds the same k-grams in both, so both keep its smallest: joining the kept hashes meets every such
span. Each hit is then extended to the windows around it, comparing the words themselves. Items shorter than a window are one
window of their own length; their hashes are joined with those of all spans of that length, and compared likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words before A-Z are folded to lower case, so upper case counts as a part of words here.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fingerprints of benchmark items that may be sent to every task: some 30 MB at most. More than that are joined by a shuffle.
SENT = 100_000


def grams(words: Column, n: Column, k) -> Column:
    """Hash of the k words from each place; an empty array where there are fewer.

    ``lower`` also folds other letters than A-Z. That only adds candidates: hits are compared by their ``exact`` words.
    """
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - (k - 1)), lambda i: F.xxhash64(F.lower(F.array_join(
        F.slice(words, i, k), " "))))).otherwise(F.array().cast("array<bigint>"))


def with_words(table: DataFrame) -> DataFrame:
    return table.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).withColumn("n", F.size("words"))


def fingerprints(table: DataFrame, window: int, k: int) -> DataFrame:
    """``table`` with the hashes of all k-grams (``h``) and the kept ones (``kept``)."""
    span = window - k + 1
    h, m = F.col("h"), F.size("h")
    return (table.withColumn("h", grams(F.col("words"), F.col("n"), k))
            .withColumn("kept", F.when(m >= span, F.array_distinct(F.transform(F.sequence(F.lit(1), m - (span - 1)), lambda i: F.array_min(
                F.slice(h, i, span))))).otherwise(F.array().cast("array<bigint>"))))


def around(words: Column, at: Column, before: int, width: int) -> Column:
    """``width`` words from ``before`` ahead of place ``at`` (from 0) on, null outside the text."""
    return F.transform(F.sequence(at - before + 1, at - before + width), lambda i: F.when((i >= 1) & (i <= F.size(words)), F.get(words, i - 1)))


def exact(words: Column) -> Column:
    return F.transform(words, lambda w: F.translate(w, UPPER, LOWER))


def places(h: Column, fp: Column) -> Column:
    """Places from 0 of a hash."""
    return F.filter(F.transform(h, lambda x, i: F.when(x == fp, i)), lambda i: i.isNotNull())


def tagged(hashes: Column, kind: int) -> Column:
    return F.transform(hashes, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("fp")))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Find the words of documents that lie in a window of a benchmark item.

    Result, one row for each input row: doc_id, n_words, n_hit (words inside an occurrence of a window), n_items, items_sha256
    (their ids sorted as strings, joined by commas), contaminated, text_key (xxhash64 of the text, null as empty). Null and
    empty texts have no words and no windows; a null item id counts as an empty string. Repeated rows get equal results.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    bench = items.select(F.coalesce(items[item_id].cast("string"), F.lit("")).alias("item"),
                         F.coalesce(items[item_text].cast("string"), F.lit("")).alias("text"))
    bench = with_words(bench).drop("text")
    reach = window - k

    long = fingerprints(bench.filter(F.col("n") >= window), window, k)
    long = (long.select("item", "words", "h", F.explode_outer("kept").alias("fp"))
            .select("item", "fp", "words", F.explode(places(F.col("h"), F.col("fp"))).alias("at"))
            .select(F.lit(0).alias("kind"), "fp", "item", exact(around(F.col("words"), F.col("at"), reach, window + reach)).alias("item_words")))
    short = bench.filter((F.col("n") > 0) & (F.col("n") < window))
    sizes = sorted(r["n"] for r in short.select("n").distinct().collect())  # fewer than ``window`` numbers
    short = short.select(F.col("n").alias("kind"), F.xxhash64(F.lower(F.array_join("words", " "))).alias("fp"), "item",
                         exact(F.col("words")).alias("item_words"))
    wanted = long.unionByName(short)  # kind: 0 for kept k-grams, else the length of an item shorter than a window

    rows = fingerprints(with_words(own).drop("text"), window, k)
    every = tagged(F.col("kept"), 0)
    for size in sizes:
        every = F.concat(every, tagged(F.array_distinct(grams(F.col("words"), F.col("n"), size)), size))
    # A column of its own, so that the explode is compiled and copies no row before the join; outer, as Spark would otherwise
    # compute the array a second time to see whether it is empty.
    rows = rows.withColumn("every", every)
    if wanted.limit(SENT + 1).count() <= SENT:
        # The words stay with the row: nothing of a document moves unless a hash is found.
        met = rows.select("doc_id", "text_key", "words", "n", "h", F.explode_outer("every").alias("f")).select("*", "f.*").drop("f")
        met = met.join(F.broadcast(wanted), ["kind", "fp"])
    else:
        met = rows.select("doc_id", "text_key", F.explode_outer("every").alias("f")).select("doc_id", "text_key", "f.*")
        met = met.join(wanted, ["kind", "fp"]).withColumnsRenamed({"doc_id": "id", "text_key": "key"})
        met = met.join(rows.drop("every").dropDuplicates(["doc_id", "text_key"]), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key")))
    kind, at, item_words = F.col("kind"), F.col("at"), F.col("item_words")
    hashes = F.when(kind == 0, F.col("h"))
    if sizes:
        hashes = hashes.otherwise(grams(F.col("words"), F.col("n"), kind))
    met = met.select("doc_id", "text_key", "kind", "item", "item_words", "words", F.explode(places(hashes, F.col("fp"))).alias("at"))
    before, width = F.when(kind == 0, reach).otherwise(0), F.when(kind == 0, window + reach).otherwise(kind)
    met = met.select("doc_id", "text_key", "kind", "item", "item_words", "at", exact(around(F.col("words"), at, before, width)).alias("doc_words"))
    same = lambda j: F.forall(F.slice("item_words", j + 1, window), lambda w: w.isNotNull()) & (
        F.slice("item_words", j + 1, window) == F.slice("doc_words", j + 1, window))
    starts = F.when(kind == 0, F.filter(F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda j: F.when(same(j), at - reach + j)), lambda x: x.isNotNull())
                    ).when(item_words == F.col("doc_words"), F.array(at)).otherwise(F.array().cast("array<int>"))
    spans = (met.select("doc_id", "text_key", "item", F.when(kind == 0, window).otherwise(kind).alias("width"), F.explode(starts).alias("start"))
             .groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "width")).alias("spans"), F.collect_set("item").alias("items")))
    covered = F.aggregate(F.sort_array("spans"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")), lambda acc, s: F.struct(
        F.greatest(acc["end"], s["start"] + s["width"]).alias("end"),
        (acc["total"] + F.greatest(F.lit(0), s["start"] + s["width"] - F.greatest(acc["end"], s["start"]))).alias("total")), lambda acc: acc["total"])
    found = spans.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), covered.cast("long").alias("n_hit"),
                         F.size("items").cast("long").alias("n_items"), F.sort_array("items").alias("items"))
    base = own.select("doc_id", "text_key", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"))
    out = base.join(found, base["doc_id"].eqNullSafe(found["id"]) & (base["text_key"] == found["key"]), "left")
    hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", "n_words", hit.cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                      F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
                      (hit > 0).alias("contaminated"), "text_key")

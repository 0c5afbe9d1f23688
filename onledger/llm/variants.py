"""Spelling variants: words one edit apart, found through a gram index whose grams have variable lengths.

A gram dictionary is pruned by frequency: a gram of LEAST characters is always in it, a longer one only if the gram without its
last character starts at more than a limit of places in all distinct words. Marked words (``^word$``) are decomposed into the
longest dictionary gram at every position; a gram grows while it is frequent, so it depends on its own characters only. One edit
affects the grams that hold its place: their largest number at any place is the word's bound. All other grams must be found in
every near word, so of a word's grams in order of their frequency only the first ``bound + 1`` are posted and merged. Posts name
gram, position and word length, which one edit shifts by at most one. Merged pairs are verified.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onledger.llm import blocks as B

RUN = re.compile("[a-zÀ-ÿ]+")
LEAST, MOST = 2, 4  # gram lengths; words of MIN characters have MIN + 1 grams, of which one edit affects at most MOST
MIN, SEEN = 5, 3
FREQUENT = 50_000  # of each length at most so many grams are extended
HELD = 200_000


def runs(text: str) -> list[str]:
    """Runs of Latin letters, A-Z lower-cased."""
    return RUN.findall(text.encode().lower().decode())


def word_counts(docs: DataFrame, id_col: str, text_col: str, every: int) -> DataFrame:
    """(word, n): the words of all texts, where in one of ``every`` distinct words of a document, by a hash, one letter is lost."""
    own = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))

    def count(batches):
        total: dict = {}

        def sums():
            return pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                begun = zlib.crc32(f"{'' if i is None else i}:".encode())
                here: dict = {}
                for w in runs(text.as_py() or ""):
                    here[w] = here.get(w, 0) + 1
                for w, n in here.items():
                    h = zlib.crc32(w.encode(), begun)
                    if every and h % every == 0:
                        w = w[:h % len(w)] + w[h % len(w) + 1:]
                    if len(w) >= MIN:
                        total[w] = total.get(w, 0) + n
                if len(total) > HELD:
                    yield sums()
                    total.clear()
        if total:
            yield sums()

    return own.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= SEEN)


def frequent_grams(words: DataFrame) -> set:
    """Grams of LEAST to MOST - 1 characters that the dictionary extends.

    A word of length m starts m + 1 grams of every length. The limit is their number over FREQUENT, so at most FREQUENT grams of
    a length exceed it, whatever the input: the result is bounded and travels with the tasks.
    """
    places = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    limit = max(8, places // FREQUENT)
    marked = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    grams = None
    for size in range(LEAST, MOST):
        at = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + (3 - size)), lambda i: F.substr(marked, i, F.lit(size)))).alias("gram"))
        grams = at if grams is None else grams.unionByName(at)
    found = grams.groupBy("gram").agg(F.count("*").alias("starts")).filter(F.col("starts") > limit)
    return {r.gram for r in found.toLocalIterator()}


def decompose(word: str, frequent: set) -> tuple[list[str], int]:
    """The gram at every position, and how many of them one edit can affect at most."""
    marked = f"^{word}$"
    grams, reach = [], [0] * len(marked)
    for p in range(len(marked) - 1):
        size = LEAST
        while size < MOST and p + size < len(marked) and marked[p:p + size] in frequent:
            size += 1
        grams.append(marked[p:p + size])
        for i in range(p, p + size):
            reach[i] += 1
    return grams, max(reach)


def posts(words: DataFrame, frequent: set) -> DataFrame:
    """(word, size, n, gram, at): of every word as many of its least frequent grams as one edit can affect, and one more."""
    shared = words.sparkSession.sparkContext.broadcast(frequent)

    def cut(batches):
        for batch in batches:
            out = {k: [] for k in ("word", "n", "bound", "gram", "at")}
            for w, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                grams, bound = decompose(w, shared.value)
                out["word"] += [w] * len(grams)
                out["n"] += [n] * len(grams)
                out["bound"] += [bound] * len(grams)
                out["gram"] += grams
                out["at"] += range(len(grams))
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string() if k in ("word", "gram") else pa.int64()) for k, v in out.items()})

    grams = B.keep(words.mapInArrow(cut, "word string, n long, bound long, gram string, at long"), "word-grams")
    often = grams.groupBy("gram").agg(F.count("*").alias("often"))
    ordered = grams.join(often, "gram").groupBy("word", "n", "bound").agg(F.sort_array(F.collect_list(F.struct("often", "gram", "at"))).alias("grams"))
    first = ordered.select("word", "n", F.length("word").alias("size"), F.explode(F.slice("grams", F.lit(1), F.col("bound").cast("int") + 1)).alias("g"))
    return first.select("word", "n", "size", "g.gram", "g.at")


def near_pairs(posted: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): pairs of words that differ by one inserted, deleted or replaced character, in both directions.

    Each word asks for words of its own length at the same position and for words one longer at the same or the next position.
    """
    b = posted.select("gram", "at", "size", F.col("word").alias("b"), F.col("n").alias("n_b"))
    step = lambda *moves: F.explode(F.array(*[F.struct(F.lit(s).alias("size"), F.lit(p).alias("at")) for s, p in moves]))
    asks = posted.withColumnsRenamed({"size": "_size", "at": "_at"}).withColumn("step", step((0, 0), (1, 0), (1, 1)))
    a = asks.select("gram", (F.col("_at") + F.col("step.at")).alias("at"), (F.col("_size") + F.col("step.size")).alias("size"),
                    F.col("step.size").alias("longer"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    met = a.join(b, ["gram", "at", "size"]).filter("longer = 1 or a < b")
    # verified where they meet, so only true pairs travel on; a pair may meet under several grams
    one = met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))


def group(docs: DataFrame, every: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group the spelling variants of all texts.

    Result, one row for each distinct word of at least MIN letters that occurs at least SEEN times: word, n, form (of its near
    words the most frequent, ties to the smallest, if that has at least twice its n), root (the last of the chain of forms, the
    word itself if none), n_near, form_n. ``every`` is the share of words that lose a letter before counting (0: none). Null and
    empty texts have no words; a null id hashes as an empty one; repeated rows count again. Other columns are ignored.
    """
    words = B.keep(word_counts(docs, id_col, text_col, every), "words")
    pairs = near_pairs(B.keep(posts(words, frequent_grams(words)), "word-posts"))
    best = pairs.groupBy(F.col("a").alias("word"), F.col("n_a").alias("n")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("top"))
    chosen = best.select("word", "n_near", F.when(-F.col("top.less") >= 2 * F.col("n"), F.struct("top.form", (-F.col("top.less")).alias("form_n"))).alias("c"))
    out = words.join(chosen, "word", "left").select("word", "n", F.col("c.form").alias("form"), F.col("c.form_n").alias("form_n"),
                                                    F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce("c.form", "word").alias("root"))
    out = B.keep(out, "word-forms")
    while True:  # n at least doubles along a chain, so chains have at most 63 steps and this ends after six rounds
        following = out.filter("form is not null").select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = B.keep(out.join(following, "root", "left").withColumn("moved", F.col("next").isNotNull()).withColumn("root", F.coalesce("next", "root")).drop("next"), "word-roots")
        if moved.filter("moved").isEmpty():
            return moved.select("word", "form", "root", "n", "n_near", "form_n")
        out = moved.drop("moved")

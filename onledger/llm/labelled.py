"""A bounded sample of labelled rows for fitting a classifier, and the frame around scoring whole tables with it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onledger.session import materialize

SCORED = "doc_id long, score double"


def fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, max_rows: int, max_bytes: int) -> tuple[list, list]:
    """Texts and labels of at most ``max_rows`` training rows and ``max_bytes`` of text, in order of a hash of their id.

    A document with several labels takes the largest, one with several texts the smallest; null labels and null ids give no
    training row. Both bounds are applied before anything is fetched; a first text that is larger alone still counts. Rows come
    in order of their ids.
    """
    known = (labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("label"))
             .filter("doc_id is not null and label is not null").filter(fold(F.col("doc_id"), modulus) != held)
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = (docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text"))
            .join(F.broadcast(chosen), "doc_id")  # max_rows rows of two numbers
            .groupBy("doc_id", "label").agg(F.coalesce(F.min("text"), F.lit(b"")).alias("text")))
    rows = materialize(rows, "labelled")
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # over at most max_rows ids and sizes
    sizes = rows.select("doc_id", F.octet_length("text").cast("long").alias("size")).withColumn("upto", F.sum("size").over(order))
    within = sizes.filter((F.col("upto") <= max_bytes) | (F.col("upto") == F.col("size"))).select("doc_id")
    found = sorted((r["doc_id"], bytes(r["text"]), r["label"]) for r in rows.join(F.broadcast(within), "doc_id").toLocalIterator())
    return [t for _, t, _ in found], [y for *_, y in found]


def slabs(texts, size: int = 1 << 20):
    """Consecutive texts, about a megabyte at a time, by index range."""
    lo, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size or i == len(texts) - 1:
            yield lo, i + 1
            lo, total = i + 1, 0


def score(docs: DataFrame, predict, modulus: int, held: int, threshold: float, extra: str = "") -> DataFrame:
    """Apply ``predict(texts)``, which returns scores and a dict of more columns, to every row of a table."""
    names = [c.split()[0] for c in extra.split(", ")] if extra else []
    schema = SCORED + (", " + extra if extra else "")

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), [t or b"" for t in batch.column("text").to_pylist()]
            scores, more = [np.zeros(0)], {n: [] for n in names}
            for lo, hi in slabs(texts):
                found, columns = predict(texts[lo:hi])
                scores.append(found)
                for n in names:
                    more[n].extend(columns[n])
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "score": pa.array(np.concatenate(scores))} | {n: pa.array(more[n]) for n in names})

    found = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").cast("binary").alias("text")).mapInArrow(run, schema)
    return found.select("doc_id", (fold(F.col("doc_id"), modulus) == held).alias("held_out"), "score",
                        (F.col("score") >= threshold).cast("int").alias("predicted"), *names)

"""Documents packed into blocks, and exchanges of small keys between blocks and key buckets.

Several operators must look every part of a text up in statistics of the whole corpus (does this key occur elsewhere, where
first, how often). Sending each part with its document id through a shuffle would move many times the input. Instead

* ``blocks`` packs documents into blocks of bounded size, compressed, dealt by a hash of the row. A hot source or a large
  group of copies spreads over all blocks, and a block never grows with the input: there are more of them.
* ``ask`` reduces each block to its own distinct keys (the pre-aggregation), cut into one piece per key bucket.
* ``answer`` brings the pieces of a bucket together. However frequent a key is in the corpus, a block sends it once, so a
  bucket holds a key at most once per block.
* ``finish`` hands every block its documents and the answers to its pieces, in the order in which it asked.

A block orders its rows, so that a stage that Spark repeats after losing an executor asks the same questions again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "bucket long, block long, data binary"
REPLIES = "block long, bucket long, reply binary"
BLOCK_BYTES = 8 << 20


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def expand(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def pack_arrays(*arrays) -> bytes:
    """Arrays of numbers as one compressed value, byte planes apart: count, then type, length and bytes of each."""
    out = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if a.itemsize > 1 else a
        out += [a.dtype.str.encode().ljust(4), np.array([len(a)], np.int64).tobytes(), planes.tobytes()]
    return squeeze(b"".join(out))


def unpack_arrays(raw: bytes) -> list:
    raw = expand(raw)
    count, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for _ in range(count):
        kind, n = np.dtype(raw[at:at + 4].decode().strip()), int(np.frombuffer(raw, np.int64, 1, at + 4)[0])
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 12)
        out.append(np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += 12 + n * kind.itemsize
    return out


def pack_rows(ids, *columns) -> bytes:
    """Rows (id or None, bytes or None, ...) as one compressed value."""
    arrays = [np.array([0 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids], bool).view(np.uint8)]
    for values in columns:
        arrays += [np.array([-1 if v is None else len(v) for v in values], np.int64),
                   np.frombuffer(b"".join(v for v in values if v), np.uint8)]
    return pack_arrays(*arrays)


def split(lengths, blob) -> list:
    """The values of a column: bytes, or None where the length is negative."""
    raw, at, out = blob.tobytes(), 0, []
    for n in lengths.tolist():
        out.append(None if n < 0 else raw[at:at + n])
        at += max(n, 0)
    return out


def unpack_rows(raw: bytes):
    ids, null, *rest = unpack_arrays(raw)
    columns = [split(rest[i], rest[i + 1]) for i in range(0, len(rest), 2)]
    return zip((None if gone else i for i, gone in zip(ids.tolist(), null.tolist())), *columns)


def block_rows(table: pa.Table) -> list:
    """The rows of one block, ordered by id (nulls first), text and what they carry: (id, bytes or None, carried or None)."""
    rows = [row for raw in table.column("data") for row in unpack_rows(raw.as_py())]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or b"", r[2] or b""))
    return rows


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list | None = None,
           block_bytes: int | None = None) -> DataFrame:
    """(block, data): the id and text of every row, dealt into blocks of about ``block_bytes`` (BLOCK_BYTES) by a hash of the row.

    ``carry`` names columns that travel with a row as JSON, see ``carried``.
    """
    other = F.to_json(F.struct(*[docs[c] for c in carry])).cast("binary") if carry else F.lit(None).cast("binary")
    own = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").cast("binary").alias("text"),
                      other.alias("carry"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // (block_bytes or BLOCK_BYTES)))

    def deal(batches):
        for batch in batches:
            where = batch.column("block").to_numpy(zero_copy_only=False)
            ids, texts, more = (batch.column(c).to_pylist() for c in ("id", "text", "carry"))
            order = np.argsort(where, kind="stable")
            edges = np.flatnonzero(np.diff(where[order], prepend=-1))
            for lo, hi in zip(edges, [*edges[1:], len(order)]):
                rows = order[lo:hi]
                yield pa.RecordBatch.from_pydict({"block": pa.array([int(where[order[lo]])], pa.int64()),
                                                  "data": pa.array([pack_rows(*([x[i] for i in rows] for x in (ids, texts, more)))], pa.binary())})

    return own.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(count))).mapInArrow(deal, "block long, data binary")


def buckets_for(packed: DataFrame, docs: DataFrame) -> int:
    """Key buckets: as many as shuffle partitions and a few more, so that hashing spreads them evenly."""
    return 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(keys, buckets: int):
    """Bucket of each well-mixed 64-bit key, increasing with the key."""
    return ((keys >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)


def slices(keys, buckets: int):
    """(bucket, from, to) over sorted keys."""
    if not len(keys):
        return
    where = bucket_of(keys, buckets)
    edges = np.flatnonzero(np.diff(where.astype(np.int64), prepend=-1))
    for lo, hi in zip(edges, [*edges[1:], len(keys)]):
        yield int(where[lo]), int(lo), int(hi)


def ask(packed: DataFrame, pieces) -> DataFrame:
    """``pieces(rows)`` yields (bucket, binary) for the rows of one block."""

    def run(key, table):
        made = list(pieces(block_rows(table)))
        return pa.table({"bucket": pa.array([b for b, _ in made], pa.int64()), "block": pa.array([key[0].as_py()] * len(made), pa.int64()),
                         "data": pa.array([d for _, d in made], pa.binary())})

    return packed.groupBy("block").applyInArrow(run, PIECES)


def answer(asked: DataFrame, reply) -> DataFrame:
    """``reply(bucket, [(block, data), ...])`` yields (block, binary) for the pieces of a bucket, which come in block order.

    The answers are dealt by block at once: later steps that read them again then reuse that exchange.
    """

    def run(key, table):
        came = sorted(zip(table.column("block").to_pylist(), table.column("data").to_pylist()))
        made = list(reply(key[0].as_py(), came))
        return pa.table({"block": pa.array([b for b, _ in made], pa.int64()), "bucket": pa.array([key[0].as_py()] * len(made), pa.int64()),
                         "reply": pa.array([d for _, d in made], pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, REPLIES).repartition("block")


def finish(packed: DataFrame, replies: DataFrame, result, schema: str) -> DataFrame:
    """``result(block, rows, {bucket: binary})`` returns a dict of columns for one block."""

    def run(key, left, right):
        got = dict(zip(right.column("bucket").to_pylist(), right.column("reply").to_pylist()))
        return pa.table(result(key[0].as_py(), block_rows(left), got))

    return packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


def carried(df: DataFrame, source: DataFrame, columns: list, column: str = "carry") -> DataFrame:
    """Bring carried columns back as columns of their own types."""
    schema = source.select(*columns).schema
    return df.withColumn(column, F.from_json(column, schema)).select("*", *[F.col(column)[c].alias(c) for c in columns]).drop(column)


def marks(flags) -> bytes:
    return squeeze(np.packbits(flags).tobytes())


def unmarks(raw: bytes, n: int):
    return np.unpackbits(np.frombuffer(expand(raw), np.uint8), count=n).astype(bool)


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write a stage to the shared folder and read it back."""
    from onledger.session import materialize

    return materialize(df, label)

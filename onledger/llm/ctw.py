"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions (the path of bits read so far is a node, 255 in all). Each decision has a context tree over
the DEPTH bytes before it, nearest first; every tree node holds a Krichevsky-Trofimov estimate, and a node's probability is
half its own estimate and half the product of its children's. Counts come from every training document. As a trained tree is
fixed while scoring, the probability of a byte depends on the DEPTH bytes before it alone, so documents are scored by looking
their distinct (context, byte) grams up in the tree: grams are counted per block, summed per bucket of nearest two bytes
(which holds whole subtrees of depth two), and answered to the blocks. What is above depth two is at most 256 * 255 nodes.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onledger.llm import blocks as B
from onledger.llm import text as T

DEPTH = 4
END = 255  # no byte of UTF-8; stands for the end of a text and for what is before its start
U = np.uint64
SLAB = 1 << 20
LN2 = math.log(2)
HALVES = np.concatenate(([0.0], np.cumsum(np.log(np.arange(4096) + 0.5))))  # log Gamma(n + 1/2) - log Gamma(1/2)
WHOLE = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 4096)))))  # log n!
SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
          "n_bytes long, bits_per_byte double")


def _stirling(x):
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x ** 3)


def log_half(n):
    n = np.asarray(n, np.int64)
    return np.where(n < len(HALVES), HALVES[np.minimum(n, len(HALVES) - 1)], _stirling(np.maximum(n, 1) + 0.5) - 0.5 * math.log(math.pi))


def log_factorial(n):
    n = np.asarray(n, np.int64)
    return np.where(n < len(WHOLE), WHOLE[np.minimum(n, len(WHOLE) - 1)], _stirling(np.maximum(n, 1) + 1.0))


def log_kt(n0, n1):
    """Log probability of a sequence of n0 zeros and n1 ones under the Krichevsky-Trofimov estimator."""
    return log_half(n0) + log_half(n1) - log_factorial(np.asarray(n0) + np.asarray(n1))


def weigh(n0, n1, below):
    """A node's log weighted probability from its counts and its children's product, and the share of its own estimate."""
    own = log_kt(n0, n1)
    weighted = np.logaddexp(own, below) - LN2
    return weighted, np.exp(own - LN2 - weighted)


class Level:
    """The tree nodes of one depth for one bit of the byte."""

    def __init__(self, keys, n0, n1, below=None):
        self.keys, self.inverse = np.unique(keys, return_inverse=True)
        m = len(self.keys)
        self.n0 = np.bincount(self.inverse, n0, m).astype(np.int64)
        self.n1 = np.bincount(self.inverse, n1, m).astype(np.int64)
        if below is None:
            self.weighted, self.share = log_kt(self.n0, self.n1), np.ones(m)
        else:
            self.weighted, self.share = weigh(self.n0, self.n1, np.bincount(self.inverse, below, m))


def levels(keys, counts, bit: int):
    """Depths 4, 3 and 2 of a bucket, from sorted grams c1 c2 c3 c4 byte (nearest context first)."""
    one = ((keys >> U(7 - bit)) & U(1)).astype(bool)
    path = (keys & U(255)) >> U(8 - bit)
    leaf = Level((keys >> U(8)) << U(8) | path, np.where(one, 0, counts), np.where(one, counts, 0))
    three = Level((leaf.keys >> U(16)) << U(8) | (leaf.keys & U(255)), leaf.n0, leaf.n1, leaf.weighted)
    two = Level((three.keys >> U(16)) << U(8) | (three.keys & U(255)), three.n0, three.n1, three.weighted)
    return one, leaf, three, two


def tops(keys, counts):
    """What depth one needs of a bucket: nearest byte, node, zeros, ones, log product of the children."""
    out = []
    for bit in range(8):
        _, _, _, two = levels(keys, counts, bit)
        near = (two.keys >> U(16)).astype(np.int64)
        node = (two.keys & U(255)).astype(np.int64) + (1 << bit)
        group, inverse = np.unique(near * 256 + node, return_inverse=True)
        m = len(group)
        out.append((group // 256, group % 256, *(np.bincount(inverse, x, m) for x in (two.n0, two.n1, two.weighted))))
    return [np.concatenate(x) for x in zip(*out)]


def crown(near, node, n0, n1, below):
    """Depths one and zero as arrays: share and estimate of a one, for (byte, node) and for node."""
    c0, c1, prod = np.zeros((256, 256), np.int64), np.zeros((256, 256), np.int64), np.zeros((256, 256))
    c0[near, node], c1[near, node], prod[near, node] = n0, n1, below
    weighted, share1 = weigh(c0, c1, prod)
    seen = (c0 + c1) > 0
    r0, r1 = c0.sum(0), c1.sum(0)
    _, share0 = weigh(r0, r1, np.where(seen, weighted, 0).sum(0))
    return share1, (c1 + 0.5) / (c0 + c1 + 1), share0, (r1 + 0.5) / (r0 + r1 + 1)


def log_probabilities(keys, counts, top):
    """log10 of the probability of each gram's byte after its context."""
    share1, one1, share0, one0 = top
    total = np.zeros(len(keys))
    near = (keys >> U(32)).astype(np.int64)
    for bit in range(8):
        one, leaf, three, two = levels(keys, counts, bit)
        p = ((leaf.n1 + 0.5) / (leaf.n0 + leaf.n1 + 1))[leaf.inverse]
        at = leaf.inverse
        for level in (three, two):
            at = level.inverse[at]
            p = (level.share * (level.n1 + 0.5) / (level.n0 + level.n1 + 1))[at] + (1 - level.share)[at] * p
        node = ((keys & U(255)) >> U(8 - bit)).astype(np.int64) + (1 << bit)
        p = share1[near, node] * one1[near, node] + (1 - share1[near, node]) * p
        p = share0[node] * one0[node] + (1 - share0[node]) * p
        total += np.log10(np.where(one, p, 1 - p))
    return total


def gram_slabs(texts):
    """Grams of consecutive texts, a slab of about a megabyte at a time: keys, and the texts' bounds among them."""
    part, size = [], 0
    for i, raw in enumerate(texts):
        part.append(raw)
        size += len(raw) + 1
        if size >= SLAB or i == len(texts) - 1:
            joined = np.frombuffer(b"".join(bytes([END]) * DEPTH + t + bytes([END]) for t in part), np.uint8).astype(U)
            n = len(joined)
            key = joined[DEPTH:].copy()
            for back in range(1, DEPTH + 1):
                key |= joined[DEPTH - back:n - back] << U(8 * (DEPTH + 1 - back))
            lengths = np.array([len(t) + 1 for t in part])
            begin = np.cumsum(lengths + DEPTH) - lengths - DEPTH
            inside = np.ones(n - DEPTH, bool)
            for b in range(DEPTH):
                gaps = begin[1:] - DEPTH + b
                inside[gaps] = False
            yield key[inside], np.cumsum(lengths) - lengths
            part, size = [], 0


def merge(keys, counts):
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


def distinct_grams(texts, training):
    """Sorted distinct grams of a block and how often the training texts hold each."""
    keys, counts = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for flag in (True, False):
        for key, _ in gram_slabs([t for t, own in zip(texts, training) if own == flag]):
            k, c = np.unique(key, return_counts=True)
            keys.append(k)
            counts.append(c if flag else np.zeros(len(k), np.int64))
    return merge(keys, counts)


def words_of(raw: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased, then the end token, which is the empty word."""
    found = raw.lower().split()
    found.append(b"")
    return found


def distinct_words(texts, training):
    counts = Counter()
    for raw, own in zip(texts, training):
        if own:
            counts.update(words_of(raw))
    for raw, own in zip(texts, training):
        if not own:
            for w in set(words_of(raw)):
                counts.setdefault(w, 0)
    words = list(counts)
    end = np.cumsum([len(w) for w in words], dtype=np.int64)
    start = end - np.array([len(w) for w in words], np.int64)
    keys = T.Prefix(T.CODES[0][np.frombuffer(b"".join(words), np.uint8)]).spans(start, end)
    order = np.lexsort((np.array(words, object), keys)) if len(np.unique(keys)) < len(keys) else np.argsort(keys)
    return [words[i] for i in order], keys[order], np.fromiter((counts[words[i]] for i in order), np.int64, len(order))


def remainder(doc_id, modulus: int) -> int:
    """crc32 of the id as text; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % modulus


def gram_buckets(keys, buckets: int):
    return (T.mix(keys >> U(24)) % U(buckets)).astype(np.int64)


def grams_of_bucket(came):
    keys, counts = [], []
    for _, data in came:
        step, n = B.unpack_arrays(data)
        keys.append(np.cumsum(step, dtype=U))
        counts.append(n.astype(np.int64))
    return keys, merge(keys, counts)


def score(docs: DataFrame, modulus: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every text with models learnt from the rows whose crc32(id) mod ``modulus`` is not ``held``.

    Result, one row for each input row: doc_id, held_out, n_tokens, n_known (tokens seen in training), train_tokens, base_score
    (add-one unigram model over lower-cased words and an end token, log10), score (log10 probability of the bytes and the end
    under context-tree weighting), n_bytes, bits_per_byte (code length per byte, end included). Null texts count as empty: one
    token, the end. A null id trains (its crc32 is that of an empty text). An empty table gives an empty result.
    """
    packed = B.blocks(docs, id_col, text_col)
    buckets = B.buckets_for(packed, docs)

    def parts(rows):
        texts = [t or b"" for _, t, _ in rows]
        return texts, [remainder(i, modulus) != held for i, *_ in rows]

    def pieces(rows):
        texts, training = parts(rows)
        words, keys, counts = distinct_words(texts, training)
        for bucket, lo, hi in B.slices(keys, buckets):
            yield bucket, B.pack_arrays(np.array([len(w) for w in words[lo:hi]], np.int32),
                                        np.frombuffer(b"".join(words[lo:hi]), np.uint8), counts[lo:hi].astype(np.int32))
        keys, counts = distinct_grams(texts, training)
        where = gram_buckets(keys, buckets)
        for bucket in np.unique(where).tolist():
            own = keys[where == bucket]
            yield buckets + bucket, B.pack_arrays(np.diff(own, prepend=U(0)), counts[where == bucket].astype(np.int32))

    asked = B.keep(B.ask(packed, pieces), "lm-pieces")

    def bucket_tops(table):
        _, (keys, counts) = grams_of_bucket(list(zip(table.column("block").to_pylist(), table.column("data").to_pylist())))
        near, node, n0, n1, below = tops(keys, counts)
        return pa.table({"near": near, "node": node, "n0": n0.astype(np.int64), "n1": n1.astype(np.int64), "below": below})

    upper = (asked.filter(F.col("bucket") >= buckets).groupBy("bucket")
             .applyInArrow(bucket_tops, "near long, node long, n0 long, n1 long, below double")
             .groupBy("near", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("below").alias("below")))
    rows = upper.toPandas()  # at most 256 * 255 rows
    top = crown(*(rows[c].to_numpy() for c in ("near", "node", "n0", "n1", "below")))
    shared = docs.sparkSession.sparkContext.broadcast(top)

    def reply(key, table):
        bucket = key[0].as_py()
        came = sorted(zip(table.column("block").to_pylist(), table.column("data").to_pylist()))
        out, tokens, kinds = [], 0, 0
        if bucket < buckets:
            asked_ = []
            total = Counter()
            for block, data in came:
                lengths, blob, counts = B.unpack_arrays(data)
                words = B.split(lengths, blob)
                asked_.append((block, words))
                for w, c in zip(words, counts.tolist()):
                    total[w] += c
            tokens, kinds = sum(total.values()), sum(c > 0 for c in total.values())
            out = [(block, B.pack_arrays(np.array([total[w] for w in words], np.int64))) for block, words in asked_]
        else:
            own, (keys, counts) = grams_of_bucket(came)
            found = log_probabilities(keys, counts, shared.value).astype(np.float32)
            out = [(block, B.pack_arrays(found[np.searchsorted(keys, k)])) for (block, _), k in zip(came, own)]
        n = len(out)
        return pa.table({"block": pa.array([b for b, _ in out], pa.int64()), "bucket": pa.array([bucket] * n, pa.int64()),
                         "reply": pa.array([d for _, d in out], pa.binary()),
                         "tokens": pa.array([tokens] + [0] * (n - 1), pa.int64()), "kinds": pa.array([kinds] + [0] * (n - 1), pa.int64())})

    replies = B.keep(asked.groupBy("bucket").applyInArrow(reply, B.REPLIES + ", tokens long, kinds long"), "lm-replies")
    total, kinds = replies.agg(F.sum("tokens"), F.sum("kinds")).first()
    total, kinds = total or 0, kinds or 0

    def result(_, rows, got):
        texts, training = parts(rows)
        words, keys, _ = distinct_words(texts, training)
        table, log = {}, {}
        for bucket, lo, hi in B.slices(keys, buckets):
            count = B.unpack_arrays(got[bucket])[0]
            table.update(zip(words[lo:hi], count.tolist()))
            log.update(zip(words[lo:hi], np.log10((count + 1) / (total + kinds + 1)).tolist()))
        keys, _ = distinct_grams(texts, training)
        where = gram_buckets(keys, buckets)
        value = np.zeros(len(keys))
        for bucket in np.unique(where).tolist():
            value[where == bucket] = B.unpack_arrays(got[buckets + bucket])[0]
        scores = []
        for key, bounds in gram_slabs(texts):
            distinct, inverse = np.unique(key, return_inverse=True)
            scores.append(np.add.reduceat(value[np.searchsorted(keys, distinct)][inverse], bounds))
        scores = np.concatenate(scores)
        unknown = {w for w, c in table.items() if not c}
        tokens, known, base = [], [], []
        for raw, own in zip(texts, training):
            words = words_of(raw)
            tokens.append(len(words))
            known.append(len(words) - (sum(map(unknown.__contains__, words)) if unknown and not own else 0))
            base.append(math.fsum(map(log.__getitem__, words)))
        lengths = np.array([len(t) for t in texts])
        return {"doc_id": pa.array([i for i, *_ in rows], pa.int64()), "held_out": pa.array([not x for x in training]),
                "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array([total] * len(rows), pa.int64()), "base_score": pa.array(base, pa.float64()),
                "score": pa.array(scores, pa.float64()), "n_bytes": pa.array(lengths, pa.int64()),
                "bits_per_byte": pa.array(-scores / math.log10(2) / (lengths + 1), pa.float64())}

    return B.finish(packed, replies.select("block", "bucket", "reply"), result, SCHEMA)

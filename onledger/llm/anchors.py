"""Removal of repeated word windows, found through difference-cover anchors.

Of every PERIOD consecutive word positions of a document only those in COVER are anchors, where the window of ``width - PERIOD
+ 1`` words that starts there is hashed. COVER is a difference cover: for any two positions some shift below PERIOD takes both
into it. So two equal windows of ``width`` words, wherever they start, hold equal anchors at equal offsets. Anchors that occur
twice are extended to the windows of full width around them, whose 128-bit hashes decide which occurrence is first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from onledger.llm import blocks as B
from onledger.llm import text as T

PERIOD = 13
COVER = (0, 1, 3, 9)
U = np.uint64
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Words:
    """The words of a block's documents in one row: codes, document and position of each."""

    def __init__(self, rows):
        texts = [r[1] or b"" for r in rows]
        self.buffer = np.frombuffer(b" ".join(texts), np.uint8)
        edge = np.cumsum([len(t) + 1 for t in texts])
        self.spans = T.word_spans(self.buffer)
        self.doc = np.searchsorted(edge, self.spans[0], "right").astype(np.int32)
        self.begin = np.searchsorted(self.doc, np.arange(len(texts) + 1))
        self.codes = T.word_codes(self.buffer, 0, self.spans)

    def inside(self, width: int):
        """Starts of windows that end within their document, as marks over all windows of the row."""
        n = len(self.doc) - width + 1
        return self.doc[:n] == self.doc[width - 1:] if n > 0 else np.zeros(0, bool)

    def hashes(self, width: int, starts, which: int = 0):
        """Hashes of the windows at the starts, a slab at a time."""
        codes = self.codes if not which else T.word_codes(self.buffer, which, self.spans)
        out = np.empty(len(starts), U)
        for lo in range(0, len(starts), T.SLAB):
            own = starts[lo:lo + T.SLAB]
            first = own[0]
            out[lo:lo + T.SLAB] = T.sound_windows(codes[first:own[-1] + width], width, which)[own - first]
        return out


def anchors(words: Words, width: int):
    """Anchor starts of a block and their hashes."""
    length = width - PERIOD + 1
    inside = words.inside(length)
    position = (np.arange(len(words.doc)) - words.begin[words.doc])[:len(inside)] % PERIOD
    starts = np.flatnonzero(inside & np.isin(position, COVER))
    return starts, words.hashes(length, starts)


def candidates(words: Words, width: int, starts, hit):
    """Starts of the windows of full width that hold a repeated anchor."""
    n = len(words.inside(width))
    reach = np.maximum(starts[hit] - PERIOD + 1, 0)
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, np.minimum(reach, n), 1)
    np.add.at(step, np.minimum(starts[hit] + 1, n), -1)
    return np.flatnonzero((np.cumsum(step[:-1]) > 0) & words.inside(width)) if n else np.zeros(0, np.int64)


def grouped(first, second):
    """Order that brings equal pairs together (stable), and the marks of where each group begins."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    return order, np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[:len(a)]


def dedup(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", carry: list | None = None) -> DataFrame:
    """Remove every word covered by a window of ``width`` words that also starts earlier (smaller id, or earlier in the document).

    Result, one row for each input row: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), and if
    ``carry`` is a list: text (the input where nothing was removed, else the kept words; null stays null) and those columns.
    Null texts have no words. Null ids come before all others. Rows with equal ids are ordered by an arbitrary but fixed rule,
    so of repeated rows one keeps its words. Texts with fewer words than a window keep everything.
    """
    if width <= PERIOD:
        raise ValueError(f"windows need more than {PERIOD} words")
    packed = B.blocks(docs, id_col, text_col, carry)
    buckets = B.buckets_for(packed, docs)

    def first_keys(words):
        starts, keys = anchors(words, width)
        distinct, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        return starts, inverse, distinct, counts

    def ask_anchors(rows):
        _, _, keys, counts = first_keys(Words(rows))
        short = keys >> U(16)
        for bucket, lo, hi in B.slices(keys, buckets):
            yield bucket, B.pack_arrays(np.diff(short[lo:hi], prepend=U(0)), counts[lo:hi] > 1)

    def repeated(_, came):
        own = [(block, *B.unpack_arrays(data)) for block, data in came]
        own = [(block, np.cumsum(step, dtype=U), twice.astype(bool)) for block, step, twice in own]
        keys, counts = np.unique(np.concatenate([k for _, k, _ in own]), return_counts=True)
        for block, k, twice in own:
            yield block, B.marks(twice | (counts[np.searchsorted(keys, k)] > 1))

    def windows(rows, got):
        """The block's words and its candidate windows, in the order of their hashes."""
        words = Words(rows)
        starts, inverse, keys, _ = first_keys(words)
        hit = np.zeros(len(keys), bool)
        for bucket, lo, hi in B.slices(keys, buckets):
            hit[lo:hi] = B.unmarks(got[bucket], hi - lo)
        where = candidates(words, width, starts, hit[inverse])
        one, two = words.hashes(width, where), words.hashes(width, where, 1)
        order, begins = grouped(one, two)
        return words, where[order], one[order], two[order], begins

    def ask_windows(block, rows, got):
        words, where, one, two, begins = windows(rows, got)
        at = np.flatnonzero(begins)
        ids = np.array([-(1 << 63) if r[0] is None else r[0] for r in rows], np.int64)
        keys, second, first_doc = one[at], two[at], ids[words.doc[where[at]]]
        made = [(bucket, B.pack_arrays(np.diff(keys[lo:hi], prepend=U(0)), second[lo:hi], first_doc[lo:hi]))
                for bucket, lo, hi in B.slices(keys, buckets)]
        return {"bucket": pa.array([b for b, _ in made], pa.int64()), "block": pa.array([block] * len(made), pa.int64()),
                "data": pa.array([d for _, d in made], pa.binary())}

    def later(_, came):
        own = [(block, *B.unpack_arrays(data)) for block, data in came]
        size = [len(k) for _, k, _, _ in own]
        key = np.concatenate([np.cumsum(k, dtype=U) for _, k, _, _ in own])
        two, doc = (np.concatenate([x[i] for x in own]) for i in (2, 3))
        block = np.repeat(np.array([b for b, *_ in own]), size)
        order = np.lexsort((block, doc, two, key))
        a, b = key[order], two[order]
        begins = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        not_first = np.empty(len(order), bool)
        not_first[order] = ~begins
        for (number, *_), lo, n in zip(own, np.cumsum(size) - size, size):
            yield number, B.marks(not_first[lo:lo + n])

    def result(_, rows, got):
        words, where, one, _, begins = windows(rows, got)
        at = np.flatnonzero(begins)
        other = np.zeros(len(at), bool)
        for bucket, lo, hi in B.slices(one[at], buckets):
            other[lo:hi] = B.unmarks(got[buckets + bucket], hi - lo)
        removed = T.cover(where[other[np.cumsum(begins) - 1] | ~begins] if len(at) else where, width, len(words.doc))
        out = {"doc_id": [r[0] for r in rows], "n_words": np.diff(words.begin),
               "n_removed": np.diff(np.concatenate(([0], np.cumsum(removed)))[words.begin]), "kept_sha256": [], "text": [], "carry": []}
        for i, (_, raw, more) in enumerate(rows):
            found = (raw or b"").split()
            if out["n_removed"][i]:
                gone = removed[words.begin[i]:words.begin[i + 1]].tolist()
                raw = b" ".join(w for w, g in zip(found, gone) if not g)
                out["kept_sha256"].append(hashlib.sha256(raw).hexdigest())
            else:
                out["kept_sha256"].append(hashlib.sha256(b" ".join(found)).hexdigest())
            if carry is not None:
                out["text"].append(raw if raw is None else raw.decode("utf-8", "replace"))
                out["carry"].append(more if more is None else more.decode())
        kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}
        kinds |= {"text": pa.string(), "carry": pa.string()} if carry is not None else {}
        return {k: pa.array(out[k], kind) for k, kind in kinds.items()}

    one = B.answer(B.ask(packed, ask_anchors), repeated)
    two = B.answer(B.finish(packed, one, ask_windows, B.PIECES), later)
    both = one.unionByName(two.withColumn("bucket", two["bucket"] + buckets))
    found = B.finish(packed, both, result, SCHEMA if carry is None else SCHEMA + ", text string, carry string")
    return found if not carry else B.carried(found, docs, carry)

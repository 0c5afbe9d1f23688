"""Removal of repeated byte strings of a minimum length, by a Burrows-Wheeler transform over what may repeat.

A transform of the whole corpus in one piece would neither fit a task nor survive a lost executor, so windows of ``length``
bytes are first dealt by content. Every window belongs to the anchor it selects: the k-byte string inside it with the smallest
hash (equal windows select equal anchors). Neighbouring windows with one anchor form a run, and equal windows only occur in
runs of equal anchors, so

1. anchors are counted; runs whose anchor occurs nowhere else are settled, that is nearly everything;
2. the texts of the other runs meet by anchor. Equal ones are folded, and a transform over the different ones of some
   megabyte of groups finds the windows that repeat (see ``bwt``);
3. a group above ``GROUP`` runs (a passage that very many documents share) would not stay bounded. Its windows select again,
   among strings nearly as long as a window, which drops what is around the passage, and the windows left are counted by
   128-bit hashes, one row for each different window of a block. Two different windows are taken for equal there with a
   probability of 2**-128 a pair; everything else compares the bytes themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from onledger.llm import blocks as B
from onledger.llm import text as T
from onledger.llm.bwt import repeated_starts

U = np.uint64
GROUP = 1000
BATCH = 1 << 20
FINE = 16
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def least(values, width: int):
    """Minimum of every ``width`` consecutive values."""
    n = len(values)
    if n < width:
        return values[:0]
    pad = np.full(-n % width, np.iinfo(np.uint64).max, U)
    rows = np.concatenate((values, pad)).reshape(-1, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()[width - 1:n]
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()[:n - width + 1]
    return np.minimum(forward, backward)


class Slab:
    """About a megabyte of documents, or of parts of one that overlap by a window less a byte."""

    def __init__(self, parts, length):
        self.length = length
        self.document = np.array([d for d, _, _ in parts])
        self.offset = np.array([o for _, o, _ in parts])
        sizes = np.array([len(t) for _, _, t in parts])
        self.begin = np.cumsum(sizes) - sizes
        self.buffer = np.frombuffer(b"".join(t for _, _, t in parts), np.uint8)
        part = np.repeat(np.arange(len(parts)), sizes)
        self.starts = np.flatnonzero(part[:len(part) - length + 1] == part[length - 1:]) if len(part) >= length else np.zeros(0, np.int64)
        self.part = part[self.starts]
        self.prefix = T.Prefix(T.CODES[0][self.buffer])

    def anchors(self, k):
        """The hash of the anchor of every window, and its place."""
        if not len(self.starts):
            return np.zeros(0, U), self.starts
        keys = self.prefix.windows(k)
        low = U((1 << 22) - 1)
        best = least((keys & ~low) | np.arange(len(keys), dtype=U), self.length - k + 1)[self.starts]
        place = (best & low).astype(np.int64)
        return T.mix(keys[place]), place  # smallest hashes are all small; mixed anew they spread over the buckets

    def position(self, i):
        """Document and start there of the i-th window."""
        return self.document[self.part[i]], self.starts[i] - self.begin[self.part[i]] + self.offset[self.part[i]]


def slabs(rows, length, size=T.SLAB):
    parts, total = [], 0
    for d, row in enumerate(rows):
        raw = row[1] or b""
        for at in range(0, len(raw) - length + 1, size):
            parts.append((d, at, raw[at:at + size + length - 1]))
            total += len(parts[-1][2])
            if total >= size:
                yield Slab(parts, length)
                parts, total = [], 0
    if parts:
        yield Slab(parts, length)


def edges(*columns):
    """First index of every stretch over which all columns stay the same."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    change = np.zeros(n - 1, bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return np.flatnonzero(np.concatenate(([True], change)))


def runs(rows, length, k):
    """(key, document, first start, windows) of all runs of a block."""
    out = []
    for slab in slabs(rows, length):
        key, place = slab.anchors(k)
        first = edges(place, slab.part)
        count = np.diff(np.concatenate((first, [len(place)])))
        out.append((key[first], *slab.position(first), count))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(3)))


def hot_windows(rows, length, doc, start, count):
    """Windows of the given runs: key of the finer selection, two hashes, document and start. Only their own texts are read."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], start[order] + count[order]
    follows = np.zeros(len(doc), bool)
    follows[1:] = (doc[1:] == doc[:-1]) & (start[1:] == end[:-1])
    first = np.flatnonzero(~follows)
    last = np.append(first[1:], len(doc)) - 1
    pieces = zip(doc[first].tolist(), start[first].tolist(), end[last].tolist()) if len(doc) else ()
    out, parts, total = [], [], 0

    def settle():
        slab = Slab(parts, length)
        fine, _ = slab.anchors(length - FINE)
        one, two = (T.sound_windows(T.CODES[i][slab.buffer], length, i)[slab.starts] for i in (0, 1))
        out.append((T.mix(fine), one, two, *slab.position(np.arange(len(slab.starts)))))

    for d, lo, hi in pieces:
        for at in range(lo, hi, T.SLAB):
            parts.append((d, at, rows[d][1][at:min(at + T.SLAB, hi) + length - 1]))
            total += len(parts[-1][2])
            if total >= T.SLAB:
                settle()
                parts, total = [], 0
    if parts:
        settle()
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (*(np.zeros(0, U) for _ in range(3)), *(np.zeros(0, np.int64) for _ in range(2)))


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text",
                   carry: list | None = None) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that starts anywhere else too, in any document.

    Result, one row for each input row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the
    remaining bytes), and if ``carry`` is a list: kept (binary; cuts may fall inside a character) and those columns. Null texts count as empty.
    Repeated rows are documents of their own, so their common strings go from all of them. Texts shorter than ``length`` stay.
    """
    if length < 2 * FINE:
        raise ValueError(f"length must be {2 * FINE} at least")
    k = max(8, length * 8 // 25)
    packed = B.blocks(docs, id_col, text_col, carry)
    buckets = B.buckets_for(packed, docs)

    def ask_anchors(rows):
        keys, counts = np.unique(runs(rows, length, k)[0], return_counts=True)
        for bucket, lo, hi in B.slices(keys, buckets):
            yield bucket, B.pack_arrays(np.diff(keys[lo:hi], prepend=U(0)), counts[lo:hi].astype(np.int32))

    def count_keys(bucket, came):
        """0: nowhere else, 1: repeated, 2: hot."""
        own = [(block, *B.unpack_arrays(data)) for block, data in came]
        own = [(block, np.cumsum(step, dtype=U), n) for block, step, n in own]
        keys, inverse = np.unique(np.concatenate([x for _, x, _ in own]), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([n for *_, n in own]))
        state = np.where(total > GROUP, 2, np.where(total > 1, 1, 0)).astype(np.uint8)
        for block, x, _ in own:
            yield block, B.pack_arrays(state[np.searchsorted(keys, x)])

    def known(got, keys, offset=0):
        """Answers to distinct sorted keys."""
        out = np.zeros(len(keys), np.uint8)
        for bucket, lo, hi in B.slices(keys, buckets):
            out[lo:hi] = B.unpack_arrays(got[offset + bucket])[0]
        return out

    def states(rows, got):
        """Keys of the runs that are not settled, their documents, starts and lengths, and the state of each."""
        key, doc, start, count = runs(rows, length, k)
        keys, inverse = np.unique(key, return_inverse=True)
        state = known(got, keys)[inverse]
        left = np.flatnonzero(state)
        return tuple(x[left] for x in (key, doc, start, count, state))

    def noted(block, got):
        """The same, as ``ask_texts`` has left them for the block."""
        return B.unpack_arrays(got[4 * buckets + block])

    def hot_of(doc, start, count, state):
        return tuple(x[state == 2] for x in (doc, start, count))

    def contexts(rows, key, doc, start, count, state):
        """The different texts of repeated runs, by key: {(key, text): run numbers}, in order."""
        found: dict = {}
        for i in np.flatnonzero(state == 1).tolist():
            s = int(start[i])
            found.setdefault((int(key[i]), rows[doc[i]][1][s:s + int(count[i]) + length - 1]), []).append(i)
        return dict(sorted(found.items()))

    def context_slices(found):
        keys = np.array([key for key, _ in found], U)
        return B.slices(keys, buckets), keys

    def ask_texts(block, rows, got):
        key, doc, start, count, state = states(rows, got)
        found = contexts(rows, key, doc, start, count, state)
        items, made = list(found.items()), [(4 * buckets + block, B.pack_arrays(key, doc, start, count, state))]
        pieces, keys = context_slices(found)
        for bucket, lo, hi in pieces:
            own = items[lo:hi]
            made.append((buckets + bucket, B.pack_arrays(
                np.diff(keys[lo:hi], prepend=U(0)), np.array([len(where) > 1 for _, where in own]),
                np.array([len(raw) for (_, raw), _ in own], np.int64), np.frombuffer(b"".join(raw for (_, raw), _ in own), np.uint8))))
        fine, counts = np.unique(hot_windows(rows, length, *hot_of(doc, start, count, state))[0], return_counts=True)
        for bucket, lo, hi in B.slices(fine, buckets):
            made.append((2 * buckets + bucket, B.pack_arrays(np.diff(fine[lo:hi], prepend=U(0)), counts[lo:hi].astype(np.int32))))
        return pieces_table(block, made)

    def pieces_table(block, made):
        return {"bucket": pa.array([b for b, _ in made], pa.int64()), "block": pa.array([block] * len(made), pa.int64()),
                "data": pa.array([d for _, d in made], pa.binary())}

    def match(bucket, came):
        if bucket >= 4 * buckets:
            yield from came  # a block's own note, back to it
            return
        if bucket >= 2 * buckets:
            yield from ((block, data) for block, data in count_keys(bucket, came))
            return
        groups: dict = {}
        asked = []
        for block, data in came:
            step, twice, lengths, blob = B.unpack_arrays(data)
            own = list(zip(np.cumsum(step, dtype=U).tolist(), B.split(lengths, blob)))
            asked.append((block, own))
            for (key, raw), more in zip(own, twice.tolist()):
                group = groups.setdefault(key, {})
                group[raw] = group.get(raw, 0) + 1 + bool(more)
        marks: dict = {}
        batch, size = [], 0

        def settle():
            for (key, raw), found in zip(batch, repeated_starts([raw for _, raw in batch], length)):
                marks[key, raw] = found[:len(raw) - length + 1]

        for key, group in groups.items():
            for raw, times in group.items():
                if times > 1:
                    marks[key, raw] = np.ones(len(raw) - length + 1, bool)
            if len(group) > 1:
                for raw, times in group.items():
                    batch.append((key, raw))
                    size += len(raw)
                if size >= BATCH:
                    sure = {x: marks[x] for x in batch if x in marks}
                    settle()
                    marks.update(sure)
                    batch, size = [], 0
        if batch:
            sure = {x: marks[x] for x in batch if x in marks}
            settle()
            marks.update(sure)
        for block, own in asked:
            bits = [marks[x] if x in marks else np.zeros(len(x[1]) - length + 1, bool) for x in own]
            yield block, B.marks(np.concatenate(bits))

    def chosen(rows, got, hot):
        """Windows of hot runs whose finer key repeats, by hash: first, second, document, start, and where groups begin."""
        fine, one, two, doc, start = hot_windows(rows, length, *hot)
        keys, inverse = np.unique(fine, return_inverse=True)
        own = np.flatnonzero(known(got, keys, 2 * buckets)[inverse] > 0)
        one, two, doc, start = one[own], two[own], doc[own], start[own]
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        first = edges(one, two)
        return one, two, doc[order], start[order], first

    def ask_windows(block, rows, got):
        _, *own = noted(block, got)
        one, two, _, _, first = chosen(rows, got, hot_of(*own))
        twice = np.diff(np.concatenate((first, [len(one)]))) > 1
        made = [(bucket, B.pack_arrays(np.diff(one[first][lo:hi], prepend=U(0)), two[first][lo:hi], twice[lo:hi]))
                for bucket, lo, hi in B.slices(one[first], buckets)]
        return pieces_table(block, made)

    def count_windows(_, came):
        own = [(block, *B.unpack_arrays(data)) for block, data in came]
        one = np.concatenate([np.cumsum(x[1], dtype=U) for x in own])
        two, twice = (np.concatenate([x[i] for x in own]) for i in (2, 3))
        order = np.lexsort((two, one))
        first = edges(one[order], two[order])
        size = np.diff(np.concatenate((first, [len(order)])))
        more = np.empty(len(order), bool)
        more[order] = np.repeat((size > 1) | np.maximum.reduceat(twice[order] > 0, first), size)
        at = 0
        for x in own:
            yield x[0], B.pack_arrays(more[at:at + len(x[1])].astype(np.uint8))
            at += len(x[1])

    def result(block, rows, got):
        key, doc, start, count, state = noted(block, got)
        found = contexts(rows, key, doc, start, count, state)
        items = list(found.items())
        hits = [[] for _ in rows]
        for bucket, lo, hi in context_slices(found)[0]:
            own = items[lo:hi]
            sizes = [len(raw) - length + 1 for (_, raw), _ in own]
            bits, at = B.unmarks(got[buckets + bucket], sum(sizes)), 0
            for ((_, raw), where), n in zip(own, sizes):
                on = np.flatnonzero(bits[at:at + n])
                at += n
                if len(on):
                    for i in where:
                        hits[doc[i]].append(on + start[i])
        one, _, hot_doc, hot_start, first = chosen(rows, got, hot_of(doc, start, count, state))
        size = np.diff(np.concatenate((first, [len(one)])))
        on = np.repeat(known_windows(got, one[first]), size)
        by = np.argsort(hot_doc[on], kind="stable")
        hot_doc, hot_start = hot_doc[on][by], hot_start[on][by]
        begin = edges(hot_doc)
        for d, own in zip(hot_doc[begin].tolist(), np.split(hot_start, begin[1:])):
            hits[d].append(own)
        out = {name: [] for name in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "carry")}
        for (_, raw, more), own in zip(rows, hits):
            text = np.frombuffer(raw or b"", np.uint8)
            if own:
                gone = T.cover(np.concatenate(own).astype(np.int64), length, len(text))
                kept = text[~gone].tobytes()
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
            else:
                kept, spans = raw or b"", 0
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(kept))
            out["n_spans"].append(spans)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if carry is not None:
                out["kept"].append(kept)
                out["carry"].append(more if more is None else more.decode())
        kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
        kinds |= {"kept": pa.binary(), "carry": pa.string()} if carry is not None else {}
        return {"doc_id": pa.array([r[0] for r in rows], pa.int64())} | {c: pa.array(out[c], kind) for c, kind in kinds.items()}

    def known_windows(got, keys):
        """Answers to window hashes, of which two windows may share the first."""
        return known(got, keys, 3 * buckets) > 0

    one = B.answer(B.ask(packed, ask_anchors), count_keys)
    two = B.answer(B.finish(packed, one, ask_texts, B.PIECES), match)
    both = one.unionByName(two)
    three = B.answer(B.finish(packed, both, ask_windows, B.PIECES), count_windows)
    found = B.finish(packed, both.unionByName(three.withColumn("bucket", three["bucket"] + 3 * buckets)), result,
                     SCHEMA if carry is None else SCHEMA + ", kept binary, carry string")
    return B.carried(found, docs, carry) if carry else found

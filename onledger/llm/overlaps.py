"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of the token pairs that overlap.

A batch's tokens lie one after another on a line of bytes. ``merge_asof``, keyed by document, gives every token start the
other side's covering token; both directions together are all overlaps, and offsets where both sides end cut the tokens into
groups. Counts are made in two steps: a block of documents reports each of its pairs once, with the number of its documents
that hold it; the sums over all blocks go back to the blocks that asked.

Texts are tokenized by chunks: a single space between two characters that are no white space always begins a new word on both
sides, so chunks are independent, common ones are encoded once per worker, and no token or group crosses a chunk.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from onledger.llm import blocks as B
from onledger.llm import pieces

MADE = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>, "
        "times array<int>, pairs array<long>, held array<long>")
SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
BREAK = re.compile(r"(?<=\S) (?=\S)")
BLOCK_BYTES = 6 << 20
SLAB = 60_000
READ = 6 << 20
KNOWN = 1_000_000
_LOADED: dict = {}


def byte_of() -> dict:
    """The byte for each character of a byte-level vocabulary: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def ragged(start, count):
    """Indices start, start + 1, ... of every run, one run after another."""
    total = int(count.sum())
    shift = np.repeat(start - (np.cumsum(count) - count), count)
    return np.arange(total) + shift


class Sides:
    """Both tokenizers, the bytes of their entries, and the tokens of the chunks met so far."""

    def __init__(self, left: str, right: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(left)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=right)
        table = byte_of()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(table[c] for c in entry) if all(c in table for c in entry) else entry.encode()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(pieces.MARK, " ").encode()
                        for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))]
        self.sizes = [np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes)]
        n, m = len(self.a_bytes), len(self.b_bytes)
        self.names = pa.array([f"{i}," for i in range(n)] + [f"{i}|" for i in range(n)] + [f"{i}," for i in range(m)] + [f"{i};" for i in range(m)])
        self.known = pa.array([], pa.string())
        self.odd: set = set()  # chunks that a side does not give back
        self.ids, self.count = ([[np.zeros(0, kind)] for _ in range(2)] for kind in (np.int32, np.int64))
        self.used = np.zeros(0, np.int64)
        self.ready = None

    def forget(self):
        """Keep the half of the chunks that was used most; the others come again when they are met."""
        self.settle()
        keep = np.sort(np.argsort(-self.used[:len(self.known)], kind="stable")[:KNOWN // 2])
        place = np.full(len(self.known), -1)
        place[keep] = np.arange(len(keep))
        self.known = self.known.take(pa.array(keep))
        self.odd = {int(place[i]) for i in self.odd} - {-1}
        for side in (0, 1):
            count = self.count[side][0][keep]
            self.ids[side] = [self.ids[side][0][ragged(self.ready[side][keep], count)]]
            self.count[side] = [count]
        self.used, self.ready = self.used[keep] // 2, None

    def settle(self):
        if self.ready is None:
            self.count, self.ids = ([[np.concatenate(x)] for x in y] for y in (self.count, self.ids))
            self.ready = [np.cumsum(c[0]) - c[0] for c in self.count]

    def encode(self, texts: list):
        """Ids of both sides for each text."""
        made = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [e.ids for e in made], self.b.encode(texts, num_threads=1)

    def agrees(self, text: str, a: list, b: list) -> bool:
        raw = b" " + text.encode()
        return b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw

    def numbers(self, texts: pa.Array):
        """Numbers of different chunks; new ones are encoded."""
        place = pc.index_in(texts, value_set=self.known)
        fresh = texts.filter(place.is_null())
        at = len(self.known)
        if len(fresh):
            self.encode_new(at, fresh.to_pylist())
            self.known = pa.concat_arrays([self.known, fresh])
        place = place.fill_null(-1).to_numpy().astype(np.int64)
        place[place < 0] = np.arange(at, len(self.known))
        return place

    def encode_new(self, at: int, fresh: list):
        found, raw = self.encode(fresh), [b" " + t.encode() for t in fresh]
        for side, names in enumerate((self.a_bytes, self.b_bytes)):
            count = np.array([len(x) for x in found[side]], np.int64)
            ids = np.fromiter(itertools.chain.from_iterable(found[side]), np.int32, int(count.sum()))
            if b"".join([names[i] for i in ids.tolist()]) != b"".join(raw) or (np.add.reduceat(self.sizes[side][ids], np.cumsum(count) - count) != [len(r) for r in raw]).any():
                self.odd.update(at + i for i, t in enumerate(fresh) if not self.agrees(t, found[0][i], found[1][i]))
            self.count[side].append(count)
            self.ids[side].append(ids)
        self.ready = None

    def tokens(self, side: int, chunks):
        """Ids of the chunks one after another, and how many each chunk has."""
        self.settle()
        count = self.count[side][0][chunks]
        return self.ids[side][0][ragged(self.ready[side][chunks], count)], count

    def use(self, chunks):
        count = np.bincount(chunks, minlength=len(self.known))
        count[:len(self.used)] += self.used
        self.used = count


def sides(left: str, right: bytes) -> Sides:
    key = hashlib.sha256(left.encode() + right).digest()
    if key not in _LOADED:
        _LOADED[key] = Sides(left, right)
    return _LOADED[key]


def align(a_len, a_doc, b_len, b_doc):
    """Overlapping (A, B) token numbers and each token's group, from byte lengths and documents of both token rows."""
    a_end, b_end = np.cumsum(a_len), np.cumsum(b_len)
    a = pd.DataFrame({"start": a_end - a_len, "doc": a_doc, "a": np.arange(len(a_len))})
    b = pd.DataFrame({"start": b_end - b_len, "doc": b_doc, "b": np.arange(len(b_len))})
    forth = pd.merge_asof(a, b, on="start", by="doc")["b"].to_numpy(np.int64)
    back = pd.merge_asof(b, a, on="start", by="doc")["a"].to_numpy(np.int64)
    later = np.flatnonzero(a["start"].to_numpy()[back] != b["start"].to_numpy())  # pairs with equal starts are found from both sides
    both = np.intersect1d(a_end, b_end, assume_unique=True)
    return (np.concatenate((np.arange(len(a)), back[later])), np.concatenate((forth, later)),
            np.searchsorted(both, a_end), np.searchsorted(both, b_end), both)


class Block:
    """The documents of one block: sums per document, running hashes, and the pairs each document links."""

    def __init__(self, s: Sides):
        self.s, self.ids, self.sha, self.sums, self.pairs, self.size = s, [], [], [], [], 0
        self.waiting: list = []  # (document, chunk numbers, last of its document)
        self.held = 0
        self.pending: list = []  # (document, text)
        self.unread = 0

    def add(self, doc_id, text: str | None):
        if text:
            self.pending.append((len(self.ids), text))
            self.unread += len(text)
        self.ids.append(doc_id)
        self.sha.append(None)
        self.size += 64 + len(text or "")
        if self.unread >= READ:
            self.read()

    def read(self):
        """Cut the pending texts into numbered chunks."""
        if not self.pending:
            return
        pending, self.pending, self.unread, s = self.pending, [], 0, self.s
        if len(s.known) > KNOWN:
            self.flush()
            s.forget()
        cut = pc.split_pattern(pa.array([t for _, t in pending]), " ")
        coded = cut.values.dictionary_encode()
        distinct, edge = coded.dictionary, cut.offsets.to_numpy()
        safe = pc.and_(pc.equal(pc.utf8_trim_whitespace(distinct), distinct), pc.not_equal(distinct, ""))  # else cut with care
        number = np.full(len(distinct), -1)
        number[safe.to_numpy(zero_copy_only=False)] = s.numbers(distinct.filter(safe))
        chunks = number[coded.indices.to_numpy()]
        odd = np.zeros(len(s.known) + 1, bool)
        odd[[-1, *s.odd]] = True
        odd = odd[chunks]
        for (doc, text), lo, hi in zip(pending, edge[:-1].tolist(), edge[1:].tolist()):
            own = chunks[lo:hi]
            if odd[lo:hi].any():
                own = self.careful(text)
            if own is not None:
                self.put(doc, own)

    def careful(self, text: str):
        """Chunks of a text with other white space, or that not both sides give back; None if they don't as a whole."""
        s, parts = self.s, BREAK.split(text)
        distinct = list(dict.fromkeys(parts))
        place = dict(zip(distinct, s.numbers(pa.array(distinct)).tolist()))
        if s.odd.isdisjoint(place.values()):
            return np.array([place[c] for c in parts], np.int64)
        (a,), (b,) = s.encode([text])
        return s.numbers(pa.array([text])) if s.agrees(text, a, b) else None  # only the whole text agrees

    def put(self, doc: int, numbers):
        self.sha[doc] = hashlib.sha256()
        for lo in range(0, len(numbers), SLAB):
            part = numbers[lo:lo + SLAB]
            self.waiting.append((doc, part, lo + SLAB >= len(numbers)))
            self.held += len(part)
            if self.held >= SLAB:
                self.flush()

    def flush(self):
        """Align what waits."""
        if not self.waiting:
            return
        s, waiting = self.s, self.waiting
        self.waiting, self.held = [], 0
        chunks = np.concatenate([w[1] for w in waiting])
        doc_of = np.repeat([w[0] for w in waiting], [len(w[1]) for w in waiting])
        s.use(chunks)
        (a, a_count), (b, b_count) = s.tokens(0, chunks), s.tokens(1, chunks)
        a_doc, b_doc = np.repeat(doc_of, a_count), np.repeat(doc_of, b_count)
        one, two, a_group, b_group, both = align(s.sizes[0][a], a_doc, s.sizes[1][b], b_doc)
        last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (a_group, b_group))
        order = np.empty(len(a) + len(b), np.int32)
        n_a, n_b = np.bincount(a_group, minlength=len(both)), np.bincount(b_group, minlength=len(both))
        order[np.arange(len(a)) + (np.cumsum(n_b) - n_b)[a_group]] = a + last_a * len(s.a_bytes)
        order[np.arange(len(b)) + np.cumsum(n_a)[b_group]] = 2 * len(s.a_bytes) + b + last_b * len(s.b_bytes)
        names = s.names.take(pa.array(order))
        at, text = np.frombuffer(names.buffers()[1], np.int32), memoryview(names.buffers()[2])
        first = waiting[0][0]
        count = [np.bincount(d - first, minlength=waiting[-1][0] - first + 1) for d in (a_doc, b_doc, a_doc[last_a], a_doc[one])]
        place = np.concatenate(([0], np.cumsum(count[0] + count[1])))
        for doc, _, ends in waiting:
            lo, hi = at[place[doc - first]], at[place[doc - first + 1]]
            self.sha[doc].update(text[lo:hi - 1 if ends else hi])
        self.sums.append((first, np.stack(count)))
        pair = a[one].astype(np.int64) << 32 | b[two]
        kinds, which = np.unique(pair, return_inverse=True)
        self.pairs.append(np.stack(self.tally((a_doc[one] * len(kinds) + which), kinds)))

    @staticmethod
    def tally(coded, kinds):
        """(document, pair, how often) of coded links."""
        found, times = np.unique(coded, return_counts=True)
        return found // len(kinds), kinds[found % len(kinds)], times

    def finish(self, block: int) -> pa.RecordBatch:
        self.read()
        self.flush()
        n = len(self.ids)
        sums = np.zeros((4, n), np.int64)
        for first, count in self.sums:
            sums[:, first:first + count.shape[1]] += count
        doc, pair, times = np.concatenate(self.pairs, 1) if self.pairs else np.zeros((3, 0), np.int64)
        kinds, which = np.unique(pair, return_inverse=True)
        found, again = np.unique(doc * max(len(kinds), 1) + which, return_inverse=True)  # a long document came in several parts
        times = np.bincount(again, times, len(found)).astype(np.int32)
        which, doc = found % max(len(kinds), 1), found // max(len(kinds), 1)
        edge = np.searchsorted(doc, np.arange(n + 1))
        none = pa.nulls(n, pa.list_(pa.int64()))
        rows = pa.RecordBatch.from_pydict({
            "block": pa.array([block] * n, pa.int64()), "doc_id": pa.array(self.ids, pa.int64()), "n_a": sums[0], "n_b": sums[1], "n_groups": sums[2],
            "n_links": sums[3], "groups_sha256": pa.array(["" if h is None else h.hexdigest() for h in self.sha]),
            "links": pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(which, pa.int32())),
            "times": pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(times, pa.int32())), "pairs": none, "held": none})
        held = np.bincount(which, minlength=len(kinds)).astype(np.int64)
        lists = {name: pa.array([x], rows.schema.field(name).type) for name, x in (("pairs", kinds), ("held", held))}
        key = pa.RecordBatch.from_pydict({f.name: lists.get(f.name, pa.array([block] if f.name == "block" else [None], f.type)) for f in rows.schema})
        return pa.Table.from_batches([rows, key]).combine_chunks().to_batches()[0]


def aligned(docs: DataFrame, left_path: str, right_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with their alignment, and for each block one row (``pairs`` not null) that lists its pairs and in how many of its documents each is linked."""
    with open(left_path, encoding="utf-8") as f:
        left = f.read()
    right = pieces.read_model(right_path)
    shared = docs.sparkSession.sparkContext.broadcast((left, right))  # two vocabulary files, of a size that the data do not change
    own = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches):
        s, number = sides(*shared.value), TaskContext.get().partitionId() << 32
        block = Block(s)
        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                block.add(doc_id, text.as_py())
                if block.size >= BLOCK_BYTES:
                    yield block.finish(number)
                    block, number = Block(s), number + 1
        if block.ids:
            yield block.finish(number)

    return own.mapInArrow(run, MADE)


def judged(made: DataFrame) -> DataFrame:
    """(asked_by, at, count, best): for every pair of a block its count in the whole corpus, and whether no pair of its A id has more."""
    asked = made.filter("pairs is not null").select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "p")).select(
        "block", "at", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held"))
    counts = asked.groupBy("pair").agg(F.sum("held").alias("count"))
    same = Window.partitionBy(F.shiftright("pair", 32))  # one A id: at most as many rows as the B vocabulary has entries
    counts = counts.withColumn("best", F.col("count") == F.max("count").over(same))
    return asked.join(counts, "pair").select(F.col("block").alias("asked_by"), "at", "count", "best")


def compare(docs: DataFrame, left_path: str, right_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Align a byte-level vocabulary A (over a space and the text) with a SentencePiece model B (over the text).

    Result, one row for each input row: doc_id, n_a and n_b tokens, n_groups (cut where both sides end), n_links (overlapping
    token pairs), n_best (links whose pair is held by the most documents of all pairs of that A id, ties included), count_sum
    (documents holding the link's pair, summed over links), groups_sha256 (of ``a1,a2|b1;...``). Null and empty texts, and texts
    that either side does not give back byte by byte, have no tokens: zeros and an empty groups_sha256. Every row counts as a
    document, repeated rows too. Other columns are ignored.
    """
    made = B.keep(aligned(docs, left_path, right_path, id_col, text_col), "aligned")

    def count(_, own, found):
        links, times = own.column("links").combine_chunks(), own.column("times").combine_chunks()
        at = found.column("at").to_numpy()
        total, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        total[at], best[at] = found.column("count").to_numpy(), found.column("best").to_numpy(zero_copy_only=False)
        edge = links.offsets.to_numpy()
        which, often = links.values.to_numpy(), times.values.to_numpy().astype(np.int64)

        def per_row(value):
            run = np.concatenate(([0], np.cumsum(value[which] * often)))
            return run[edge[1:]] - run[edge[:-1]]

        columns = {c: own.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table(columns | {"n_best": per_row(best), "count_sum": per_row(total), "groups_sha256": own.column("groups_sha256")})

    rows = made.filter("pairs is null").drop("pairs", "held")
    return rows.groupBy("block").cogroup(judged(made).groupBy("asked_by")).applyInArrow(count, SCHEMA)

"""Repeated strings of a collection of byte texts: breadth-first backward extension on a Burrows-Wheeler transform.

The suffixes are ordered by their first bytes (prefix doubling, as far as the threshold asks). An interval of that order holds
the suffixes that begin with one string w; stepping from each suffix to the one a byte before it maps the interval to the
intervals of all strings cw. Going from w to cw by increasing length, an interval whose right border has no value yet sets
that border's longest common prefix to the length of w and stays in the queue; all others are dropped, so each border is set
once. The walk stops at the minimum length: borders still without a value lie inside repeated strings of that length.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
FIRST = 8
STOP = 255  # no byte of UTF-8; stands after every text


def suffix_order(buffer, left, length: int):
    """Positions of all suffixes ordered by their first ``length`` bytes at least, ranks by position, and FIRST-byte groups.

    ``left`` is the number of bytes from each position to the end of its text. A suffix shorter than what is compared is
    unlike any other, and stands in the order of the texts.
    """
    n = len(buffer)
    padded = np.concatenate((buffer, np.full(FIRST, STOP, np.uint8)))
    key = np.zeros(n, U)
    for i in range(FIRST):
        own = np.where(left > i, padded[i:n + i], STOP).astype(U)
        key = (key << U(8)) | own
    order = np.argsort(key, kind="stable")
    sorted_key, short = key[order], (left < FIRST)[order]
    begins = np.concatenate(([True], (sorted_key[1:] != sorted_key[:-1]) | short[1:] | short[:-1]))
    first = begins.copy()
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    done = FIRST
    while done < length:
        alone = begins & np.concatenate((begins[1:], [True]))
        open_at = np.flatnonzero(~alone)
        if not len(open_at):
            break
        where = order[open_at]
        after = np.minimum(where + done, n - 1)
        next_rank = np.where(left[where] > done, rank[after] + 1, 0)
        short = left[where] <= done
        pair = (rank[where].astype(U) << U(32)) | next_rank.astype(U)
        again = np.argsort(pair, kind="stable")
        pair, short = pair[again], short[again]
        order[open_at] = where[again]
        begins[open_at] = np.concatenate(([True], (pair[1:] != pair[:-1]) | short[1:] | short[:-1]))
        rank[order] = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
        done *= 2
    return order, first


def repeated_starts(texts: list[bytes], length: int):
    """For each text, marks of the starts of ``length``-byte strings that start anywhere else in the collection as well."""
    sizes = np.array([len(t) for t in texts], np.int64)
    buffer = np.frombuffer(bytes([STOP]).join(texts) + bytes([STOP]), np.uint8)
    end = np.cumsum(sizes + 1) - 1
    n = len(buffer)
    left = np.repeat(end, sizes + 1) - np.arange(n)
    order, begins = suffix_order(buffer, left, length)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    byte = buffer[order]
    before = np.where(order > 0, buffer[order - 1], STOP)
    step = place[order - 1]  # where the suffix that begins a byte earlier stands
    known = np.concatenate((begins, [True]))  # borders whose common prefix is settled; border i stands before suffix i
    group = np.cumsum(begins) - 1
    # From FIRST to FIRST + 1: neighbours with the same byte whose remainders share a group belong together.
    after = group[place[np.minimum(order + 1, n - 1)]]
    whole = left[order] > FIRST
    split = np.concatenate(([True], (byte[1:] != byte[:-1]) | (after[1:] != after[:-1]) | ~whole[1:] | ~whole[:-1]))
    lo = np.flatnonzero(split)
    hi = np.concatenate((lo[1:], [n]))
    at = FIRST + 1
    new = whole[lo] & ~known[hi]
    lo, hi = lo[new], hi[new]
    known[hi] = True
    while at < length and len(lo):
        size = hi - lo
        owner = np.repeat(np.arange(len(lo)), size)
        member = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        good = before[member] != STOP
        owner, member = owner[good], member[good]
        if not len(member):
            break
        target = step[member]
        along = np.argsort(target)
        target, owner, symbol = target[along], owner[along], before[member][along]
        cut = np.concatenate(([True], (owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1])))[:len(target)]
        first = np.flatnonzero(cut)
        last = np.concatenate((first[1:], [len(target)])) - 1
        lo, hi = target[first], target[last] + 1
        new = ~known[hi]
        lo, hi = lo[new], hi[new]
        known[hi] = True
        at += 1
    enough = left[order] >= length
    inside = np.flatnonzero(~known[1:-1] & enough[1:] & enough[:-1]) + 1
    marks = np.zeros(n, bool)
    marks[order[inside]] = True
    marks[order[inside - 1]] = True
    return [marks[e - s:e] for s, e in zip(sizes.tolist(), end.tolist())]

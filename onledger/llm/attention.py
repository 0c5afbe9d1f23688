"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded by a small network over counts that its bytes and
words give; a gated attention layer weighs the passages of a bag, and the weighted representation is classified. All weights
are learnt from document labels alone. Fitting uses a bounded sample on the driver, scoring runs over whole texts in tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from onledger.llm import labelled
from onledger.llm import text as T

PASSAGE = 64
HASHED = 48
HIDDEN, GATE = 32, 16
U = np.uint64


def table(chars: bytes):
    out = np.zeros(256, np.int32)
    out[list(chars)] = 1
    return out


UPPER, LOWER, DIGIT = table(bytes(range(65, 91))), table(bytes(range(97, 123))), table(b"0123456789")
SYMBOL, STOP, MARK, WIDE = table(b"#*$%&|<>@^~=+_/\\{}[]"), table(b".,;:"), table(b"!?"), table(bytes(range(128, 256)))
CLASSES = (UPPER, LOWER, DIGIT, SYMBOL, STOP, MARK, WIDE, table(b"\n"))


def passages(texts: list[bytes]):
    """Features of all passages of the texts, and each text's first passage. A text without words is one empty passage."""
    buffer = np.frombuffer(b" ".join(texts), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    start, end = T.word_spans(buffer)
    doc = np.searchsorted(ends, start, "right")
    begin = np.searchsorted(doc, np.arange(len(texts) + 1))
    n_words = np.diff(begin)
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    first = np.cumsum(n_passages) - n_passages
    total = int(n_passages.sum())
    passage = first[doc] + (np.arange(len(start)) - begin[doc]) // PASSAGE
    m = np.bincount(passage, minlength=total)
    words = np.maximum(m, 1)
    out = np.zeros((total, len(CLASSES) + 11 + HASHED), np.float32)

    def add(column, weights):
        out[:, column] = np.bincount(passage, weights, total) / words

    length = (end - start).astype(np.float64)
    size = np.maximum(np.bincount(passage, length, total), 1)
    for i, own in enumerate(CLASSES):
        run = np.concatenate(([0], np.cumsum(own[buffer])))
        out[:, i] = np.bincount(passage, run[end] - run[start], total) / size
    newline = np.concatenate(([0], np.cumsum(buffer == 10)))
    c = len(CLASSES)
    codes = T.word_codes(buffer, 0, (start, end))
    if len(start):
        gap = np.concatenate((newline[start[1:]] - newline[end[:-1]], [0]))
        add(c - 1, np.minimum(gap, 1))
        add(c, length / 10)
        add(c + 1, length == 1)
        add(c + 2, UPPER[buffer[start]])
        add(c + 3, (STOP + MARK)[buffer[end - 1]])
        add(c + 4, np.concatenate(([False], (codes[1:] == codes[:-1]) & (passage[1:] == passage[:-1]))))
        order = np.lexsort((codes, passage))
        same = np.concatenate(([False], (codes[order][1:] == codes[order][:-1]) & (passage[order][1:] == passage[order][:-1])))
        out[:, c + 5] = np.bincount(passage[order], same, total) / words
        fours = T.Prefix(codes).windows(4)
        if len(fours):
            own = doc[:len(fours)]
            inside = np.flatnonzero(own == doc[3:])
            order = inside[np.lexsort((fours[inside], own[inside]))]
            same = np.concatenate(([False], (fours[order][1:] == fours[order][:-1]) & (own[order][1:] == own[order][:-1])))
            share = np.bincount(own[order], same[:len(order)], len(texts)) / np.maximum(n_words, 1)
            out[:, c + 6] = np.repeat(share, n_passages)
        bucket = (codes >> U(58)) % U(HASHED)
        sign = np.where(codes & U(1), 1.0, -1.0)
        hashed = np.bincount(passage * HASHED + bucket.astype(np.int64), sign, total * HASHED).reshape(total, HASHED)
        out[:, -HASHED:] = hashed / np.sqrt(words)[:, None]
    out[:, c + 7] = np.log1p(m) / 4
    out[:, c + 8] = np.repeat(np.log1p(n_words) / 8, n_passages)
    out[:, c + 9] = np.repeat(n_words == 0, n_passages)
    out[:, c + 10] = np.repeat(n_words < 20, n_passages)
    return out, first


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Encoder, gated attention and classifier; ``weights`` is a dict of arrays of fixed size."""

    def __init__(self, mean, scale, weights):
        self.mean, self.scale, self.w = mean, scale, weights

    def forward(self, x, first):
        w = self.w
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w["encode"] + w["encode0"])
        value, gate = np.tanh(h @ w["value"]), sigmoid(h @ w["gate"])
        e = (value * gate) @ w["attend"]
        bag = np.repeat(np.arange(len(first)), np.diff(np.concatenate((first, [len(x)]))))
        a = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return x, h, value, gate, bag, a, z, sigmoid(z @ w["out"] + w["out0"])

    def score(self, texts):
        """Scores of texts, and the passage that weighs most in each."""
        x, first = passages(texts)
        *_, bag, a, _, p = self.forward(x, first)
        order = np.lexsort((np.arange(len(a)), -a, bag))
        return p.astype(np.float64), {"top_passage": (order[first] - first).tolist(), "top_weight": a[order[first]].astype(float).tolist()}


def fit(texts, labels, steps: int = 200, rate: float = 0.01, decay: float = 1e-3, seed: int = 7) -> Model:
    """Fit by full-batch Adam on the log loss; without both labels present the model gives the smoothed share of ones."""
    rng = np.random.default_rng(seed)
    parts = [passages(texts[lo:hi]) for lo, hi in labelled.slabs(texts)] or [passages([b""])]
    x = np.concatenate([p[0] for p in parts])
    sizes = np.cumsum([0] + [len(p[0]) for p in parts])
    first = np.concatenate([p[1] + s for p, s in zip(parts, sizes)])
    y = np.array(labels, np.float32) if labels else np.zeros(1, np.float32)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    d = x.shape[1]
    w = {"encode": rng.normal(0, d ** -0.5, (d, HIDDEN)), "encode0": np.zeros(HIDDEN), "value": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)),
         "gate": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)), "attend": rng.normal(0, 0.1, GATE), "out": np.zeros(HIDDEN),
         "out0": np.array(np.log((sum(labels) + 1) / (len(labels) - sum(labels) + 1)))}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    model = Model(mean.astype(np.float32), scale.astype(np.float32), w)
    if len(set(labels)) < 2:
        return model
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        z_x, h, value, gate, bag, a, z, p = model.forward(x, first)
        dz = ((p - y) / len(y))
        g = {"out": z.T @ dz, "out0": np.asarray(dz.sum())}
        dbag = dz[:, None] * w["out"]
        dh = a[:, None] * dbag[bag]
        da = (dbag[bag] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, first)[bag])
        g["attend"] = (value * gate).T @ de
        both = de[:, None] * w["attend"]
        dv, dg = both * gate * (1 - value ** 2), both * value * gate * (1 - gate)
        g["value"], g["gate"] = h.T @ dv, h.T @ dg
        dh += dv @ w["value"].T + dg @ w["gate"].T
        dpre = dh * (1 - h ** 2)
        g["encode"], g["encode0"] = z_x.T @ dpre, dpre.sum(0)
        for k in w:
            grad = g[k] + (decay * w[k] if k not in ("out0", "encode0") else 0)
            m1[k] = 0.9 * m1[k] + 0.1 * grad
            m2[k] = 0.999 * m2[k] + 0.001 * grad ** 2
            w[k] = (w[k] - rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, held: int = 0, threshold: float = 0.3,
             max_rows: int = 3000, max_bytes: int = 32 << 20) -> DataFrame:
    """Score every text with a model fitted to at most ``max_rows`` labelled rows whose crc32(id) mod ``modulus`` is not ``held``.

    Result, one row for each input row: doc_id, held_out, score, predicted, top_passage and top_weight (the passage with the
    largest attention). Null texts count as empty; an empty text is one empty passage. Without labels the score is 0.5
    everywhere; repeated rows get equal scores; ids, language and source never enter a score.
    """
    texts, wanted = labelled.sample(docs, labels, label, modulus, held, max_rows, max_bytes)
    m = fit(texts, wanted)
    shared = docs.sparkSession.sparkContext.broadcast((m.mean, m.scale, m.w))
    return labelled.score(docs, lambda t: Model(*shared.value).score(t), modulus, held, threshold, "top_passage long, top_weight double")

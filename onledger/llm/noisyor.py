"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's probability is logistic in its hashed words and word beginnings (inflected forms share those); sentences combine by noisy-or, and the weights are learnt from
document labels alone. The fitted sentence model then names the sentence that offends most.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from onledger.llm import labelled
from onledger.llm import text as T

BUCKETS = 1 << 18
STEMS = (4, 5, 6)  # bytes of a word's beginning that count as features, besides the whole word
U = np.uint64
#: Bytes that belong to words, folded to lower case; everything else separates, and the second table ends a sentence.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
OUTSIDE = np.ones(256, bool)
OUTSIDE[48:58] = OUTSIDE[97:123] = OUTSIDE[128:] = False
BREAK = np.zeros(256, bool)
BREAK[list(b".!?\n\0")] = True


def sentences(texts: list[bytes]):
    """Features of every word (rows of buckets; BUCKETS where a word is too short), each sentence's first word, each text's
    first sentence, and the sentences' byte spans in their text.

    Every text has a sentence at least; sentences may be empty of words.
    """
    buffer = FOLD[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    stop = np.flatnonzero(BREAK[buffer])  # every sentence ends with one of these, every text with a zero byte
    start, end = T.word_spans(buffer, OUTSIDE)
    shift = U(64 - int(math.log2(BUCKETS)))
    features = np.full((len(start), 1 + len(STEMS)), BUCKETS, np.int32)
    features[:, 0] = T.word_codes(buffer, 0, (start, end)) >> shift
    for i, size in enumerate(STEMS):
        long = np.flatnonzero(end - start > size)
        features[long, i + 1] = T.mix(T.word_codes(buffer, 0, (start[long], start[long] + size)) + U(size)) >> shift
    sentence = np.searchsorted(stop, start)
    first_word = np.searchsorted(sentence, np.arange(len(stop)))
    first_sentence = np.searchsorted(stop, np.concatenate(([0], ends[:-1])))
    begin = np.concatenate(([0], stop[:-1] + 1))
    text = np.searchsorted(ends, stop, "right")
    offset = np.concatenate(([0], ends[:-1]))[text]
    return features, sentence, first_word, first_sentence, begin - offset, stop - offset


def sums(values, first):
    """Sums of stretches that may be empty."""
    run = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return np.diff(run[np.concatenate((first, [len(values)]))])


class Model:
    def __init__(self, weights, bias):
        self.weights, self.bias = weights, bias

    def score(self, texts):
        """Noisy-or of the sentences, and the byte span of the worst sentence with its own probability."""
        features, _, first_word, first_sentence, begin, end = sentences(texts)
        s = self.bias + sums(self.weights[features].sum(1), first_word)
        none = -np.logaddexp(0, s)  # log(1 - p)
        p = -np.expm1(sums(none, first_sentence))
        owner = np.repeat(np.arange(len(texts)), np.diff(np.concatenate((first_sentence, [len(s)]))))
        worst = np.lexsort((-s, owner))[first_sentence]
        return p, {"worst_from": begin[worst].tolist(), "worst_to": end[worst].tolist(), "worst_score": (1 / (1 + np.exp(-s[worst]))).tolist()}


def telling(texts, y, most: int):
    """The features that texts of the two labels hold most differently often, by the score of two shares; three texts at least."""
    ones, every = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for lo, hi in labelled.slabs(texts):
        feature, sentence, _, first_sentence, *_ = sentences(texts[lo:hi])
        owner = np.searchsorted(first_sentence, sentence, "right") - 1
        pairs = np.unique((owner[:, None] * (BUCKETS + 1) + feature).ravel())
        ones += np.bincount(pairs % (BUCKETS + 1), y[lo + pairs // (BUCKETS + 1)], BUCKETS + 1)
        every += np.bincount(pairs % (BUCKETS + 1), minlength=BUCKETS + 1)
    n1, n = y.sum(), len(y)
    share = every / n
    spread = np.sqrt(share * (1 - share) * (1 / n1 + 1 / (n - n1))) + 1e-9
    z = np.abs(ones / n1 - (every - ones) / (n - n1)) / spread
    z[every < 3] = 0
    z[BUCKETS] = 0
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(best[z[best] > 2])


def fit(texts, labels, steps: int = 600, rate: float = 0.05, decay: float = 1e-5, sparsity: float = 5e-5, most: int = 4096) -> Model:
    """Full-batch Adam on the log loss of the noisy-or over the ``most`` most telling features."""
    y = np.array(labels, np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS + 1, np.float32), math.log(share / (1 - share)) if labels else 0.0)
    chosen = telling(texts, y, most)
    local = np.full(BUCKETS + 1, -1)
    local[chosen] = np.arange(len(chosen))
    own, sentence, first_sentence, count = [], [], [], 0
    for lo, hi in labelled.slabs(texts):
        feature, where, first_word, first, *_ = sentences(texts[lo:hi])
        found = local[feature]
        use = found >= 0
        own.append(found[use])
        sentence.append(np.repeat(where + count, use.sum(1)))
        first_sentence.append(first + count)
        count += len(first_word)
    own, sentence, first_sentence = (np.concatenate(x) for x in (own, sentence, first_sentence))
    sizes = np.diff(np.concatenate((first_sentence, [count])))
    owner = np.repeat(np.arange(len(y)), sizes)
    first_word = np.searchsorted(sentence, np.arange(count))
    d = len(chosen)
    w, bias = np.zeros(d), math.log(share / np.mean(sizes) / (1 - share / np.mean(sizes)))
    m1, m2, b1, b2 = np.zeros(d), np.zeros(d), 0.0, 0.0
    for step in range(1, steps + 1):
        s = bias + sums(w[own], first_word)
        none = -np.logaddexp(0, s)
        clean = sums(none, first_sentence)
        p = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-12)
        # d loss / d log(1 - P): a clean text costs -log(1 - P), a toxic one -log(P)
        slope = np.where(y > 0, (1 - p) / p, -1.0) / len(y)
        grad_s = slope[owner] * -(1 / (1 + np.exp(-s)))
        g = np.bincount(own, grad_s[sentence], d) + decay * w + sparsity * np.sign(w)
        gb = grad_s.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.999 * b2 + 0.001 * gb * gb
        c1, c2 = 1 - 0.9 ** step, 1 - 0.999 ** step
        w -= rate * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-8)
        bias -= rate * (b1 / c1) / (math.sqrt(b2 / c2) + 1e-8)
    out = np.zeros(BUCKETS + 1, np.float32)
    out[chosen] = w
    return Model(out, bias)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, held: int = 1, threshold: float = 0.7,
             max_rows: int = 6000, max_bytes: int = 32 << 20) -> DataFrame:
    """Score every text with a model fitted to at most ``max_rows`` labelled rows whose crc32(id) mod ``modulus`` is not ``held``.

    Result, one row for each input row: doc_id, held_out, score, predicted, and where the worst sentence stands: worst_from and
    worst_to (bytes of the text), worst_score. Null texts count as empty, which is one empty sentence. Without labels all
    scores are 0.5. Ids, language and source never enter a score.
    """
    texts, wanted = labelled.sample(docs, labels, label, modulus, held, max_rows, max_bytes)
    m = fit(texts, wanted)
    shared = docs.sparkSession.sparkContext.broadcast((m.weights, m.bias))
    return labelled.score(docs, lambda t: Model(*shared.value).score(t), modulus, held, threshold, "worst_from long, worst_to long, worst_score double")

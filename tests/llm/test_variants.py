"""Spelling variants against a plain loop over all pairs of words."""

import collections
import random
import re
import zlib

import pytest

NAMES = ("word", "form", "root", "n", "n_near", "form_n")


def near(a, b):
    """One inserted, deleted or replaced character."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + 1:] == b[at + 1:] if len(a) == len(b) else a[at:] == b[at + 1:]


def plain(rows, every=97):
    count = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}
    form, held = {}, {}
    for w, n in words.items():
        found = [x for x in words if near(w, x)]
        held[w] = len(found)
        best = min(found, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 2 * n:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, held[w], words.get(form.get(w))))
    return out


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(8)
    base = ["receive", "separate", "banana", "bananas", "ananas", "élèves", "straße", "colour", "color", "colours", "aaaaa", "aaaaaa", "abababab", "ÀÉÎÕÜ"]
    rows = []
    for i in range(300):
        found = []
        for _ in range(rng.randint(0, 30)):
            w = rng.choice(base[:rng.randint(1, len(base))])
            if rng.random() < .4:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("aeé") + w[at:], w[:at] + rng.choice("aeé") + w[at + 1:], w.upper()])
            found.append(w)
        rows.append((i, rng.choice([" ", ", ", "1"]).join(found)))
    return rows + [(None, "receive recieve receive"), (5, None), (6, ""), (7, "receive"), (7, "receive"), (8, "x" * 5000)]


@pytest.mark.parametrize("every, frequent", [(97, 50_000), (3, 20), (0, 2)])
def test_variants_equal_brute_force(spark, spelled, monkeypatch, every, frequent):
    from onledger.llm import variants

    monkeypatch.setattr(variants, "FREQUENT", frequent)
    monkeypatch.setattr(variants, "HELD", 50)
    frame = spark.createDataFrame([(i, t, "w", 1) for i, t in spelled], "doc_id long, text string, word string, n int").repartition(3)
    assert {tuple(r[k] for k in NAMES) for r in variants.group(frame, every).collect()} == plain(spelled, every)


def test_every_near_pair_shares_a_posted_gram():
    from onledger.llm import variants

    rng = random.Random(2)
    for _ in range(3000):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(5, 9)))
        at = rng.randrange(len(w))
        x = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("abé") + w[at + 1:]])
        frequent = {g for g in ("^a", "ab", "aba", "bé", "éé", "a$", "aaa", "aa") if rng.random() < .6}
        if x == w or len(x) < 5:
            continue
        posted = []
        for v in (w, x):
            grams, bound = variants.decompose(v, frequent)
            posted.append(sorted((len(g), g, i) for i, g in enumerate(grams))[:bound + 1])
        step = len(x) - len(w)
        assert any(g == h and (j - i == 0 or j - i == step) for _, g, i in posted[0] for _, h, j in posted[1])


def test_no_words(spark, empty):
    from onledger.llm import variants

    assert variants.group(empty).count() == 0

"""Near-duplicates by colliding signatures against a plain loop over all pairs."""

import collections
import random

import pytest

from tests.llm.conftest import bag, words

NAMES = ("doc_id", "n_shingles", "component_id", "kept")


def plain(rows, width=2, share=(80, 100)):
    sets = []
    for _, text in rows:
        found = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(found[i:i + width]) for i in range(len(found) - width + 1)} if len(found) >= width else {tuple(found)} if found else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and share[1] * len(sets[i] & sets[j]) >= share[0] * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return collections.Counter((doc, len(sets[i]), least.get(find(i)), doc == least.get(find(i))) for i, (doc, _) in enumerate(rows))


def test_groups_equal_brute_force_on_awkward_rows(docs, texts, empty):
    from onledger.llm import collisions

    assert bag(collisions.groups(docs).collect(), *NAMES) == plain(texts)
    assert collisions.groups(empty).count() == 0


@pytest.fixture(scope="module")
def crowds():
    """Chains and clouds of near copies, whose pairs lie on both sides of the threshold, and texts that share one common pair of words."""
    rng = random.Random(6)
    rows, n = [], 0
    for cloud in range(4):
        base = [f"w{cloud}x{i}" for i in range(60)]
        current = list(base)
        for k in range(70):
            copy = list(current if cloud % 2 else base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(60)] = f"n{rng.randrange(500)}"
            if cloud % 2 and k % 5 == 0:
                current = copy
            rows.append((n, " ".join(copy)))
            n += 1
    for _ in range(120):
        rows.append((n, "of the " + " ".join(rng.choice(["of the", f"u{rng.randrange(400)}", "and"]) for _ in range(rng.randint(1, 6)))))
        n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("long, chunk", [(48, 2048), (3, 16), (1000, 2048)])
def test_groups_equal_brute_force_in_crowds(spark, crowds, monkeypatch, long, chunk):
    from onledger.llm import collisions

    monkeypatch.setattr(collisions, "CHUNK", chunk)
    frame = spark.createDataFrame(crowds, "doc_id long, text string").repartition(3)
    assert bag(collisions.groups(frame, long=long).collect(), *NAMES) == plain(crowds)


def test_bound_of_matches():
    from onledger.llm import collisions

    assert collisions.least_matches(0.8) == 33 and collisions.least_matches(0.9) > collisions.least_matches(0.5)


def test_posts_and_their_bound():
    from onledger.llm import collisions

    span, shared = collisions.posting(0.8)
    assert span == 2 and shared == 5
    missed = collisions.sure(0.8, 64, collisions.MISS)[1] + collisions.sure(0.8 ** 2, 32, collisions.MISS - collisions.sure(0.8, 64, collisions.MISS)[1])[1]
    assert missed <= collisions.MISS
    assert collisions.posting(0.5) == (1, collisions.least_matches(0.5))  # pairs of coordinates would miss too many


def test_near_misses_of_a_crowd_are_not_listed(spark, monkeypatch):
    """Eighty texts that are alike by their signatures, none of them by its set: no list of their pairs is written."""
    from onledger.llm import collisions

    rng = random.Random(8)
    rows = []
    for n in range(80):
        text = [f"w{i}" for i in range(100)]
        for i in rng.sample(range(100), 7):
            text[i] = f"n{rng.randrange(10 ** 6)}"
        rows.append((n, " ".join(text).upper()))
    written, keep = collections.Counter(), collisions.B.keep

    def kept(frame, label):
        out = keep(frame, label)
        written[label] = max(written[label], out.count())
        return out

    monkeypatch.setattr(collisions.B, "keep", kept)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert bag(collisions.groups(frame).collect(), *NAMES) == plain(rows)
    assert written["signed-undecided"] > 80 and written["signed-across"] <= 80

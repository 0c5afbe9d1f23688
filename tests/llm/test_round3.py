"""Hashes that fail together, the quality SQL's rule, and the template tree against a plain loop."""

import collections
import random
import re

import duckdb
import pytest

from tests.llm.conftest import bag, sha

#: Two texts of 1 024 letters whose polynomial hashes modulo 2**64 are equal for every odd base.
TWINS = ["".join("ab"[(bin(i).count("1") + flip) & 1] for i in range(1024)) for flip in (0, 1)]


def test_substring_dedup_keeps_twins(spark):
    from onledger.llm import anchors

    head = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{head} {TWINS[0]}"), (2, f"{head} {TWINS[1]}"), (3, f"{head} {TWINS[0]}")]
    got = {r.doc_id: r.n_removed for r in anchors.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


@pytest.mark.parametrize("group", [1000, 1])
def test_suffix_dedup_keeps_twins(spark, monkeypatch, group):
    from onledger.llm import suffixes

    monkeypatch.setattr(suffixes, "GROUP", group)
    rows = [(1, "x" + TWINS[0] + "p"), (2, "y" + TWINS[1] + "q"), (3, "z" + TWINS[1] + "r")]
    got = {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 1024).collect()}
    assert got == {1: (0, sha("x" + TWINS[0] + "p")), 2: (1024, sha("yq")), 3: (1024, sha("zr"))}


def test_near_duplicates_keep_twins(spark):
    from onledger.llm import chosen

    rows = [(1, TWINS[0]), (2, TWINS[1])]
    assert {r.class_id for r in chosen.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1, 2}


def test_quality_sql_has_the_same_rule(spark):
    from onledger.llm import checks, quality

    rng = random.Random(5)
    often = ["because", "information", "something", "therefore", "of"]
    rows = [(i, " ".join(rng.choice(often) for _ in range(100)), "en") for i in range(30)] + [(30, " ".join(f"rareword{k}" for k in range(100)), "en")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, kept FROM ({checks.quality_rules()})").fetchall()}
    assert got == want and not got[30] and got[0]


def tree_of(rows, urls):
    """The template tree by loops over (host, path, verdict or None)."""
    paths = collections.Counter()
    for h, p, _ in rows:
        paths[h, tuple(re.sub("[0-9]+", "{n}", p).split("/")[1:])] += 1
    node, leaf = {k: (k[0],) for k in paths}, {}
    level = 0
    while node:
        pages = collections.Counter()
        for k, n in node.items():
            pages[n] += paths[k]
        still = {}
        for k, n in node.items():
            if len(k[1]) <= level:
                leaf[k] = n
            elif pages[n] < urls.SUPPORT:
                leaf[k] = (*n, "**")
            else:
                still[k] = n
        child, parent = collections.Counter(), collections.Counter()
        for k, n in still.items():
            child[n, k[1][level]] += paths[k]
            parent[n] += paths[k]
        kind = {key: key[1] if c >= urls.SHARE * parent[key[0]] and c >= urls.SUPPORT else "*" for key, c in child.items()}
        cells = collections.defaultdict(lambda: collections.defaultdict(collections.Counter))
        for k, n in still.items():
            cells[n][kind[n, k[1][level]]][k[1][level + 1] if len(k[1]) > level + 1 else "/"] += paths[k]
        leader = {}
        for n, branches in cells.items():
            same = set()
            for a in branches:
                for b in branches:
                    if a < b:
                        p, q = branches[a], branches[b]
                        s, t = sum(p.values()), sum(q.values())
                        x = sum(((t / s) ** .5 * p[c] - (s / t) ** .5 * q[c]) ** 2 / (p[c] + q[c]) for c in {*p, *q})
                        df = len({*p, *q}) - 1
                        if x <= df + 3 * (2 * df) ** .5 + 1e-9:
                            same.add((a, b))
            leads = {a for a, _ in same} - {b for _, b in same}
            for b in branches:
                own = [a for a, c in same if c == b and a in leads]
                leader[n, b] = min(own) if own else b
        node = {k: (*n, leader[n, kind[n, k[1][level]]]) for k, n in still.items()}
        level += 1
    l, b = collections.Counter(), collections.Counter()
    for h, p, v in rows:
        n = leaf[h, tuple(re.sub("[0-9]+", "{n}", p).split("/")[1:])]
        l[n] += v is not None
        b[n] += v == "block"
    return {k: (b[n] + urls.SMOOTH * urls.PRIOR) / (l[n] + urls.SMOOTH) >= urls.PURITY for k, n in leaf.items()}


def test_url_tree_equals_brute_force(spark):
    from onledger.llm import urls

    rng = random.Random(7)
    rows = []
    for i in range(1500):
        host = rng.choice(["a.net", "b.net", "c.org", "d.com", "e.example.com"])
        parts = [rng.choice(["es", "fr", "de", "en"]), rng.choice(["shop", "blog", "blog", f"u{rng.randrange(40)}"])]
        if host == "c.org":
            parts = [rng.choice(["x", "y"])] * rng.randint(0, 6)
        for _ in range(rng.randint(0, 3)):
            parts.append(rng.choice([f"p{rng.randrange(9)}", "item", f"slug-{rng.randrange(200)}x"]))
        rows.append((i, f"https://{host}/{'/'.join(parts)}" + rng.choice(["", "/", "?q=1"])))
    rows += [(9000, None), (9001, "nothing"), (9002, "http://a.net"), (9003, "http://a.net/es/" + "deep/" * 9), (5, rows[5][1])]
    frame = spark.createDataFrame([(i, u, "h", 1, "t") for i, u in rows], "page_id long, url string, host string, n int, template string")
    out = urls.judge(frame).collect()
    assert len(out) == len(rows)
    ruled = [(r.host, r.path, r.verdict if r.rule else None) for r in out]
    reject = tree_of(ruled, urls)
    want = collections.Counter((r.page_id, r.verdict if r.rule else "block" if reject[r.host, tuple(re.sub("[0-9]+", "{n}", r.path).split("/")[1:])] else "allow") for r in out)
    assert bag(out, "page_id", "verdict") == want
    assert any(r.verdict == "block" and not r.rule for r in out) and any(r.verdict == "allow" and not r.rule for r in out)


def test_sample_bounds(spark):
    from onledger.llm import labelled

    rows = [(i, "t" * (10 + i % 3)) for i in range(200)] + [(7, "a repeated id"), (8, None), (None, "x"), (500, "y" * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 1), (4, None), (500, 1)], "doc_id long, good int")
    texts, wanted = labelled.sample(docs, labels, "good", 5, 0, 1000, 10**6)
    assert 140 < len(texts) < 201 and len(texts) == len(wanted)
    few, _ = labelled.sample(docs, labels, "good", 5, 0, 20, 10**6)
    assert len(few) == 20
    small, _ = labelled.sample(docs, labels, "good", 5, 0, 1000, 200)
    assert 10 <= len(small) and sum(map(len, small)) <= 200 and set(small) <= set(texts)


def test_hot_windows_hash_only_their_own_texts(monkeypatch):
    """Windows of hot runs are those found by hashing everything, but only the runs' texts are hashed."""
    import random

    import numpy as np

    from onledger.llm import suffixes

    rng, length, hashed, plain = random.Random(3), 400, [], suffixes.T.sound_windows
    rows = [(d, bytes(rng.choice(b"abcdef ") for _ in range(60_000)), None) for d in range(3)]
    monkeypatch.setattr(suffixes.T, "sound_windows", lambda codes, width, *more: hashed.append(len(codes) * (width == length)) or plain(codes, width, *more))
    doc, start, count = np.array([2, 0, 2, 2]), np.array([500, 59_500, 100, 40_000]), np.array([70, 101, 400, 1])
    fine, one, two, at, where = suffixes.hot_windows(rows, length, doc, start, count)
    assert sorted(zip(at.tolist(), where.tolist())) == sorted((d, s + i) for d, s, n in zip(doc.tolist(), start.tolist(), count.tolist()) for i in range(n))
    assert sum(hashed) <= 2 * (sum(count.tolist()) + 3 * (length - 1))  # neighbouring runs are one text
    every = {d: [plain(suffixes.T.CODES[i][np.frombuffer(rows[d][1], np.uint8)], length, i) for i in (0, 1)] for d in (0, 2)}
    assert all(a == every[d][0][s] and b == every[d][1][s] for a, b, d, s in zip(one, two, at.tolist(), where.tolist()))
    whole = {d: suffixes.Slab([(d, 0, rows[d][1])], length).anchors(length - suffixes.FINE)[0] for d in (0, 2)}
    assert all(f == suffixes.T.mix(whole[d][s:s + 1])[0] for f, d, s in zip(fine, at.tolist(), where.tolist()))

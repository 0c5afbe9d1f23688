"""Every operator against plain Python on awkward rows: nulls, empties, long texts, ties, repeated rows, clashing columns."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from tests.llm.conftest import bag, passage, sha, words


def test_sentencepiece_equals_the_library(docs, texts, empty, small_blocks):
    import sentencepiece
    from onledger.llm import pieces, queries

    path = queries.tokenizer_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = collections.Counter()
    for i, t in texts:
        ids = sp.encode(t or "")
        want[i, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))] += 1
    assert bag(pieces.encode_decode(docs, path).collect(), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    full = {r.doc_id: r for r in pieces.encode_decode(docs, path, full=True).collect()}
    assert full[18].ids == sp.encode(dict(texts)[18]) and full[18].decoded == sp.decode(full[18].ids)
    assert pieces.encode_decode(empty, path).count() == 0


def test_chunks_rebuild_any_text():
    from onledger.llm import pieces, queries

    sp = pieces.model(pieces.read_model(queries.tokenizer_path()))
    rng = random.Random(3)
    for _ in range(2000):
        text = "".join(rng.choice(["a", " ", "▁", "b", "é", "\n", "the", "  ", "漢"]) for _ in range(rng.randint(0, 12)))
        ids = [i for c in pieces.chunks(text) for i in (sp.encode(c) or [sp.piece_to_id("▁")])]
        assert ids == sp.encode(text), repr(text)


def test_repeated_starts_equal_brute_force():
    from onledger.llm.bwt import repeated_starts

    rng = random.Random(5)
    for _ in range(200):
        length = rng.choice([9, 10, 16, 33])
        base = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 120)))
        found = [b"".join(rng.choice([base[:rng.randint(0, len(base))], base[rng.randrange(len(base)):], b"a" * rng.randint(0, 40)])
                          for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 7))]
        count = collections.Counter(t[i:i + length] for t in found for i in range(len(t) - length + 1))
        want = [[i + length <= len(t) and count[t[i:i + length]] > 1 for i in range(len(t))] for t in found]
        assert [m.tolist() for m in repeated_starts(found, length)] == want


def bytes_left(texts, length):
    raw = [(t or "").encode() for _, t in texts]
    count = collections.Counter(t[i:i + length] for t in raw for i in range(len(t) - length + 1))
    out = collections.Counter()
    for (i, _), t in zip(texts, raw):
        gone = bytearray(len(t))
        for at in range(len(t) - length + 1):
            if count[t[at:at + length]] > 1:
                gone[at:at + length] = b"\1" * length
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        out[i, len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone) if not g))] += 1
    return out


@pytest.mark.parametrize("group", [1000, 2])
def test_suffix_dedup_equals_brute_force(docs, texts, empty, small_blocks, monkeypatch, group):
    from onledger.llm import suffixes

    monkeypatch.setattr(suffixes, "GROUP", group)
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    for length in (64, 400) if group == 1000 else (64,):
        assert bag(suffixes.remove_repeats(docs, length).collect(), *names) == bytes_left(texts, length)
    assert suffixes.remove_repeats(empty).count() == 0


def words_left(texts, width):
    seen, out = set(), collections.Counter()
    for i, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0)):
        found = words(t)
        gone = [False] * len(found)
        for at in range(len(found) - width + 1):
            window = tuple(found[at:at + width])
            if window in seen:
                gone[at:at + width] = [True] * width
            seen.add(window)
        out[i, len(found), sum(gone), sha(" ".join(w for w, g in zip(found, gone) if not g))] += 1
    return out


def test_substring_dedup_equals_brute_force(docs, texts, empty, small_blocks):
    from onledger.llm import anchors

    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    assert bag(anchors.dedup(docs).collect(), *names) == words_left(texts, 20)
    assert anchors.dedup(empty).count() == 0
    carried = anchors.dedup(docs, 20, carry=["lang", "block", "node"])
    assert carried.count() == docs.count()
    assert {(r.doc_id, r.block, r.node) for r in carried.collect()} == {(r.doc_id, r.block, r.node) for r in docs.collect()}


@pytest.mark.parametrize("sent", [100_000, 1])
def test_winnowing_equals_brute_force(spark, docs, texts, empty, monkeypatch, sent):
    import re

    from onledger.llm import winnow

    monkeypatch.setattr(winnow, "SENT", sent)
    items = [(1, passage(5, 25)), (2, passage(70, 12)), (3, "ONE two"), (4, None), (5, ""), (6, "été"), (7, passage(5, 25)), (8, "line a line a line a other")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    find = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in s or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        found = find(t)
        for at in range(len(found) - min(10, len(found)) + 1 if found else 0):
            windows[tuple(found[at:at + min(10, len(found))])].add(str(i))
    want = collections.Counter()
    for i, t in texts:
        found = find(t)
        hit, held = [0] * len(found), set()
        for size in {len(w) for w in windows}:
            for at in range(len(found) - size + 1):
                if tuple(found[at:at + size]) in windows:
                    hit[at:at + size] = [1] * size
                    held |= windows[tuple(found[at:at + size])]
        want[i, len(found), sum(hit), len(held), sha(",".join(sorted(held))), sum(hit) > 0] += 1
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert bag(winnow.decontaminate(docs, bench).collect(), *names) == want
    assert winnow.decontaminate(empty, bench).count() == 0
    assert not any(r.contaminated for r in winnow.decontaminate(docs, bench.limit(0)).collect())


def test_url_rules_and_templates(spark):
    from onledger.llm import urls

    rows = [(1, "http://A.example.com/en/7"), (2, "https://www.example.com/en/1?x#y"), (3, "https://x.net/es/1"), (4, None), (5, "no scheme/es/"),
            (6, "http://only.host"), (7, "http://q.net?x=/es/"), (8, "x://y.NET/fr/"), (8, "x://y.NET/fr/"), (9, "http://Ünet/es/"), (None, "http://b.com/")]
    rows += [(100 + i, f"http://bad.net/{'es' if i % 2 else 'fr'}/{i}") for i in range(40)] + [(200 + i, f"http://bad.net/en/{i}") for i in range(20)]
    rows += [(300 + i, f"http://fine.org/en/{i}") for i in range(20)]
    found = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(found) == len(rows) - 1
    assert [(found[i].host, found[i].path, found[i].rule) for i in range(1, 10)] == [
        ("a.example.com", "/en/7", "example.com/en/"), ("www.example.com", "/en/1", "www.example.com/en/"), ("x.net", "/es/1", "net/es/"), ("", "", None),
        ("", "", None), ("only.host", "", None), ("q.net", "", None), ("y.net", "/fr/", "net/fr/"), ("Ünet", "/es/", None)]
    assert found[None].rule == "com/" and found[2].verdict == "allow"
    # Most labelled pages of this host are blocked and its branches look alike, so its other pages go; a host without labels stays.
    assert {found[i].verdict for i in range(200, 220)} == {"block"} and {found[i].verdict for i in range(300, 320)} == {"allow"}
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


@pytest.mark.parametrize(("bucket", "chunk"), [(64, 512), (2, 3), (2, 512)])
def test_near_duplicates_equal_brute_force(spark, docs, texts, empty, bucket, chunk):
    from onledger.llm import chosen

    rng = random.Random(9)
    more = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(150)]
        for c in range(5):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(150)] = f"x{rng.random()}"
            more.append((1000 + g * 10 + c, " ".join(own)))
    every = [r for r in texts if r[0] is not None] + more
    frame = spark.createDataFrame(every, "doc_id long, text string")
    sets = collections.defaultdict(list)
    for i, t in every:
        w = words(t)
        if w:
            sets[frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)])].append(i)
    keys = list(sets)
    parent, degree = list(range(len(keys))), collections.Counter()

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in range(len(keys)):
        for b in range(a):
            both = len(keys[a] & keys[b])
            if 5 * both >= 4 * (len(keys[a]) + len(keys[b]) - both):
                degree[a] += 1
                degree[b] += 1
                parent[root(a)] = root(b)
    smallest = collections.defaultdict(lambda: math.inf)
    for k in range(len(keys)):
        smallest[root(k)] = min(smallest[root(k)], *sets[keys[k]])
    want = collections.Counter((i, smallest[root(k)], min(sets[keys[k]]), degree[k]) for k in range(len(keys)) for i in sets[keys[k]])
    want.update((i, i, i, 0) for i, t in every if not words(t))
    assert sum(degree.values()) > 20
    assert bag(chosen.groups(frame, bucket=bucket, chunk=chunk).collect(), "doc_id", "class_id", "copy_of", "n_links") == want
    assert chosen.groups(docs).count() == docs.count()
    assert chosen.groups(empty).count() == 0


def test_quality_base_counts_and_verdict(spark, docs, texts, empty):
    from onledger.llm import quality

    rows = quality.judge(docs).collect()
    want = collections.Counter()
    for i, t in texts:
        w = words(t)
        count = collections.Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
        again = [0] * len(w)
        for k in range(len(w) - 7):
            if count[tuple(w[k:k + 8])] > 1:
                again[k:k + 8] = [1] * 8
        lines = [x for x in (t or "").split("\n") if words(x)]
        want[i, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), sum(again),
             len(w) < 20 or 100 * sum(again) > 30 * len(w)] += 1
    assert bag(rows, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert not any(r.kept and r.base_failed for r in rows)
    assert quality.judge(empty).count() == 0
    rng = random.Random(1)
    common = ["the", "of", "and", "to", "in", "is"] * 4 + ["walking", "houses", "yellow", "between", "river"]
    clean = [(i, " ".join(rng.choice(common) for _ in range(120)), "en") for i in range(60)]
    junk = [(100, " | ".join(f"Zx{rng.random()}" for _ in range(80)), "en"), (101, " ".join(w.upper() + "!!" for w in clean[0][1].split()), "en")]
    found = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).collect()}
    assert all(found[i] for i in range(60)) and not found[100] and not found[101]


@pytest.mark.parametrize("light_rows", [20_000, 0])
def test_quality_reference_of_every_language(spark, monkeypatch, light_rows):
    from onledger.llm import quality

    monkeypatch.setattr(quality, "LIGHT_ROWS", light_rows)
    rows = []
    for k in range(90):
        common = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{c}" for c in "abcdefgh"]
        for j in range(2 if k < 70 else 1):
            rows.append((len(rows), " ".join(common[(i * (j + 1)) % 8] for i in range(120)), f"l{k:02d}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in quality.judge(docs).collect()}
    alone = [i for i, _, lang in rows if lang >= "l70"]
    assert len(found) == len(rows)
    # The only document of a language is its own reference.
    assert all(abs(found[i].char_distance) < 1e-6 and abs(found[i].word_distance) < 1e-6 for i in alone)
    one = quality.judge(docs.filter("lang = 'l69'")).collect()
    assert all(math.isclose(r.word_distance, found[r.doc_id].word_distance, abs_tol=1e-9) for r in one)


def test_quality_common_words_of_any_length(spark):
    from onledger.llm import quality

    rng = random.Random(3)
    often = ["because", "zwischen", "などの言葉である", "information", "of"]
    rows = [(i, " ".join(rng.choice(often) for _ in range(100))) for i in range(30)] + [(30, " ".join(["otherwise"] * 3 + [f"rareword{k}" for k in range(97)]))]
    counts = {i: collections.Counter(t.split()) for i, t in rows}
    every = collections.Counter(w for _, t in rows for w in t.split())
    top = sorted(every, key=lambda w: (-every[w], w.encode()))[:quality.COMMON]

    def distance(p, q):
        kl = lambda a: sum(x * math.log2(x / ((x + y) / 2)) for x, y in a if x > 0)
        return math.sqrt(max(kl(zip(p, q)) / 2 + kl(zip(q, p)) / 2, 0))

    def bins(c):
        shares = [c[w] / sum(c.values()) for w in top]
        return [*shares, max(1 - sum(shares), 0)]

    found = {r.doc_id: r for r in quality.judge(spark.createDataFrame([(i, t, "xx") for i, t in rows], "doc_id long, text string, lang string")).collect()}
    for i, _ in rows:
        assert math.isclose(found[i].word_distance, distance(bins(counts[i]), bins(every)), abs_tol=1e-6)
    assert found[30].word_distance > quality.MAX_WORD_DISTANCE and not found[30].kept


def kt_tree_log10(training, text, depth=4):
    """Log probability of a text after sequential counts, by the recursive definition of the weighting."""
    from onledger.llm import ctw

    counts = collections.defaultdict(lambda: [0, 0])

    def steps(raw):
        padded = bytes([ctw.END]) * depth + raw + bytes([ctw.END])
        for i in range(depth, len(padded)):
            for bit in range(8):
                yield padded[i - depth:i], (1 << bit) | (padded[i] >> (8 - bit)), (padded[i] >> (7 - bit)) & 1

    children = collections.defaultdict(set)
    for raw in training:
        for context, node, bit in steps(raw):
            for d in range(depth + 1):
                key = (node, context[depth - d:])
                counts[key][bit] += 1
                if d < depth:
                    children[key].add((node, context[depth - d - 1:]))

    def estimate(n):
        return math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(n) + 1)

    memo = {}

    def weighted(key):
        if key not in memo:
            own = estimate(counts.get(key, [0, 0]))
            memo[key] = own if len(key[1]) == depth else np.logaddexp(own, sum(map(weighted, children.get(key, ())))) - math.log(2)
        return memo[key]

    total = 0.0
    for context, node, bit in steps(text):
        n = counts.get((node, context), [0, 0])
        p = (n[bit] + 0.5) / (sum(n) + 1)
        for d in range(depth - 1, -1, -1):
            key = (node, context[depth - d:])
            n = counts.get(key, [0, 0])
            share = math.exp(estimate(n) - math.log(2) - weighted(key))
            p = share * (n[bit] + 0.5) / (sum(n) + 1) + (1 - share) * p
        total += math.log10(p)
    return total


def test_context_tree_scores_equal_the_definition(spark, docs, texts, empty, small_blocks):
    from onledger.llm import ctw

    rows = ctw.score(docs).collect()
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    training = [(t or "").encode() for i, t in texts if not held(i)]
    count = collections.Counter(w for t in training for w in [*t.lower().split(), b""])
    n, v = sum(count.values()), len(count)
    want = collections.defaultdict(list)
    for i, t in texts:
        own = [*(t or "").encode().lower().split(), b""]
        want[i].append((held(i), len(own), sum(count[w] > 0 for w in own), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own),
                        kt_tree_log10(training, (t or "").encode()) if len(t or "") < 700 else None))
    assert len(rows) == len(texts)
    for r in rows:
        assert any((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4] and math.isclose(r.base_score, w[4], rel_tol=1e-9)
                   and (w[5] is None or math.isclose(r.score, w[5], rel_tol=1e-4)) for w in want[r.doc_id]), r
    assert ctw.score(empty).count() == 0


def test_context_tree_probabilities_sum_to_one():
    from onledger.llm import ctw

    training = [b"the cat sat on the mat", b"the hat"]
    assert math.isclose(sum(10 ** (kt_tree_log10(training, b"th" + bytes([c])) - kt_tree_log10(training, b"th" + b"e"))
                            for c in b"e"), 1.0)
    keys, counts = ctw.distinct_grams(training, [True, True])
    near, node, n0, n1, below = ctw.tops(keys, counts)
    every = np.array([(int(keys[0]) >> 8 << 8) | b for b in range(256)], np.uint64)
    both, times = ctw.merge([keys, every], [counts, np.zeros(256, np.int64)])
    p = 10 ** ctw.log_probabilities(both, times, ctw.crown(near, node, n0, n1, below))
    assert math.isclose(p[np.isin(both, every)].sum(), 1.0, rel_tol=1e-9)


def labelled(spark, rng, good, bad, n=300):
    rows = [(i, (bad if i % 4 == 0 else good)(rng)) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(n)], "doc_id long, quality int, toxic int")
    extra = [(9000, None), (9001, ""), (None, "some text"), (9002, "word " * 5000), (9002, "word " * 5000)]
    return spark.createDataFrame(rows + extra, "doc_id long, text string"), labels, n, len(extra)


def test_quality_classifier_on_held_out_rows(spark, empty):
    from onledger.llm import attention

    common = [f"word{i}" for i in range(200)]
    good = lambda r: " ".join(r.choice(common) for _ in range(r.randint(30, 300)))
    bad = lambda r: " ".join(r.choice(common).upper() + "%%" for _ in range(r.randint(30, 300)))
    docs, labels, n, extra = labelled(spark, random.Random(2), good, bad)
    rows = attention.classify(docs, labels).collect()
    assert len(rows) == n + extra and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < n and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id % 4 != 0) for r in held) >= 0.95 * len(held)
    assert {r.score for r in attention.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert attention.classify(empty, labels).count() == 0


def test_toxicity_on_held_out_rows_and_where_it_is(spark, empty):
    from onledger.llm import noisyor

    def good(r):
        return " ".join("".join(r.choice("abcde") for _ in range(4)) + ("." if r.random() < 0.1 else "") for _ in range(80))

    def bad(r):
        return good(r) + ". You " + r.choice(["zzrude", "zzfoul"]) + r.choice(["s", "ly", "er"]) + " thing. " + good(r)

    docs, labels, n, extra = labelled(spark, random.Random(4), good, bad)
    rows = noisyor.classify(docs, labels).collect()
    assert len(rows) == n + extra and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < n and r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    text = {r.doc_id: r.text for r in docs.collect()}
    hits = [r for r in held if r.predicted and r.doc_id % 4 == 0]
    assert sum("zz" in text[r.doc_id].encode()[r.worst_from:r.worst_to].decode() for r in hits) >= 0.95 * len(hits)
    assert noisyor.classify(empty, labels).count() == 0


def test_scores_do_not_depend_on_ids_or_columns(spark):
    from onledger.llm import attention

    model = attention.fit([b"good words here " * 5, b"BAD%% " * 20] * 4, [1, 0] * 4, steps=50)
    first, _ = model.score([b"good words here", b"", b"BAD%% BAD%%"])
    again, _ = model.score([b"BAD%% BAD%%"])
    assert math.isclose(first[2], again[0], rel_tol=1e-5) and first[0] > first[2]

"""Tokenizer alignment against a plain loop over whole texts."""

import collections
import random

import pytest

from tests.llm.conftest import bag, sha

NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def paths():
    from onledger.llm import queries

    return queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path()


def plain(rows, paths):
    import sentencepiece
    from onledger.llm.overlaps import byte_of
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    table = byte_of()
    found, held = [], collections.Counter()
    for i, text in rows:
        ids = spans = ([], [])
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            raw = ([bytes(table[c] for c in a.id_to_token(t)) for t in ids[0]],
                   [bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in ids[1]])
            if any(b"".join(r) != (" " + text).encode() for r in raw):
                ids = raw = ([], [])
            spans = []
            for r in raw:
                at, own = 0, []
                for t in r:
                    own.append((at, at + len(t)))
                    at += len(t)
                spans.append(own)
        links = [(x, y) for x, (p, q) in zip(ids[0], spans[0]) for y, (u, v) in zip(ids[1], spans[1]) if max(p, u) < min(q, v)]
        cuts = sorted({q for _, q in spans[0]} & {v for _, v in spans[1]})
        groups, last = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(x) for x, (p, q) in zip(i_, s_) if last <= p and q <= c) for i_, s_ in zip(ids, spans)))
            last = c
        held.update(set(links))
        found.append((i, len(ids[0]), len(ids[1]), len(cuts), links, sha(";".join(groups)) if ids[0] else ""))
    top = collections.defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return collections.Counter((i, n, m, g, len(k), sum(held[p] == top[p[0]] for p in k), sum(held[p] for p in k), h) for i, n, m, g, k, h in found)


def test_alignment_equals_brute_force(docs, texts, empty, paths, monkeypatch):
    from onledger.llm import overlaps

    want = plain(texts, paths)
    assert bag(overlaps.compare(docs, *paths).collect(), *NAMES) == want
    monkeypatch.setattr(overlaps, "SLAB", 7)  # texts in parts
    monkeypatch.setattr(overlaps, "KNOWN", 20)
    monkeypatch.setattr(overlaps, "BLOCK_BYTES", 3000)
    assert bag(overlaps.compare(docs, *paths).collect(), *NAMES) == want
    assert overlaps.compare(empty, *paths).count() == 0


def test_odd_characters_and_special_strings(spark, paths):
    from onledger.llm import overlaps

    rng = random.Random(4)
    parts = ["a", " ", "  ", "\n", "\t", "\x00", " ", " ", "\x85", "\x1c", "é", "漢字", "🙂", "don't", "<|endoftext|>", "<s>", "</s>", "<0x41>", "the", "42", "…", "▁"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for i in range(400)] + [(900, "<|endoftext|> <unk> <s>"), (901, "▁a"), (902, " ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert bag(overlaps.compare(frame, *paths).collect(), *NAMES) == plain(rows, paths)

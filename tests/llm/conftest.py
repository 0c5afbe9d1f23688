import collections
import hashlib
import re

import pytest

from onledger.llm import blocks

PROSE = [f"word{i % 37} and{i % 11} the{i} of{i * 7 % 53}" for i in range(120)]


def passage(start, words=40):
    return " ".join(f"{a}{i}" for i, a in enumerate((["alpha", "beta", "gamma", "delta", "été", "Öl"] * 40)[start:start + words], start))


@pytest.fixture(scope="session")
def texts():
    """Awkward documents: nulls, empties, white space, repeats, copies, near copies, shared passages, one very long word."""
    long = passage(0, 90)
    near = long.split()
    near[45] = "changed"
    return [
        (1, long), (2, long), (3, " ".join(near)), (4, "x " + passage(20, 60) + " y"), (5, None), (6, ""), (7, " \n\t "), (8, "one two"),
        (9, "one two"), (10, "a" * 3000), (11, "b " + "a" * 3000 + " c"), (12, "ab " * 700), (13, "\n".join(PROSE)), (14, "\n".join(PROSE[30:])),
        (15, "Line A\nLine A\n\nLine A\nother"), (None, passage(10, 70)), (None, "lonely text of a null id"), (16, "a  b   c ▁d ▁▁e "),
        (17, " lead and trail "), (18, "\x00\x01 control   nbsp ① ﬁ 漢字 🙂"), (19, "#tag $5 100% a|b <c> & *"), (20, long.upper()), (20, long.upper()),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The documents with further columns, some named like what operators use inside."""
    rows = [(i, t, None if i == 3 else "en", "s", j, j, "k") for j, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, block int, node string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def bag(rows, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in rows)

"""Near-duplicate documents: all pairs with a Jaccard similarity of word shingles of at least a threshold, by chosen paths.

Sets of shingles are split recursively: in each of RUNS independent runs a set follows the path of the shingles it samples, one
per level, by a hash that all sets share. Two sets of similarity s sample the same shingle with probability s, so they take the
same turn. A bucket of at most ``bucket`` sets is searched by brute force; only larger ones are split by the next level. A pair
at the threshold 0.8 is missed by all 16 runs with probability 7e-12 at the first level, 8e-8 at the second and 1e-5 at the
third and last. Candidates are verified on the full sets. Sets that the last level leaves in a large bucket are mostly near
copies of one text: there every pair may be a link, so pairs are not listed. Such a bucket is cut into chunks, every two chunks
meet in one task, and a task returns for each set only its number of links and one edge to its component there. A pair that
shares several buckets is counted in the first.

Documents with equal sets are folded first: classes of copies are one set each, and only links between different sets are
searched. Groups are the connected components of the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onledger.llm import blocks as B
from onledger.llm import text as T

RUNS, LEVELS = 16, 3
U = np.uint64
SEEDS = T.mix(np.arange(1, RUNS * LEVELS + 1, dtype=U) * T.ODD)
SETS = "doc_id long, text_key long, node binary, n int, paths array<struct<one: long, two: long, three: long>>, sketch binary"


def shingles(texts: list[bytes], width: int):
    """Distinct shingle hashes of all texts, grouped by text: hashes, text of each, first of each text. Texts of fewer words
    than a shingle have one, their whole word sequence; texts without words have none."""
    buffer = np.frombuffer(b" ".join(texts), np.uint8)
    edge = np.cumsum([len(t) + 1 for t in texts])
    start, end = T.word_spans(buffer)
    doc = np.searchsorted(edge, start, "right")
    prefix = T.Prefix(T.word_codes(buffer, 0, (start, end)))
    begin = np.searchsorted(doc, np.arange(len(texts) + 1))
    count = np.diff(begin)
    few = np.flatnonzero((count > 0) & (count < width))
    n = max(len(doc) - width + 1, 0)
    whole = np.flatnonzero(doc[:n] == doc[width - 1:]) if n else np.zeros(0, np.int64)
    keys = np.concatenate(((prefix.windows(width) if width <= T.PART else T.sound_windows(prefix.codes, width))[whole], prefix.spans(begin[few], begin[few + 1])))
    owner = np.concatenate((doc[whole], few))
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))[:len(keys)]
    keys, owner = keys[fresh], owner[fresh]
    return keys, owner, np.searchsorted(owner, np.arange(len(texts)))


def describe(texts: list[bytes], width: int):
    """Per text: a 128-bit hash of its set (None without shingles), the set's size, the sampled shingles of all runs and levels."""
    keys, owner, first = shingles(texts, width)
    size = np.bincount(owner, minlength=len(texts))
    some = np.flatnonzero(size)
    at = first[some]
    if not len(some):
        return some, size, [], np.zeros((0, RUNS, LEVELS), U)
    nodes = np.stack([np.add.reduceat(T.mix(keys ^ U(c)), at) for c in (0x243F6A8885A308D3, 0x13198A2E03707344)], 1)
    least = np.empty((len(some), RUNS * LEVELS), U)
    for i, seed in enumerate(SEEDS):
        v = (keys ^ seed) * T.MIX_A
        v ^= v >> U(32)
        v *= T.MIX_B
        least[:, i] = np.minimum.reduceat(v, at)
    return some, size, nodes, least.reshape(len(some), RUNS, LEVELS)


def slabs(texts, size: int = 1 << 20):
    lo, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size or i == len(texts) - 1:
            yield lo, i + 1
            lo, total = i + 1, 0


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text (null as empty) and a key of the text: what tells documents apart."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    return docs.select(docs[id_col].cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def sets(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each input row: its set's hash, size, sampled paths, and two bytes of every sample to estimate similarity."""
    kind = pa.struct([("one", pa.int64()), ("two", pa.int64()), ("three", pa.int64())])

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("id"), [t or b"" for t in batch.column("text").to_pylist()]
            for lo, hi in slabs(texts):
                some, size, nodes, least = describe(texts[lo:hi], width)
                n = hi - lo
                node, paths, sketch = [None] * n, [None] * n, [None] * n
                if len(some):
                    one = T.mix(least[:, :, 0] + SEEDS[:RUNS])
                    two = T.mix(one ^ least[:, :, 1])
                    three = T.mix(two ^ least[:, :, 2])
                    made = pa.StructArray.from_arrays([pa.array(x.view(np.int64).ravel()) for x in (one, two, three)], fields=list(kind))
                    short = least.reshape(len(some), -1).astype(np.uint16)
                    for k, i in enumerate(some.tolist()):
                        node[i] = nodes[k].tobytes()
                        sketch[i] = short[k].tobytes()
                    counts = np.zeros(n, np.int32)
                    counts[some] = RUNS
                    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                    paths = pa.ListArray.from_arrays(pa.array(offsets), made)
                else:
                    paths = pa.nulls(n, pa.list_(kind))
                yield pa.RecordBatch.from_pydict({"doc_id": ids[lo:hi], "text_key": batch.column("text_key")[lo:hi], "node": pa.array(node, pa.binary()),
                                                  "n": pa.array(size, pa.int32()), "paths": paths, "sketch": pa.array(sketch, pa.binary())})

    return keyed(docs, id_col, text_col).mapInArrow(run, SETS)


def buckets(nodes: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Where each set is searched: (key, node, n) of ordinary buckets and (run, key, node, held) of those the last level leaves large.

    Keys of one set alone are dropped, keys of too many sets split further.
    """
    rows = nodes.select("node", "n", F.posexplode("paths").alias("run", "p")).select("run", "node", "n", "p.*")
    found = None
    for level, following in (("one", "two"), ("two", "three"), ("three", None)):
        held = rows.groupBy(level).agg(F.count("*").alias("held")).filter("held > 1")
        counted = rows.join(held, level)
        here = counted.filter(F.col("held") <= bucket).select(F.col(level).alias("key"), "node", "n")
        found = here if found is None else found.unionByName(here)
        rows = counted.filter(F.col("held") > bucket)
        if following:
            rows = rows.drop("held")
    return found, rows.select("run", F.col("three").alias("key"), "node", "held")


def candidates(where: DataFrame, dense: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs of sets that share an ordinary bucket and no large one, whose sizes allow the threshold and whose samples agree often enough."""
    where = where.join(dense.groupBy("node").agg(F.collect_set("key").alias("dense")), "node", "left")
    a = where.select("key", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("dense").alias("dense_a"))
    b = where.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("dense").alias("dense_b"))
    fits = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b"))
    fits = fits & ~F.coalesce(F.arrays_overlap("dense_a", "dense_b"), F.lit(False))
    pairs = a.withColumnRenamed("key", "key_a").join(b, (F.col("key_a") == F.col("key")) & fits).select("a", "b").distinct()
    left = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))
    samples = RUNS * LEVELS
    least = int(samples * threshold - 5 * (samples * threshold * (1 - threshold)) ** 0.5)  # five deviations below what the threshold gives

    def alike(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, samples) for c in ("sketch_a", "sketch_b"))
            good = pa.array((x == y).sum(1) >= least)
            yield batch.select(["a", "b"]).filter(good)

    return pairs.join(left, "a").join(right, "b").mapInArrow(alike, "a binary, b binary")


def bodies_of(docs: DataFrame, needed: DataFrame, nodes: DataFrame, id_col: str, text_col: str, change: bytes | None = None) -> DataFrame:
    """(node, body): the compressed text of one document for each needed set, its bytes translated by ``change``."""

    def pack(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "text_key": batch.column("text_key"),
                                              "body": pa.array([B.squeeze(t.translate(change)) for t in texts], pa.binary())})

    bodies = keyed(docs, id_col, text_col).mapInArrow(pack, "id long, text_key long, body binary")
    first = needed.distinct().join(nodes.select("node", "rep"), "node")
    return (first.join(bodies, first["rep"]["id"].eqNullSafe(bodies["id"]) & (first["rep"]["text_key"] == bodies["text_key"]))
            .select("node", "body").dropDuplicates(["node"]))


def common_shingles(left: list, right: list):
    """Sizes of the intersections of two lists of sets, by products of slices of their incidence matrices."""
    every, count = np.unique(np.concatenate([*left, *right]), return_counts=True)
    shared = every[count > 1]
    places = []
    for side in (left, right):
        row = np.repeat(np.arange(len(side)), [len(x) for x in side])
        value = np.concatenate(side)
        at = np.minimum(np.searchsorted(shared, value), max(len(shared) - 1, 0))
        good = shared[at] == value if len(shared) else np.zeros(len(value), bool)
        places.append((row[good], at[good]))
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(shared), 4096):
        x, y = (np.zeros((len(side), min(4096, len(shared) - lo)), np.float32) for side in (left, right))
        for m, (row, at) in zip((x, y), places):
            own = (at >= lo) & (at < lo + 4096)
            m[row[own], at[own] - lo] = 1
        out += x @ y.T
    return np.rint(out).astype(np.int64)


def crowded(dense: DataFrame, bodies: DataFrame, threshold: float, width: int, chunk: int) -> DataFrame:
    """Links within large buckets: (a, b, links), a set, the root of its component among the two chunks that met, and its links there."""
    import fractions

    share = fractions.Fraction(str(threshold))
    chunks = F.ceil(F.col("held") / chunk).cast("int")
    keys = dense.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("run", "key"))).alias("keys"))
    rows = dense.join(keys, "node").join(bodies, "node").withColumn("own", F.pmod(F.xxhash64("node", "key"), chunks).cast("int"))
    rows = rows.withColumn("other", F.explode_outer(F.sequence(F.lit(0), chunks - 1)))
    rows = rows.select("run", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "keys", "body")

    def meet(key, table):
        run, i, j = key[0].as_py(), key[2].as_py(), key[3].as_py()
        node, own = table.column("node").to_pylist(), np.array(table.column("own").to_pylist())
        order = sorted(range(len(node)), key=lambda r: node[r])
        matrix = np.zeros((len(node), RUNS), np.int64)
        for r, found in enumerate(table.column("keys").to_pylist()):
            for x in found:
                matrix[r, x["run"]] = x["key"]
        texts, sets_ = [B.expand(table.column("body")[r].as_py()) for r in range(len(node))], []
        for lo, hi in slabs(texts):
            hashes, _, first = shingles(texts[lo:hi], width)
            sets_.extend(np.split(hashes, first[1:]))
        left, right = ([r for r in order if own[r] == c] for c in (i, j))
        out = {"a": [], "b": [], "links": []}
        if left and right:
            both = common_shingles([sets_[r] for r in left], [sets_[r] for r in right])
            size = np.array([len(x) for x in sets_])
            link = both * share.denominator >= share.numerator * (size[left][:, None] + size[right][None, :] - both)
            for earlier in range(run):  # met before, in a bucket of that run
                x, y = matrix[left, earlier], matrix[right, earlier]
                link &= ~((x[:, None] == y[None, :]) & (x != 0)[:, None])
            if i == j:
                np.fill_diagonal(link, False)
                label, count = np.arange(len(left)), link.sum(1)
                while True:
                    near = np.minimum(label, np.where(link, label[None, :], len(left)).min(1))
                    if (near == label).all():
                        break
                    label = near
                found = [(left[k], left[label[k]], count[k]) for k in range(len(left))]
            else:
                label, count = np.arange(len(left)), np.concatenate((link.sum(1), link.sum(0)))
                while True:
                    other = np.where(link, label[:, None], len(left)).min(0)
                    near = np.minimum(label, np.where(link, other[None, :], len(left)).min(1))
                    if (near == label).all():
                        break
                    label = near
                found = [(left[k], left[label[k]], count[k]) for k in range(len(left))]
                found += [(right[k], left[other[k]], count[len(left) + k]) for k in range(len(right)) if count[len(left) + k]]
            for a, b, n in found:
                if n:
                    out["a"].append(node[a])
                    out["b"].append(node[b])
                    out["links"].append(int(n))
        return pa.table({"a": pa.array(out["a"], pa.binary()), "b": pa.array(out["b"], pa.binary()), "links": pa.array(out["links"], pa.int64())})

    return rows.groupBy("run", "key", "i", "j").applyInArrow(meet, "a binary, b binary, links long")


def verified(pairs: DataFrame, own: DataFrame, threshold: float, width: int) -> DataFrame:
    """The candidate pairs whose full shingle sets reach the threshold."""
    import fractions

    share = fractions.Fraction(str(threshold))
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a").join(
        own.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b")

    def check(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            x, y = batch.column("body_a"), batch.column("body_b")
            for lo in range(0, len(a), 256):  # few enough that their texts and sets stay small
                bodies_ = {}
                for names, column in ((a, x), (b, y)):
                    for i in range(lo, min(lo + 256, len(a))):
                        if names[i] not in bodies_:
                            bodies_[names[i]] = B.expand(column[i].as_py())
                names = list(bodies_)
                found = {}
                for s, t in slabs([bodies_[n] for n in names]):
                    keys, owner, first = shingles([bodies_[n] for n in names[s:t]], width)
                    last = np.append(first[1:], len(keys))
                    found.update((names[s + i], keys[first[i]:last[i]]) for i in range(t - s))
                good = []
                for i in range(lo, min(lo + 256, len(a))):
                    p, q = found[a[i]], found[b[i]]
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    good.append(common * share.denominator >= share.numerator * (len(p) + len(q) - common))
                yield batch.select(["a", "b"]).slice(lo, len(good)).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(check, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links: smallest node reachable, by taking the smallest neighbouring label and jumping."""
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = B.keep(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "near-labels")
    while True:
        near = (edges.join(labels.select(F.col("node").alias("b"), F.col("root").alias("other")), "b")
                .groupBy("a").agg(F.min("other").alias("other")))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "other").alias("root"))
        lower = B.keep(lower, "near-labels")
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("next"))
        labels = B.keep(lower.join(jump, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("old")).alias("moved")), "near-labels")
        if not labels.filter("moved").limit(1).count():
            return labels.select("node", "root")
        labels = labels.drop("moved")


def groups(docs: DataFrame, width: int = 5, threshold: float = 0.8, bucket: int = 64, chunk: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group near-duplicate documents.

    Result, one row for each input row: doc_id, class_id (smallest id of its group), copy_of (smallest id with the same shingle
    set), n_links (other sets that its set is linked to), text_key (xxhash64 of the text, null as empty), class_key (what the
    rows of a class share, null without words). Texts of one to
    ``width - 1`` words are compared by their whole word sequence; texts without words are no one's copy, each row by itself,
    with its own id. Repeated rows are copies of each other. A null id is never the smallest unless all are null.
    """
    own = B.keep(sets(docs, width, id_col, text_col), "near-sets")
    nodes = B.keep(own.filter("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").alias("id"), "text_key")).alias("rep"), F.min("doc_id").alias("rep_id"), F.max("n").alias("n"),
        F.first("paths").alias("paths"), F.first("sketch").alias("sketch")), "near-nodes")
    ordinary, dense = buckets(nodes, bucket)
    dense = B.keep(dense, "near-dense")
    pairs = B.keep(candidates(B.keep(ordinary, "near-buckets"), dense, nodes, threshold), "near-pairs")
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).union(dense.select("node"))
    bodies = B.keep(bodies_of(docs, needed, nodes, id_col, text_col), "near-bodies")
    links = verified(pairs, bodies, threshold, width).withColumn("links", F.lit(1).cast("long"))
    links = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "links"))
    links = B.keep(links.union(crowded(dense, bodies, threshold, width, chunk)), "near-links")
    degree = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    linked = components(links).join(degree, "node").join(nodes.select("node", "rep_id"), "node")
    classes = linked.groupBy("root").agg(F.min("rep_id").alias("class_id"))
    known = nodes.select("node", F.col("rep_id").alias("copy_of")).join(
        linked.join(classes, "root").select("node", "class_id", "n_links", "root"), "node", "left")
    return own.join(known, "node", "left").select(
        "doc_id", F.coalesce("class_id", "copy_of", "doc_id").alias("class_id"), F.coalesce("copy_of", "doc_id").alias("copy_of"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "text_key", F.coalesce("root", "node").alias("class_key"))

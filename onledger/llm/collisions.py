"""Near-duplicate documents through an inverted join of MinHash signatures.

Every set of word shingles has a signature of COORDINATES values. Two sets are compared in full only if at least
``least_matches`` of their coordinates collide. Sets are posted under the values of one coordinate, or where the threshold allows
it of two (``posting``): unrelated texts meet there some hundred times less often. That a pair at the threshold collides too
seldom, or shares fewer posts than asked for, has a probability below MISS in all. Counting every collision of long lists is
avoided in two ways:

* prefix: a set's posts are ordered from rare to common, and two sets that share T of them share at least EXTRA in the first
  ``posts - T + EXTRA`` of both. Only those are joined, and pairs need EXTRA collisions there before their signatures are
  compared. A set with fewer than T posts that any other set has is linked with nothing.
* skip: lists of more than ``long`` sets (near copies of one text, a very common shingle) are left out of that join. Since only
  components are asked for, their members are compared with a few representatives of the list, and in lists of more than CHUNK
  sets those that stay outside the largest component with a few others of that component, all in linear work. What is then still
  in different components meets by chunks: members outside the largest component ask the chunks of the list, where full sets are
  compared at once, and a task returns for each of them one link to every component that it reaches. No pairs are listed.

Equal sets are folded first. Components are those of the verified links.
"""

from __future__ import annotations

import fractions
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onledger.llm import blocks as B
from onledger.llm import text as T
from onledger.llm.chosen import bodies_of, common_shingles, components, keyed, shingles, slabs, verified

COORDINATES = 64
MISS = 1e-7
EXTRA = 2
REPRESENTATIVES = 4
STARS = 3
CHUNK = 1024
BATCH = 2048
U = np.uint64
SEEDS = T.mix(np.arange(5001, 5001 + COORDINATES, dtype=U) * T.ODD)
SIGNED = "doc_id long, text_key long, node binary, n int, posts array<long>, sketch binary"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def sure(chance: float, of: int, miss: float) -> tuple[int, float]:
    """The largest number of successes that ``of`` trials fall short of with a probability of at most ``miss``, and that probability."""
    below = 0.0
    for t in range(of):
        more = math.comb(of, t) * chance ** t * (1 - chance) ** (of - t)
        if below + more > miss:
            return t, below
        below += more
    return of, below


def least_matches(threshold: float, miss: float = MISS) -> int:
    """The largest number of equal coordinates that a pair at the threshold falls short of with a probability of at most ``miss``."""
    return max(sure(threshold, COORDINATES, miss)[0], 1)


def posting(threshold: float) -> tuple[int, int]:
    """Coordinates to a post, and the number of posts that a pair at the threshold shares.

    Two, if what ``least_matches`` leaves of MISS then suffices for one shared post at least, else one.
    """
    shared, _ = sure(threshold ** 2, COORDINATES // 2, MISS - sure(threshold, COORDINATES, MISS)[1])
    return (2, shared) if shared else (1, least_matches(threshold))


def signed(docs: DataFrame, width: int, span: int, id_col: str, text_col: str) -> DataFrame:
    """One row for each input row: a 128-bit hash of its shingle set, the set's size, its posts, and two bytes of each coordinate."""

    def run(batches):
        for batch in batches:
            texts = [(t or b"").translate(LOWER) for t in batch.column("text").to_pylist()]
            for lo, hi in slabs(texts):
                keys, owner, first = shingles(texts[lo:hi], width)
                size = np.bincount(owner, minlength=hi - lo)
                some = np.flatnonzero(size)
                node, sketch, least = [None] * (hi - lo), [None] * (hi - lo), np.empty((len(some), COORDINATES), U)
                if len(some):
                    at = first[some]
                    both = np.stack([np.add.reduceat(T.mix(keys ^ U(c)), at) for c in (0x452821E638D01377, 0xBE5466CF34E90C6C)], 1)
                    for j, seed in enumerate(SEEDS):
                        v = (keys ^ seed) * T.MIX_A
                        v ^= v >> U(32)
                        v *= T.MIX_B
                        least[:, j] = np.minimum.reduceat(v, at)
                    short = T.mix(least).astype(np.uint16)
                    for k, i in enumerate(some.tolist()):
                        node[i], sketch[i] = both[k].tobytes(), short[k].tobytes()
                posts = T.mix(least + SEEDS)
                if span == 2:
                    posts = T.mix(posts[:, ::2] + least[:, 1::2])
                edge = np.concatenate(([0], np.cumsum(np.where(size > 0, COORDINATES // span, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("id")[lo:hi], "text_key": batch.column("text_key")[lo:hi], "node": pa.array(node, pa.binary()), "n": pa.array(size, pa.int32()),
                    "posts": pa.ListArray.from_arrays(pa.array(edge), pa.array(posts.view(np.int64).ravel())), "sketch": pa.array(sketch, pa.binary())})

    return keyed(docs, id_col, text_col).mapInArrow(run, SIGNED)


def prefixes(nodes: DataFrame, shared: int) -> DataFrame:
    """(node, n, post, held): the posts of every set's prefix with the length of their lists. Posts of one set alone collide with nothing."""
    every = nodes.select("node", "n", F.explode("posts").alias("post"))
    held = every.groupBy("post").agg(F.count("*").alias("held")).filter("held > 1")
    ordered = every.join(held, "post").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("held", "post"))).alias("p"))
    first = ordered.filter(F.size("p") >= shared).select("node", "n", F.explode(F.slice("p", F.lit(1), F.size("p") - shared + min(EXTRA, shared))).alias("p"))
    return first.select("node", "n", "p.post", "p.held")


def fitting(n_a, n_b, threshold: float):
    """Can sets of these sizes reach the threshold?"""
    share = fractions.Fraction(str(threshold))
    return F.least(n_a, n_b) * share.denominator >= F.greatest(n_a, n_b) * share.numerator


def counted(short: DataFrame, shared: int, threshold: float) -> DataFrame:
    """(a, b) with EXTRA collisions in the lists of ordinary length."""
    a = short.select(F.col("post").alias("post_a"), F.col("node").alias("a"), F.col("n").alias("n_a"))
    b = short.select("post", F.col("node").alias("b"), F.col("n").alias("n_b"))
    met = a.join(b, (F.col("post_a") == F.col("post")) & (F.col("a") < F.col("b")) & fitting(F.col("n_a"), F.col("n_b"), threshold))
    return met.groupBy("a", "b").agg(F.count("*").alias("met")).filter(F.col("met") >= min(EXTRA, shared)).select("a", "b")


def colliding(pairs: DataFrame, nodes: DataFrame, matches: int) -> DataFrame:
    """The pairs whose whole signatures collide often enough."""
    left = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"))

    def alike(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, COORDINATES) for c in ("sketch_a", "sketch_b"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= matches))

    return pairs.join(left, "a").join(right, "b").mapInArrow(alike, "a binary, b binary")


def with_representatives(rows: DataFrame, turn: int, threshold: float) -> DataFrame:
    """(a, b): members of a long list with the list's representatives, those with the least hashes of this turn.

    Of ``undecided`` rows only members outside the list's largest component, and representatives of that component.
    """
    reps, asks = (rows.filter("NOT asks"), rows.filter("asks")) if "asks" in rows.columns else (rows, rows)
    least = [F.min(F.struct(F.xxhash64("node", F.lit(turn * REPRESENTATIVES + i)).alias("h"), "node", "n")).alias(f"r{i}") for i in range(REPRESENTATIVES)]
    chosen = reps.groupBy("post").agg(*least).select("post", F.explode(F.array(*[F.col(f"r{i}") for i in range(REPRESENTATIVES)])).alias("r"))
    met = asks.join(chosen, "post").filter((F.col("node") != F.col("r.node")) & fitting(F.col("n"), F.col("r.n"), threshold))
    return met.select(F.least("node", "r.node").alias("a"), F.greatest("node", "r.node").alias("b")).distinct()


def undecided(crowd: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of long lists that span several components: post, node, n, label, asks (it is outside the list's largest component)."""
    per_node = crowd.groupBy("node", "n").agg(F.collect_list("post").alias("lists")).join(labels.withColumnRenamed("root", "label"), "node", "left")
    rows = per_node.select("node", "n", F.coalesce("label", "node").alias("label"), F.explode("lists").alias("post"))
    sizes = rows.groupBy("post", "label").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("post").agg(F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("labels"), F.sum("c").alias("members")).filter("labels > 1")
    return rows.join(largest, "post").withColumn("asks", F.col("label") != F.col("top.label")).select(
        "post", "node", "n", "label", "asks", "members", (F.col("members") - F.col("top.c")).alias("asking"))


def across(rows: DataFrame, nodes: DataFrame, lists: DataFrame, bodies: DataFrame, matches: int, threshold: float, width: int) -> DataFrame:
    """(a, b): links between sets of different components that share a long list and collide often enough.

    Each asking set gets one link to every other component that it reaches in a chunk. A pair is compared in the first list that
    it shares. Lists of one chunk are dealt many to a task.
    """
    share = fractions.Fraction(str(threshold))
    batches = max(1, rows.count() // BATCH)
    rows = rows.join(nodes.select("node", "sketch"), "node").join(lists, "node").join(bodies, "node")
    chunks = lambda c: F.ceil(F.col(c) / CHUNK).cast("int")
    spread = lambda c, salt: F.pmod(F.xxhash64("node", F.lit(salt)), chunks(c)).cast("int")
    body = ["post", "node", "n", "label", "sketch", "lists", "body", "members"]
    held = rows.withColumn("i", F.explode(F.sequence(F.lit(0), chunks("asking") - 1))).select(*body, "i", spread("members", 1).alias("j"), F.lit(False).alias("asks"))
    asks = rows.filter("asks").withColumn("j", F.explode(F.sequence(F.lit(0), chunks("members") - 1))).select(
        *body, spread("asking", 2).alias("i"), "j", F.lit(True).alias("asks"))
    small = F.col("members") <= CHUNK
    both = held.unionByName(asks).withColumns({"batch": F.when(small, F.pmod(F.xxhash64("post"), F.lit(batches))), "alone": F.when(~small, F.col("post"))})

    def meet(key, table):
        posts = table.column("post").to_numpy()
        nodes_, labels = (np.array(table.column(c).to_pylist(), object) for c in ("node", "label"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, COORDINATES)
        size, on = table.column("n").to_numpy().astype(np.int64), table.column("asks").to_numpy(zero_copy_only=False)
        lists_ = table.column("lists").combine_chunks()
        many = np.diff(lists_.offsets.to_numpy())
        shared = np.full((len(many), int(many.max())), np.iinfo(np.int64).max)
        shared[np.arange(shared.shape[1]) < many[:, None]] = lists_.values.to_numpy()[lists_.offsets.to_numpy()[0]:lists_.offsets.to_numpy()[-1]]
        kinds = np.unique(labels, return_inverse=True)[1]
        sets_: dict = {}

        def sets_of(rows_):
            new = list({nodes_[r]: r for r in rows_ if nodes_[r] not in sets_}.values())
            texts = [B.expand(table.column("body")[r].as_py()) for r in new]
            for lo, hi in slabs(texts):
                keys, _, first = shingles(texts[lo:hi], width)
                sets_.update(zip((nodes_[r] for r in new[lo:hi]), np.split(keys, first[1:])))
            return [sets_[nodes_[r]] for r in rows_]

        out = {"a": [], "b": []}
        order = np.argsort(posts, kind="stable")
        edge = np.concatenate((np.flatnonzero(np.diff(posts[order], prepend=posts[order][:1] - 1)), [len(order)]))
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            own = order[lo:hi]
            here, asking = own[~on[own]], own[on[own]]
            step = max(1, (1 << 17) // max(len(here), 1))
            for at in range(0, len(asking), step):
                some = asking[at:at + step]
                equal = (sketch[some][:, None, :] == sketch[here][None, :, :]).sum(2)
                low, high = np.minimum(size[some][:, None], size[here][None, :]), np.maximum(size[some][:, None], size[here][None, :])
                good = (equal >= matches) & (kinds[some][:, None] != kinds[here][None, :]) & (low * share.denominator >= high * share.numerator)
                for k in np.flatnonzero(good.any(1)).tolist():
                    x, found = some[k], np.flatnonzero(good[k])
                    both = shared[here[found]]
                    good[k, found] = np.where(np.isin(both, shared[x, :many[x]]), both, np.iinfo(np.int64).max).min(1) == posts[x]  # else in another list
                left, right = some[good.any(1)], here[good.any(0)]
                if not len(left):
                    continue
                common = common_shingles(sets_of(left.tolist()), sets_of(right.tolist()))
                link = common * share.denominator >= share.numerator * (size[left][:, None] + size[right][None, :] - common)
                link &= good[good.any(1)][:, good.any(0)]
                for k in np.flatnonzero(link.any(1)).tolist():
                    found = right[link[k]]
                    for y in found[np.unique(kinds[found], return_index=True)[1]].tolist():
                        a, b = sorted((nodes_[left[k]], nodes_[y]))
                        out["a"].append(a)
                        out["b"].append(b)
        return pa.table({"a": pa.array(out["a"], pa.binary()), "b": pa.array(out["b"], pa.binary())})

    return both.groupBy("batch", "alone", "i", "j").applyInArrow(meet, "a binary, b binary")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, root) after more links: components of the components."""
    by = labels.select("node", "root")
    both = links.join(by.select(F.col("node").alias("a"), F.col("root").alias("x")), "a", "left").join(by.select(F.col("node").alias("b"), F.col("root").alias("y")), "b", "left")
    both = B.keep(both.select("a", "b", F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y")), "signed-merge")
    joined = components(both.filter(F.col("x") != F.col("y")).select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
    new = both.select(F.col("a").alias("node"), F.col("x").alias("root")).union(both.select("b", "y")).distinct().join(by.select("node"), "node", "left_anti")
    return B.keep(by.unionByName(new).join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "signed-labels")


def groups(docs: DataFrame, width: int = 2, threshold: float = 0.8, long: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose sets of word shingles (A-Z lower-cased) have a Jaccard similarity of at least ``threshold``.

    Result, one row for each input row: doc_id, n_shingles, component_id (smallest id reachable over links), kept (doc_id is
    component_id). Texts of one to ``width - 1`` words have one shingle, their whole word sequence; null and empty texts and
    texts without words have none and are linked with nothing, not even each other. Repeated rows are copies. A null id is
    never the smallest unless all are null; then component_id is null and kept true. Other columns are ignored.
    """
    matches = least_matches(threshold)
    span, shared = posting(threshold)
    own = B.keep(signed(docs, width, span, id_col, text_col), "signed")
    nodes = B.keep(own.filter("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").alias("id"), "text_key")).alias("rep"), F.min("doc_id").alias("rep_id"), F.first("n").alias("n"),
        F.first("posts").alias("posts"), F.first("sketch").alias("sketch")), "signed-sets")
    posted = B.keep(prefixes(nodes, shared), "posted")
    crowd = posted.filter(F.col("held") > long).select("post", "node", "n")
    large = posted.filter(F.col("held") > CHUNK).select("post", "node", "n")
    bodies = B.keep(bodies_of(docs, posted.select("node"), nodes, id_col, text_col, LOWER), "signed-bodies")

    def confirmed(pairs):
        """Pairs whose signatures collide often enough and whose full sets reach the threshold."""
        good = B.keep(colliding(pairs, nodes, matches), "signed-pairs")
        return B.keep(verified(good, bodies, threshold, width), "signed-links")

    pairs = counted(posted.filter(F.col("held") <= long), shared, threshold).unionByName(with_representatives(crowd, 0, threshold)).distinct()
    labels = components(confirmed(pairs))
    for turn in range(1, STARS):
        large = B.keep(undecided(large, labels), "signed-large")  # a list of one component stays so
        stars = B.keep(with_representatives(large, turn, threshold), "signed-stars")
        near = None if stars.isEmpty() else confirmed(stars)
        if near is None or near.isEmpty():
            break
        labels = merged(labels, near)
    lists = crowd.groupBy("node").agg(F.collect_list("post").alias("lists"))
    rows = B.keep(undecided(crowd, labels), "signed-undecided")
    near = B.keep(across(rows, nodes, lists, bodies, matches, threshold, width), "signed-across").distinct()
    if not near.isEmpty():
        labels = merged(labels, near)
    linked = labels.join(nodes.select("node", "rep_id"), "node")
    classes = linked.groupBy("root").agg(F.min("rep_id").alias("component_id"))
    known = nodes.select("node", "rep_id").join(linked.join(classes, "root").select("node", "component_id"), "node", "left")
    out = own.select("doc_id", "n", "node").join(known, "node", "left").withColumn("component_id", F.coalesce("component_id", "rep_id", "doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

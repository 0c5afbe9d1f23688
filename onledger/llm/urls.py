"""URL filter: rules by host and path, and for other URLs a tree of path templates per host. DataFrame functions only.

The tree is built one level at a time, down to the deepest path, on counts of paths, never on single pages. Digits are generalised
first; a segment that holds too small a share of its parent becomes a wildcard; two siblings are alike if a chi-square test cannot
tell what follows them apart. Of alike siblings the first is a leader that the others join. A branch of fewer pages than SUPPORT
is not split further. A template is rejected by the smoothed share of blocks among its pages that rules decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from onledger.session import materialize

#: The rules of the registered query, host and path together.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
SHARE = 0.02
SUPPORT = 5
SMOOTH = 4.0  # pages that are taken to have been seen before, half of them blocked: a pure template needs 16 blocked pages
PRIOR = 0.5
PURITY = 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z folded) and path of a URL; both empty if it is null or has no ``://``."""
    url = F.coalesce(url, F.lit(""))
    after = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def matched(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits, as a struct of rule and verdict, or null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """Generalised segments; a last slash counts as one."""
    return F.slice(F.split(F.regexp_replace(path, "[0-9]+", "{n}"), "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))


def alike(cell: DataFrame) -> DataFrame:
    """(node, v, leader): which earlier sibling a branch joins, if any. cell: node, v, following, o (pages).

    A parent has at most 1 / SHARE + 1 branches, so a pair of branches meets at most so often for each following segment. Two
    branches of a and b pages are compared by the two-sample chi-square over the segments that follow either.
    """
    branch = cell.groupBy("node", "v").agg(F.sum("o").alias("pages"), F.count("*").alias("kinds"))
    x = branch.select("node", F.col("v").alias("a"), F.col("pages").alias("n_a"), F.col("kinds").alias("k_a"))
    y = branch.select("node", F.col("v").alias("b"), F.col("pages").alias("n_b"), F.col("kinds").alias("k_b"))
    pairs = x.join(y, "node").filter(F.col("a") < F.col("b"))
    one = cell.select("node", "following", F.col("v").alias("a"), F.col("o").alias("o_a"))
    two = cell.select("node", "following", F.col("v").alias("b"), F.col("o").alias("o_b"))
    met = one.join(two, ["node", "following"]).filter(F.col("a") < F.col("b")).join(pairs, ["node", "a", "b"])
    ratio = F.sqrt(F.col("n_b") / F.col("n_a"))
    both = met.groupBy("node", "a", "b").agg(
        F.sum((ratio * F.col("o_a") - F.col("o_b") / ratio) ** 2 / (F.col("o_a") + F.col("o_b"))).alias("x"),
        F.sum("o_a").alias("c_a"), F.sum("o_b").alias("c_b"), F.count("*").alias("shared"))
    p = pairs.join(both, ["node", "a", "b"], "left").fillna(0, ["x", "c_a", "c_b", "shared"])
    # a segment that follows one branch only adds what its share of the other's pages would be
    x2 = F.col("x") + (F.col("n_a") - F.col("c_a")) * F.col("n_b") / F.col("n_a") + (F.col("n_b") - F.col("c_b")) * F.col("n_a") / F.col("n_b")
    df = F.col("k_a") + F.col("k_b") - F.col("shared") - 1
    same = p.filter(x2 <= df + 3 * F.sqrt(2 * df)).select("node", "a", "b")
    leads = same.select("node", "a").distinct().join(same.select("node", F.col("b").alias("a")).distinct(), ["node", "a"], "left_anti")
    return same.join(leads, ["node", "a"]).groupBy("node", F.col("b").alias("v")).agg(F.min("a").alias("leader"))


def templates(paths: DataFrame) -> DataFrame:
    """(host, segs, template) of counted paths (host, segs, n)."""
    paths = materialize(paths.withColumns({"node": F.to_json(F.struct("host")), "done": F.lit(False)}), "url-level")
    finished, level = paths.filter("done"), 0
    while True:
        here = F.coalesce(F.get("segs", F.lit(level)), F.lit(""))
        pages = paths.groupBy("node").agg(F.sum("n").alias("n_node"))
        ended = F.size("segs") <= level
        rows = paths.join(pages, "node").withColumn("done", ended | (F.col("n_node") < SUPPORT))
        rows = rows.withColumn("node", F.when(F.col("done") & ~ended, F.concat("node", F.lit("/**"))).otherwise(F.col("node"))).drop("n_node")
        rows = materialize(rows, "url-level")
        finished = finished.unionByName(rows.filter("done"))
        open_ = rows.filter("NOT done").withColumns({"seg": here, "following": F.get("segs", F.lit(level + 1))})
        if open_.isEmpty():
            return finished
        child = open_.groupBy("node", "seg").agg(F.sum("n").alias("n_child"))
        parent = child.groupBy("node").agg(F.sum("n_child").alias("n_parent"))
        child = child.join(parent, "node").withColumn("v", F.when((F.col("n_child") >= F.lit(SHARE) * F.col("n_parent")) & (
            F.col("n_child") >= SUPPORT), F.col("seg")).otherwise("*")).select("node", "seg", "v")
        open_ = materialize(open_.join(child, ["node", "seg"]), "url-level")
        cell = open_.groupBy("node", "v", "following").agg(F.sum("n").alias("o")).withColumn("following", F.coalesce("following", F.lit("/")))  # no segment holds a slash
        joined = open_.join(alike(cell), ["node", "v"], "left")
        name = F.when(F.col("leader").isNull(), F.col("v")).otherwise(F.col("leader"))
        paths = materialize(joined.withColumn("node", F.concat("node", F.lit("/"), name)).select("host", "segs", "n", "l", "b", "node", "done"), "url-level")
        level += 1


def judge(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Decide on every URL.

    Result, one row for each input row: page_id, host, path, rule (null if none fits), verdict (allow or block), template (host
    and template of the path; merged branches have their leader's name, ``*`` stands for rare segments, ``**`` for the rest of a
    small branch). Null URLs and those without ``://`` have an empty host and path and are judged like any other template. A
    template without labelled pages keeps the prior, which allows it. Ties of
    counts need no order, repeated rows count again, and columns other than the two named are ignored.
    """
    host, path = parts(pages[url].cast("string"))
    own = pages.select(pages[page_id].alias("page_id"), host.alias("host"), path.alias("path"))
    own = own.withColumn("m", matched(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "m.rule", "m.verdict")
    own = own.withColumn("segs", segments(F.col("path")))
    counted = own.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("verdict").alias("l"), F.count_if(F.col("verdict") == "block").alias("b"))
    tree = materialize(templates(counted), "url-tree")
    leaf = tree.groupBy("node").agg(F.sum("l").alias("l"), F.sum("b").alias("b"))
    leaf = leaf.select("node", ((F.col("b") + SMOOTH * PRIOR) / (F.col("l") + SMOOTH) >= PURITY).alias("reject"))
    known = tree.join(leaf, "node").select("host", "segs", "reject", F.col("node").alias("template"))
    return own.join(known, ["host", "segs"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("reject"), "block").otherwise("allow")).alias("verdict"), "template")

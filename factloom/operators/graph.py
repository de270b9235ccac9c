"""Closures over references: chains, reachability, fixpoints, components, levels.

Every loop writes its round to the checkpoint folder, so plans stay one round deep and a lost
executor re-reads the last round. Rounds move only (node, label) pairs; no group is gathered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut, is_empty, written


def chain_roots(edges: DataFrame) -> DataFrame:
    """(e, root, cyclic): the end of each entity's chain of single references.

    `edges` is (src, dst) with one dst per src. Pointer jumping doubles the distance per round, so
    a chain of n links takes log2(n) joins. An entity on or leading into a cycle gets the cycle's
    smallest member as root and is marked. Ends of chains are not listed: they root themselves.
    """
    hops = cut(edges.select("src", "dst"))
    waiting = -1
    while True:
        far = hops.select(F.col("src").alias("dst"), F.col("dst").alias("_far"))
        hops = cut(hops.select("src", "dst").join(far, "dst", "left").select(
            "src", F.coalesce("_far", "dst").alias("dst"), F.col("_far").isNotNull().alias("_going")))
        going = hops.where("_going").count()
        # an acyclic rest shrinks in every round, so one that does not leads into cycles
        if going in (0, waiting):
            break
        waiting = going
    roots = hops.where("not _going").select(F.col("src").alias("e"), F.col("dst").alias("root"), F.lit(False).alias("cyclic"))
    if going == 0:
        return roots
    landed = _landings(hops.where("_going").select("src", "dst"))
    ring = edges.join(landed.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
    least = _ring_minimum(ring)
    looped = landed.join(least.select(F.col("src").alias("dst"), "least"), "dst").select(
        F.col("src").alias("e"), F.col("least").alias("root"), F.lit(True).alias("cyclic"))
    return roots.unionByName(looped)


def _landings(hops: DataFrame) -> DataFrame:
    """(src, dst) jumped on until every dst is on a cycle: the set of targets stops shrinking."""
    size = -1
    while True:
        now = hops.select("dst").distinct().count()
        if now == size:
            return hops
        size = now
        far = hops.select(F.col("src").alias("dst"), F.col("dst").alias("_far"))
        hops = cut(hops.join(far, "dst").select("src", F.col("_far").alias("dst")))


def _ring_minimum(ring: DataFrame) -> DataFrame:
    """(src, least): the smallest member of each cycle, the stretch seen doubling per round."""
    seen = cut(ring.select("src", "dst", F.least("src", "dst").alias("least")))
    while True:
        far = seen.select(F.col("src").alias("dst"), F.col("dst").alias("_far"), F.col("least").alias("_l"))
        nxt = cut(seen.join(far, "dst").select("src", F.col("_far").alias("dst"), F.least("least", "_l").alias("least"),
                                               (F.col("_l") < F.col("least")).alias("_moved")))
        seen = nxt.select("src", "dst", "least")
        if is_empty(nxt.where("_moved")):
            return seen.select("src", "least")


def same_group(roots: DataFrame, e: DataFrame) -> DataFrame:
    """(e, root) of the given entities (e) with a root for every one: itself where none is listed."""
    return e.select("e").distinct().join(roots.select("e", "root"), "e", "left").select(
        "e", F.coalesce("root", "e").alias("root"))


def reachable(edges: DataFrame, starts: DataFrame, *, at_least: int = 0, reverse: bool = False) -> DataFrame:
    """(start, node) for every node reached from `starts` (start) over `edges` (src, dst).

    `at_least` 0 counts the start itself; `reverse` follows references backwards. Each round joins
    only the newest pairs and drops those seen, so cycles end and no pair is produced twice.
    """
    step = edges.select("src", "dst") if not reverse else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    seed = starts.select("start", F.col("start").alias("node")).distinct()

    def grow(newest: DataFrame) -> DataFrame:
        return newest.join(step, newest["node"] == step["src"]).select("start", F.col("dst").alias("node"))
    return fixpoint(seed if at_least == 0 else grow(seed), grow)


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The least set with the rows of `seed` closed under `step`, semi-naive.

    `step` maps the rows new in the last round to candidates of the same columns.
    """
    columns = seed.columns
    newest = cut(seed.distinct())
    rounds = [newest]
    while not is_empty(newest):
        newest = cut(step(newest).select(*columns).distinct().join(_together(rounds), columns, "left_anti"))
        rounds.append(newest)
        if len(rounds) >= 8:
            # merged now and then, so a long walk reads a few tables per round
            rounds = [cut(_together(rounds))]
    return _together(rounds)


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(e, root): connected components of undirected edges (src, dst), rooted at the smallest member.

    Alternating large-star and small-star steps, each a minimum per node (partially aggregated
    before the shuffle) joined back to the edges. A hub's edges stay spread over tasks by the
    skew-join handling, since only its one minimum is on the other side. Isolated nodes are not
    listed.
    """
    pairs = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    while True:
        pairs = cut(_small_star(_large_star(pairs)))
        if _is_star(pairs):
            break
    return pairs.select(F.col("src").alias("e"), F.col("dst").alias("root")).unionByName(
        pairs.select(F.col("dst").alias("e"), F.col("dst").alias("root")).distinct())


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
    return both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("src").agg(F.min("dst").alias("m"))
    moved = pairs.join(least, "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(least.select("src", F.col("m").alias("dst"))).distinct()


def _is_star(pairs: DataFrame) -> bool:
    """Whether every node points at one root and no root points on."""
    several = pairs.groupBy("src").agg(F.count("*").alias("n")).where("n > 1").select("src")
    onward = pairs.select(F.col("dst").alias("src")).join(pairs.select("src"), "src", "left_semi")
    return is_empty(several.unionByName(onward))


def linked(pairs: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """Pairs (a, b) joined by an edge in either direction, or through one record of at most `most` neighbours.

    The rule's own degree bound keeps the two-hop step small: a record passes at most `most`
    neighbours on.
    """
    near = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    want = pairs.select("a", "b").distinct()
    direct = want.join(near.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_semi")
    small = near.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("src")
    via = near.join(small, "src", "left_semi").select(F.col("src").alias("mid"), F.col("dst").alias("end"))
    left = want.select("a").distinct().join(via.withColumnRenamed("end", "a"), "a")
    hops = left.join(via.withColumnRenamed("end", "b"), "mid").select("a", "b")
    through = want.join(hops, ["a", "b"], "left_semi")
    return direct.unionByName(through).distinct()


def overmerged(roots: DataFrame, most: int = 3) -> DataFrame:
    """(root, n): roots that more than `most` entities reach, over any number of hops."""
    return roots.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > most)


def backlinks(targets: DataFrame, edges: DataFrame, identity: DataFrame) -> DataFrame:
    """(identity, n): references to `targets` (e) by the identity attribute of the record pointing.

    `identity` is (e, ident); a record with none counts under "no identity".
    """
    pointing = edges.join(targets.select(F.col("e").alias("dst")), "dst", "left_semi").select(F.col("src").alias("e"))
    return pointing.join(identity, "e", "left").groupBy(F.coalesce("ident", F.lit("no identity")).alias("identity")).agg(
        F.count("*").alias("n"))


def levels(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Depth of each node over `edges` (src depends on dst), the dangling targets, and the unsettled.

    A node's level is one more than its deepest dependency's; nodes that never settle are on or
    above a cycle. Each node keeps a count of its open dependencies. A round takes those that have
    none, and only the edges that point at these: what hangs on them is counted down by partial
    sums, and the nodes left are written once. The edges are never rewritten, and the round's own
    nodes are a table of known size, so that Spark sends them to the edges where they are few.
    """
    known = nodes.select("e").distinct()
    dangling = edges.join(known.select(F.col("e").alias("dst")), "dst", "left_anti").select("src", "dst")
    inner = written(edges.select("src", "dst").distinct().join(known.select(F.col("e").alias("dst")), "dst", "left_semi"))
    rest = written(known.join(inner.groupBy(F.col("src").alias("e")).agg(F.count("*").alias("open")), "e", "left").select(
        "e", F.coalesce("open", F.lit(0)).alias("open")))
    settled, level = [], 0
    while True:
        ready = written(rest.where("open = 0").select("e", F.lit(level).alias("level")))
        if is_empty(ready):
            break
        settled.append(ready)
        if len(settled) >= 8:
            settled = [written(_together(settled))]
        done = inner.join(ready.select(F.col("e").alias("dst")), "dst").groupBy(F.col("src").alias("e")).agg(F.count("*").alias("done"))
        rest = written(rest.where("open > 0").join(done, "e", "left").select("e", (F.col("open") - F.coalesce("done", F.lit(0))).alias("open")))
        level += 1
    out = _together(settled) if settled else known.limit(0).withColumn("level", F.lit(0))
    return out, dangling, rest.select("e")

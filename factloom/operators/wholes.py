"""Linking two stores through what things are part of: attributes by shared values, parts by their wholes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import graph
from factloom.session import cut, is_empty


def same_attribute(known: DataFrame, held: DataFrame, share: float = 0.5) -> DataFrame:
    """(ident, found, n, shared): for each attribute of `known` (ident, v), that of `held` (ident, v) with most of its values.

    One that has under `share` of the n distinct values is not found, and then there is no row. Of
    equals the first by name.
    """
    want = known.select("ident", "v").where("v is not null").distinct()
    sizes = want.groupBy("ident").agg(F.count("*").alias("n"))
    there = held.select(F.col("ident").alias("found"), "v").where("v is not null").distinct()
    shared = want.join(there, "v").groupBy("ident", "found").agg(F.count("*").alias("shared"))
    best = shared.groupBy("ident").agg(F.min(F.struct((-F.col("shared")).alias("s"), "found")).alias("b"))
    return best.join(sizes, "ident").select("ident", "b.found", "n", (-F.col("b.s")).alias("shared")).where(F.col("shared") >= share * F.col("n"))


def in_wholes(part_of: DataFrame) -> DataFrame:
    """(part, whole) over any number of steps of `part_of` (part, whole); a part is not in itself, on a ring neither."""
    steps = part_of.select(F.col("part").alias("src"), F.col("whole").alias("dst"))
    far = graph.reachable(steps, part_of.select(F.col("part").alias("start")), at_least=1)
    return far.select(F.col("start").alias("part"), F.col("node").alias("whole")).where("part <> whole")


def identity_of_parts(parts: DataFrame, carried: DataFrame) -> DataFrame:
    """(whole_kind, ident, n): the identity attribute that most parts of each kind of whole carry.

    `parts` is (part, whole_kind), `carried` (e, ident); of equals the first by name. For a kind whose
    own values two stores don't share, this is what its parts are known by once their wholes are matched.
    """
    votes = parts.distinct().join(carried.select(F.col("e").alias("part"), "ident").distinct(), "part").groupBy("whole_kind", "ident").agg(F.count("*").alias("n"))
    return votes.groupBy("whole_kind").agg(F.min(F.struct((-F.col("n")).alias("n"), "ident")).alias("b")).select("whole_kind", "b.ident", (-F.col("b.n")).alias("n"))


def votes(left: DataFrame, right: DataFrame, wholes: DataFrame) -> DataFrame:
    """(left, right, votes) of parts of matched wholes.

    Sides are (whole, part, key), where a key is something said of the part; `wholes` is (left,
    right). A key votes when, within its whole, one part says it on either side; so no pairs of a
    whole's parts are listed, and a whole with a third of all parts is spread by its keys.
    """
    def single(side: DataFrame, part: str) -> DataFrame:
        # one part says it where the least and the greatest that do are the same
        said = side.where("key is not null").groupBy("whole", "key").agg(F.min("part").alias(part), F.max("part").alias("_most"))
        return said.where(F.col(part) == F.col("_most")).drop("_most")
    here = single(left, "left").withColumnRenamed("whole", "_left").join(
        wholes.select(F.col("left").alias("_left"), F.col("right").alias("whole")).distinct(), "_left")
    return here.join(single(right, "right"), ["whole", "key"]).groupBy("left", "right").agg(F.count_distinct("key").alias("votes"))


def assign(candidates: DataFrame) -> DataFrame:
    """One-to-one pairs (left, right, votes) of the candidates, by locally dominant matching.

    A pair is taken when it is the best of both its ends; these ends leave, and what remains is
    matched again, until nothing remains. Better means more votes, then the smaller left, then the
    smaller right, so the result is that of taking pairs in that order. A round costs two minima and
    two anti joins over the remaining candidates; a repeated candidate counts once, with its most votes.
    """
    rest = cut(candidates.groupBy("left", "right").agg(F.max("votes").alias("votes")))
    taken = []
    while not is_empty(rest):
        rank = F.struct((-F.col("votes")).alias("v"), "left", "right")
        of_left, of_right = rest.groupBy("left").agg(F.min(rank).alias("b")), rest.groupBy("right").agg(F.min(rank).alias("b"))
        both = cut(of_left.select("b").intersect(of_right.select("b")).select("b.left", "b.right", (-F.col("b.v")).alias("votes")))
        taken.append(both)
        rest = cut(rest.join(both.select("left"), "left", "left_anti").join(both.select("right"), "right", "left_anti"))
    out = taken[0] if taken else rest
    for t in taken[1:]:
        out = out.unionByName(t)
    return out.select("left", "right", "votes")

"""Graph operators as joins: components, greedy pairing, chains of pieces.

Each one iterates; every round is a fixed set of equi-joins and aggregations on
node ids and ends in a checkpoint, so plans stay short and a lost executor
costs one round. A hot node is an aggregation key (combined map side) or the
many-side of a join with one row per node, never a collected group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.session import cut_lineage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` for every node of an undirected edge list.

    The component is its smallest node. Large-star / small-star contraction:
    the number of rounds grows with the logarithm of the node count, so long
    thin components (a curve of thousands of pieces) do not need as many rounds
    as they have nodes. Self loops only declare a node.
    """
    raw = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
    nodes = raw.select(F.explode(F.array("u", "v")).alias("node")).distinct()

    def ordered(df: DataFrame) -> DataFrame:
        return (
            df.filter(F.col("u") != F.col("v"))
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
            .distinct()
        )

    links = cut_lineage(ordered(raw))
    previous = None
    while True:
        both = links.select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("a"), F.col("v").alias("b")),
                    F.struct(F.col("v").alias("a"), F.col("u").alias("b")),
                )
            ).alias("e")
        ).select("e.*")
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Larger neighbours are re-linked to the smallest node in reach.
        large = ordered(
            both.join(lowest, "a")
            .filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("u"), F.col("m").alias("v"))
        )
        # Smaller neighbours, and the node itself, likewise.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = ordered(
            large.join(low, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        )
        links = cut_lineage(small)
        state = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        ).first()
        if state == previous:
            break
        previous = state
    roots = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.join(roots, "node", "left").select(
        "node", F.coalesce("root", "node").alias("component")
    )


def greedy_pairs(
    pairs: DataFrame, a: str, b: str, rank: Column, *, keep: Sequence[str] = ()
) -> DataFrame:
    """Disjoint pairs, best ``rank`` (smallest) first, as a sequential greedy pass picks them.

    A pair that is the best remaining choice of both its members is always
    picked by the sequential pass, so all such pairs are taken at once; pairs
    sharing a member with them are dropped; repeat. ``rank`` must be unique.
    """
    left = cut_lineage(pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), *keep, rank.alias("rank")))
    taken: DataFrame | None = None
    while not left.isEmpty():
        best = (
            left.select(F.explode(F.array("a", "b")).alias("m"), "rank")
            .groupBy("m")
            .agg(F.min("rank").alias("best"))
        )
        picked = cut_lineage(
            left.join(best.withColumnRenamed("m", "a").withColumnRenamed("best", "best_a"), "a")
            .join(best.withColumnRenamed("m", "b").withColumnRenamed("best", "best_b"), "b")
            .filter((F.col("rank") == F.col("best_a")) & (F.col("rank") == F.col("best_b")))
            .select("a", "b", *keep, "rank")
        )
        taken = picked if taken is None else taken.unionByName(picked)
        used = picked.select(F.explode(F.array("a", "b")).alias("m"))
        left = cut_lineage(
            left.join(used.withColumnRenamed("m", "a"), "a", "left_anti").join(
                used.withColumnRenamed("m", "b"), "b", "left_anti"
            ).select("a", "b", *keep, "rank")
        )
    out = left if taken is None else taken
    return out.select(F.col("a").alias(a), F.col("b").alias(b), *keep)


def chain_pieces(pieces: DataFrame, links: DataFrame) -> DataFrame:
    """Order pieces into chains.

    ``pieces``: column ``piece`` (long). A piece has two ends, ``2 * piece`` at
    its start and ``2 * piece + 1`` at its finish. ``links``: ``a, b``, ends
    that are joined; every end occurs at most once. Returns ``chain, pos,
    piece, flipped``: the chain is named after the end it is entered by, the
    lowest free end, or the start of the lowest piece for a closed loop.
    """
    links = cut_lineage(links.select("a", "b"))
    alone = pieces.select(
        (2 * F.col("piece")).alias("chain"),
        F.lit(0).cast("long").alias("pos"),
        "piece",
        F.lit(False).alias("flipped"),
    )
    if links.isEmpty():
        return alone
    half = F.floor(F.col("e") / 2).cast("long")
    both = links.select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("e"), F.col("b").alias("f")),
                F.struct(F.col("b").alias("e"), F.col("a").alias("f")),
            )
        ).alias("s")
    ).select("s.*")
    comps = connected_components(
        links.select(
            F.floor(F.col("a") / 2).cast("long").alias("src"),
            F.floor(F.col("b") / 2).cast("long").alias("dst"),
        )
    ).withColumnRenamed("node", "piece")
    ends = comps.select(
        "piece",
        "component",
        F.explode(F.array(2 * F.col("piece"), 2 * F.col("piece") + 1)).alias("e"),
    ).join(both, "e", "left")
    opening = ends.groupBy("component").agg(F.min(F.when(F.col("f").isNull(), F.col("e"))).alias("free"))
    # Loops have no free end: cut the link at the start of the lowest piece.
    entry = opening.select("component", F.coalesce("free", 2 * F.col("component")).alias("entry"))
    # A walk enters a piece by end e and leaves by the other one; the state
    # before it entered the linked piece by that piece's other end.
    other = F.when(F.col("f") % 2 == 0, F.col("f") + 1).otherwise(F.col("f") - 1)
    state = (
        ends.join(entry, "component")
        .withColumn("ptr", F.when(F.col("e") == F.col("entry"), F.lit(None).cast("long")).otherwise(other))
        .select("component", "entry", "e", "ptr")
        .withColumn("ptr", F.coalesce("ptr", "e"))
        .withColumn("dist", F.when(F.col("ptr") == F.col("e"), F.lit(0)).otherwise(F.lit(1)).cast("long"))
    )
    state = cut_lineage(state)
    while True:
        # The other direction of a loop never settles; once every piece has
        # been reached from its chain's entry the walk is complete.
        covered = state.filter(F.col("ptr") == F.col("entry")).select(half.alias("piece"))
        if comps.join(covered, "piece", "left_anti").isEmpty():
            break
        hop = state.select(
            F.col("e").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("dist").alias("dist2")
        )
        state = cut_lineage(
            state.join(hop, "ptr").select(
                "component",
                "entry",
                "e",
                F.col("ptr2").alias("ptr"),
                (F.col("dist") + F.col("dist2")).alias("dist"),
            )
        )
    walked = state.filter(F.col("ptr") == F.col("entry")).select(
        F.col("entry").alias("chain"),
        F.col("dist").alias("pos"),
        half.alias("piece"),
        (F.col("e") % 2 == 1).alias("flipped"),
    )
    return alone.join(comps.select("piece"), "piece", "left_anti").select(
        "chain", "pos", "piece", "flipped"
    ).unionByName(walked)

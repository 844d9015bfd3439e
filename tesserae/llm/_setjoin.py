"""Groups of like sets: exact Jaccard joins by prefix filtering, from built-in functions only.

Two sets of similarity t share one of their first n - ceil(t n) + 1 members in any order
that all sets have in common, so members of these prefixes bring all pairs together. Where
sets of sizes n and m meet at places i and j of their orders, they share min(n - i, m - j)
members at most, and need t (n + m) / (1 + t): most chance meetings end there.

Links are wanted only as far as they connect. In each of ROUNDS rounds the members that more
than HOT sets share name PIVOTS pivots each, the same for all members of a group of copies, and each
set is compared with the pivot of another group that is nearest to it. So a large group of copies
or near copies becomes one at the cost of a pair a set. Then all pairs of different groups that meet
early enough are compared, and no link between groups is missed: rows of a frequent member meet only
rows of other groups than its commonest, and are dealt into pieces, each pair of which is a key of
its own, so no task holds a whole one.

Pairs are sifted before their sets are fetched. Similar sets share a number of prefix members. Rows may
carry a sketch of their set: a bit a member hashes to is turned over by each such member, so sets differ
in as many members as their sketches in bits at least, and few chance meetings leave the join.

With length partitions, a row of a frequent member meets those of its own partition and of the next.
Tables of sets are joined by sorted merges whatever their size, so plans are alike at all sizes.
A round's links and groups are written to the shared folder, so a lost executor costs little.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._components import SMALL, components
from ._tables import settle

ROUNDS, PIVOTS = 2, 4
#: 64-bit words of a sketch.
WORDS = 2
#: Sets that share a prefix member from which it names a pivot; fewer are compared at once.
HOT = 32
#: Rows of one prefix member that meet in one task.
PIECE = 4096


def prefix_size(n: Column, similarity: float) -> Column:
    return (n - F.ceil(F.round(F.lit(similarity) * n, 9)) + 1).cast("int")


def _can(i: Column, n: Column, j: Column, m: Column, similarity: float) -> Column:
    """Sets that first meet at places i and j can reach the similarity."""
    need = F.ceil(F.round(F.lit(similarity / (1 + similarity)) * (n + m), 6))
    return F.least(n - i, m - j) >= need


def sketch(s: Column, words: int = WORDS) -> list[Column]:
    """The words of a set's sketch, as columns; s: an array of distinct integers."""

    def word(k: int) -> Column:
        held = F.filter(s, lambda x: F.pmod(F.shiftright(F.xxhash64(x), 6), F.lit(words)) == k)
        bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.xxhash64(x).bitwiseAND(F.lit(63)).cast("int"))
        return F.aggregate(held, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(bit(x)))

    return [word(k).alias(f"bits{k}") for k in range(words)]


def shared_entries(entries: DataFrame, label: str, about: DataFrame | None = None) -> DataFrame:
    """The rows of entries, a settled table, whose member (h) is in another row too; c: in how many.

    about: a table of node and more columns, which are added to these rows only.
    """
    twice = entries.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    shared = entries.join(twice.hint("merge"), "h")
    return settle(shared if about is None else shared.join(about.hint("merge"), "node"), f"{label}-prefixes")[0]


def like_sets(live: DataFrame, sets_of: Callable[[DataFrame], DataFrame], similarity: float, label: str, rounds: int = ROUNDS, piece: int = PIECE, hot: int = HOT, small: int = SMALL, distinct: bool = False, pivots: int = PIVOTS) -> DataFrame:
    """(node, root) of every set with a like one; root is the smallest node reached over links.

    live: (h long, pos int, n int, node long[, part long][, bits0 long, ...], c long), the prefix members of
    each set, with place, set size, length partition and sketch; see shared_entries. sets_of(table of node):
    (node, s), the whole sets of the nodes asked for. small: see components; 0 keeps the whole plan in
    built-in functions. distinct: no two sets are equal, so sets of one size share one member less at most.
    """
    spread = [-1, 0, 1] if "part" in live.columns else [0]
    if "part" not in live.columns:
        live = live.withColumn("part", F.lit(0).cast("long"))
    bits = [c for c in live.columns if c.startswith("bits")]
    own, other = ([F.col(c).alias(f"{side}{c}") for c in bits] for side in "ab")
    need = F.ceil(F.round(F.lit(similarity / (1 + similarity)) * (F.col("na") + F.col("nb")), 6))
    # prefixes of like sets share as many members, whatever their order
    least = F.least(*(prefix_size(F.col(x), similarity) - F.col(x) + need for x in ("na", "nb")))
    able = need <= F.least("na", "nb") - ((F.col("na") == F.col("nb")) & F.lit(distinct)).cast("int")
    apart = sum((F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in bits), F.lit(0))
    able = able & (apart <= F.col("na") + F.col("nb") - 2 * need)

    def verified(asked: DataFrame) -> DataFrame:
        nodes = asked.select(F.col("a").alias("node")).union(asked.select("b")).distinct()
        sets, _ = settle(sets_of(nodes), f"{label}-sets")
        both = asked.join(sets.toDF("a", "sa").hint("merge"), "a").join(sets.toDF("b", "sb").hint("merge"), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        like = shared >= F.lit(similarity) * (F.size("sa") + F.size("sb") - shared) - 1e-9
        return settle(both.where(like).select("a", "b"), f"{label}-links")[0]

    def grouped(rows: DataFrame) -> DataFrame:
        if groups is None:
            return rows.withColumn("comp", F.col("node"))
        return rows.join(groups, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")

    def mixed(*named: Column) -> DataFrame:
        """Members that sets of several groups share, and what they name."""
        return grouped(hot_rows).groupBy("h").agg(*named, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").drop("lo", "hi")

    links, groups = None, None
    hot_rows, _ = settle(live.where(F.col("c") > hot), f"{label}-hot")
    often = hot_rows.groupBy("node").agg(F.count("*").alias("often"))
    for k in range(rounds + 1):
        if k < rounds:
            about = F.struct(F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), *other)
            first = F.array(*[F.min(F.struct(F.xxhash64("node", F.lit(k * pivots + j)).alias("order"), about.alias("p"))) for j in range(pivots)])
            named = mixed(first.alias("p")).select("h", F.explode(F.array_distinct(F.transform("p", lambda x: x["p"]))).alias("p")).select("h", "p.*").hint("merge")
            met = grouped(hot_rows).select("h", "comp", F.col("node").alias("a"), F.col("n").alias("na"), *own).join(named, "h").where("comp <> cb").where(able)
            times = met.groupBy("a", "na", "b", "nb", apart.cast("int").alias("apart")).agg(F.count("*").alias("times"))
            if not bits:
                # only hot members are counted here, and not all of them have the same pivots
                times = times.join(often.withColumnRenamed("node", "a"), "a").where(2 * F.col("times") >= F.least(least, F.col("often")))
            best = times.groupBy("a").agg(F.max_by("b", F.struct(-F.col("apart"), "times", "b")).alias("b"))
            pairs = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        else:
            can = _can(F.col("i"), F.col("na"), F.col("j"), F.col("nb"), similarity)
            rare = live.where(F.col("c") <= hot).select("h", "node", "pos", "n", *bits)
            left = rare.select("h", F.col("node").alias("a"), F.col("pos").alias("i"), F.col("n").alias("na"), *own)
            right = rare.select("h", F.col("node").alias("b"), F.col("pos").alias("j"), F.col("n").alias("nb"), *other)
            # of members of few sets all are counted
            few = left.join(right.hint("merge"), "h").where("a < b").where(able).select("a", "na", "b", "nb", can.cast("int").alias("can"))
            largest = F.max_by("comp", F.struct("size", "comp")).alias("cb")
            sizes = grouped(hot_rows).groupBy("h", "comp").agg(F.count("*").alias("size"))
            major = sizes.groupBy("h").agg(largest, F.count("*").alias("groups")).where("groups > 1").select("h", "cb")
            held = grouped(hot_rows).join(major, "h").withColumn("major", F.col("comp") == F.col("cb")).drop("cb")
            held = held.withColumn("parts", F.ceil(F.col("c") / piece).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
            every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
            left = held.where("not major").select("h", "part", F.col("own").alias("x"), every.alias("y"), F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("pos").alias("i"), F.col("n").alias("na"), *own)
            right = held.select("*", F.explode(F.array(*[F.col("part") + k for k in spread])).alias("at"))
            right = right.select("h", F.col("at").alias("part"), every.alias("x"), F.col("own").alias("y"), F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("pos").alias("j"), F.col("n").alias("nb"), "major", *other)
            # two rows that are both on the left meet twice
            many = left.join(right.hint("merge"), ["h", "part", "x", "y"]).where("ca <> cb and (major or a < b)").where(able).where(can).select(F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"), F.lit(1).alias("can"))
            counted = few.union(many).groupBy("a", "na", "b", "nb").agg(F.count("*").alias("times"), F.max("can").alias("can")).where("can = 1")
            counted = counted.join(often.toDF("a", "oa"), "a", "left").join(often.toDF("b", "ob"), "b", "left")
            pairs = counted.where(F.col("times") + F.least(F.coalesce("oa", F.lit(0)), F.coalesce("ob", F.lit(0))) >= least).select("a", "b")
            if groups is not None:
                pairs = pairs.join(groups.toDF("a", "ra"), "a", "left").join(groups.toDF("b", "rb"), "b", "left")
                pairs = pairs.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
        asked, _ = settle(pairs, f"{label}-pairs")
        if asked.isEmpty():
            continue
        found = verified(asked)
        links = found if links is None else links.union(found)
        groups, _ = settle(components(links, f"{label}-groups", small), f"{label}-roots")
    return live.sparkSession.createDataFrame([], "node bigint, root bigint") if groups is None else groups


def prefix_bound(n: int, similarity: float) -> int:
    """prefix_size of one size, for scans outside of Spark's expressions."""
    return n - math.ceil(round(similarity * n, 9)) + 1

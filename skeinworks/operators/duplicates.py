"""Duplicate numbering, near-duplicate pairs and the ordered consolidation of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, release
from .selection import group_rank

#: Vectors that the directions of the search grid are fitted on, and their number. Both change speed only.
DIRECTION_ROWS, DIRECTIONS = 2000, 3
#: Vectors of a block; two blocks are compared by one matrix product.
BLOCK = 1024


def number_duplicates(rows: DataFrame, scope: str, order: str, value: str, prefix: str, out: str) -> DataFrame:
    """Add ``out``: the number of each group of equal values with two members or more, else null.

    Groups of a scope are numbered in the order of their first member: the
    first members are aggregated (map-side combined), ranked by a distributed
    sort and joined back. Null and empty values are in no group.
    """
    valid = rows.where(F.col(value).isNotNull() & (F.col(value) != ""))
    groups = valid.groupBy(scope, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first")).where("n > 1")
    numbered = group_rank(groups, [scope], ["first", value], "__i", "__of").withColumn(out, F.format_string(f"{prefix}_%03d", F.col("__i") + 1)).select(F.col(scope).alias("__s"), F.col(value).alias("__v"), out)
    return rows.join(numbered, F.col(scope).eqNullSafe(F.col("__s")) & (F.col(value) == F.col("__v")), "left").drop("__s", "__v")


def near_pairs(vectors: DataFrame, threshold: float, key: str = "id", vector: str = "vector", scope: str | None = None, exclude: str | None = None, block: int = BLOCK) -> DataFrame:
    """``left, right, score`` of all pairs of unit vectors with a dot product of at least ``threshold``; exact.

    Unit vectors that alike lie within sqrt(2 - 2 threshold) of each other, and
    so do their projections on any unit direction. Vectors fall into cells of
    that width on a few directions; a vector is compared with the cells around
    its own only. Each cell is cut into blocks by a hash, and block pairs are
    compared by one matrix product each, so a hot cell is spread over many
    tasks of bounded size. ``scope`` (such as the image shape) must be equal,
    non-null values of ``exclude`` (such as an exact-duplicate group) must differ.

    Defined cases: null or zero vectors match nothing; vectors of another
    length belong to another cell; equal keys are not paired.
    """
    spark = vectors.sparkSession
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    lit = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.concat_ws("|", lit(scope), F.size(vector)).alias("scope"), lit(exclude).alias("ex"))
    rows = rows.where(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x) > 0.5)
    sample = rows.orderBy(F.xxhash64("id")).limit(DIRECTION_ROWS).select("v").toPandas()["v"].tolist()
    if not sample:
        return spark.createDataFrame([], f"left {vectors.schema[key].dataType.simpleString()}, right {vectors.schema[key].dataType.simpleString()}, score double")
    size = max(map(len, sample))
    stack = np.stack([np.asarray(x) for x in sample if len(x) == size])
    axes = np.linalg.svd(stack - stack.mean(0), full_matrices=False)[2][:DIRECTIONS]
    cells = [F.floor(F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in a]), lambda p, q: F.coalesce(p * q, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x) / reach).cast("int").alias(f"c{i}") for i, a in enumerate(axes)]
    placed = checkpointed(rows.select("id", "v", "scope", "ex", F.array(*cells).alias("cell")))
    sizes = placed.groupBy("scope", "cell").agg(F.count(F.lit(1)).alias("n"))
    blocks = placed.join(sizes, ["scope", "cell"]).withColumn("of", F.ceil(F.col("n") / block).cast("int")).withColumn("b", F.pmod(F.xxhash64("id"), F.col("of")).cast("int"))
    # each pair of neighbouring cells once: from the smaller cell to the greater, or within one cell
    steps = [s for s in np.ndindex(*(3,) * len(axes))]
    moves = F.array(*[F.array(*[F.lit(int(x) - 1) for x in s]) for s in steps])
    there = blocks.select("scope", F.col("cell").alias("a"), "b", "of", "id", "v", "ex")
    grid = sizes.select("scope", "cell", F.ceil(F.col("n") / block).cast("int").alias("of"))
    near = grid.select("scope", F.col("cell").alias("a"), F.col("of").alias("of_a"), F.explode(F.transform(moves, lambda m: F.zip_with(F.col("cell"), m, lambda p, q: p + q))).alias("cell"))
    near = near.where(F.col("a") <= F.col("cell")).join(grid, ["scope", "cell"])
    work = near.select("scope", "a", F.col("cell").alias("z"), F.explode(F.sequence(F.lit(0), F.col("of_a") - 1)).alias("ba"), "of").select("scope", "a", "z", "ba", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("bz"))
    work = work.where((F.col("a") != F.col("z")) | (F.col("ba") <= F.col("bz"))).withColumn("task", F.xxhash64("scope", "a", "z", "ba", "bz"))
    side = lambda cell, b, n: work.select("scope", F.col(cell).alias("a"), F.col(b).alias("b"), "task").join(there, ["scope", "a", "b"]).select("task", "id", "v", "ex", F.lit(n).alias("side"))
    both = side("a", "ba", 0).unionByName(side("z", "bz", 1))

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        l, r = f[f["side"] == 0], f[f["side"] == 1]  # noqa: E741
        score = np.stack(l["v"].to_list()) @ np.stack(r["v"].to_list()).T
        i, j = np.nonzero(score >= threshold)
        li, ri, le, re = l["id"].to_numpy()[i], r["id"].to_numpy()[j], l["ex"].to_numpy()[i], r["ex"].to_numpy()[j]
        keep = (li != ri) & ~np.asarray([x is not None and x == y for x, y in zip(le, re)], bool)
        li, ri, s = li[keep], ri[keep], score[i, j][keep]
        swap = li > ri
        return pd.DataFrame({"left": np.where(swap, ri, li), "right": np.where(swap, li, ri), "score": s})

    kind = vectors.schema[key].dataType.simpleString()
    found = both.groupBy("task").applyInPandas(lambda f: compare(f) if f["side"].nunique() == 2 else pd.DataFrame({"left": [], "right": [], "score": []}), f"left {kind}, right {kind}, score double")
    return found.groupBy("left", "right").agg(F.max("score").alias("score"))


def linked(edges: DataFrame) -> DataFrame:
    """``x, root``: the smallest vertex of each component of ``a, b`` (strings), by alternating star operations.

    A vertex hands its greater neighbours to its smallest one, then its
    smaller ones, in turn; the rounds grow with the logarithm of a chain's
    length. Minima are combined map-side. Edges that change nothing are all
    that is left at the end.
    """
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        stars = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        done, edges = edges, checkpointed(stars)
        moved = edges.exceptAll(done).limit(1).count() + done.exceptAll(edges).limit(1).count()
        release(done)
        if not moved:
            return edges.select(F.col("u").alias("x"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("x"), F.col("v").alias("root")).distinct())


def fold_pairs(pairs: DataFrame, scope: str, prefix: str) -> DataFrame:
    """``scope, id, group, score``: groups given to pairs one after the other, the later pair overwriting.

    Pairs ``scope, i, j, left, right, score`` are taken in the order of the
    positions i, j. A pair takes the group of its left member, else of its
    right one, else a new number; both members get it and the pair's score.
    The order matters and groups may split, unlike connected components, but
    pairs of different components never meet: each component is folded apart,
    its groups named by the pair that began them, and these are numbered by a
    distributed rank of those pairs.

    Defined cases: no pairs give no rows; null ends are no pair; a pair of an
    id with itself groups that id alone.
    """
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    pairs = checkpointed(pairs.where(F.col("left").isNotNull() & F.col("right").isNotNull()))
    name = lambda c: F.concat_ws("\x00", F.col(scope).cast("string"), F.col(c).cast("string"))
    roots = linked(pairs.select(name("left").alias("a"), name("right").alias("b")))
    placed = pairs.withColumn("x", name("left")).join(roots, "x", "left").withColumn("root", F.coalesce("root", "x")).drop("x")

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        begun, score = {}, {}
        for k, r in enumerate(f.sort_values(["i", "j"], kind="stable").itertuples(index=False)):
            g = begun.get(r.left, begun.get(r.right, (r.i, r.j)))
            for x in (r.left, r.right):
                begun[x], score[x] = g, r.score
        return pd.DataFrame({scope: [f[scope].iloc[0]] * len(begun), "id": list(begun), "bi": [g[0] for g in begun.values()], "bj": [g[1] for g in begun.values()], "score": [score[x] for x in begun]})

    folded = checkpointed(placed.groupBy("root").applyInPandas(lambda f: fold(f), f"{scope} {kinds[scope]}, id {kinds['left']}, bi {kinds['i']}, bj {kinds['j']}, score double"))
    begins = group_rank(folded.select(scope, "bi", "bj").distinct(), [scope], ["bi", "bj"], "k", "of").select(F.col(scope).alias("s"), F.col("bi").alias("p"), F.col("bj").alias("q"), "k")
    named = folded.join(begins, F.col(scope).eqNullSafe(F.col("s")) & F.col("bi").eqNullSafe(F.col("p")) & F.col("bj").eqNullSafe(F.col("q")))
    return named.select(scope, "id", F.format_string(f"{prefix}_%03d", F.col("k") + 1).alias("group"), "score")

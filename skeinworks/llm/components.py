"""Problem 3: pairwise matches consolidated into groups on a two-dimensional grid."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spelling as S
from ..operators.kernels import min_roots
from ..session import checkpointed, release, small, table
from .common import image_rows

SCORE = 0.995
#: Edges that a grid cell should hold on average.
CELL_EDGES = 500_000
#: Blocks of vertices at least, so that small graphs are laid out the same way.
LEAST_BLOCKS = 2
#: The random priority before each vertex: a fixed-width hash, so text order is priority order.
_WIDTH = 16


def _block(frame: pd.DataFrame) -> pd.DataFrame:
    codes, names = pd.factorize(pd.concat([frame["u"], frame["v"]], ignore_index=True), sort=True)
    m = len(frame)
    root = min_roots(codes[:m], codes[m:], len(names))
    names = np.asarray(names, dtype=object)
    return pd.DataFrame({"x": names, "root": names[root]})


def named(c: Column) -> Column:
    """Vertex name with its random priority in front."""
    return F.concat(F.lpad(F.hex(F.xxhash64(c, F.lit(17))), _WIDTH, "0"), c)


def grid_round(edges: DataFrame, blocks: int, turn: int, cell_edges: int) -> DataFrame:
    """Union-find in every cell of the grid; ``x, m, roots``: a vertex, its least root and all its roots.

    A cell has the edges between two blocks of vertices. One with more than
    twice ``cell_edges``, as in the row of a hot vertex, is cut into parts,
    whose representatives are exchanged like those of other cells; of such
    cells there are at most edges / (2 x cell_edges). A vertex lies in no more
    cells and parts than its edges, or a row of the grid and its parts, so
    the exchange collects no more representatives than that for it.
    """
    place = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(blocks))
    r, c = place("u"), place("v")
    laid = edges.select("u", "v", (F.least(r, c) * blocks + F.greatest(r, c)).alias("cell"))
    full = laid.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * cell_edges).select("cell", F.ceil(F.col("n") / cell_edges).alias("parts"))
    laid = laid.join(small(checkpointed(full)), "cell", "left")
    part = F.pmod(F.xxhash64("u", "v"), F.coalesce("parts", F.lit(1)))
    roots = laid.select("u", "v", "cell", part.alias("part")).groupBy("cell", "part").applyInPandas(lambda f: _block(f), "x string, root string")
    return roots.groupBy("x").agg(F.min("root").alias("m"), F.collect_set("root").alias("roots"))


def connected_components(edges: DataFrame, cell_edges: int = CELL_EDGES, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """``vertex, root`` for each vertex of ``edges`` (columns ``u, v``); all of one component share a root.

    Vertices are hashed into blocks, anew in each round; the edges between two
    blocks form one grid cell, and there are as many blocks as make a cell
    hold ``cell_edges`` on average. Every cell is reduced to its local
    representatives by union-find, the representatives of a vertex are
    exchanged over its row and column, and the remaining edges link only
    representatives. A vertex that represents nothing leaves with its parent;
    the order is a random priority, so a constant share leaves in each round
    whatever the numbering. The rounds end when no edge is left: each vertex
    then has one representative. Parents are resolved backwards. Rounds are
    cut by reliable checkpoints; only counts reach the driver.

    Defined cases: null ends and self pairs link nothing, repeated and reversed
    pairs count once, no edges give no rows, other columns are ignored.
    """
    named_ends = edges.select(named(F.col("u").cast("string")).alias("a"), named(F.col("v").cast("string")).alias("b"))
    left = checkpointed(named_ends.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    count, rounds = left.count(), []
    while count:
        blocks = max(least_blocks, math.ceil(math.sqrt(2 * count / cell_edges)))
        found = checkpointed(grid_round(left, blocks, len(rounds), cell_edges))
        rounds.append(found.select("x", "m"))
        rest = found.where(F.size("roots") > 1).select(F.explode("roots").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        done, left = left, checkpointed(rest)
        release(done)
        count = left.count()
    if not rounds:
        return edges.select(F.col("u").cast("string").alias("vertex"), F.col("u").cast("string").alias("root")).limit(0)
    label = rounds[-1].select("x", F.col("m").alias("root"))
    for links in reversed(rounds[:-1]):
        up = label.select(F.col("x").alias("m"), "root")
        label = links.join(up, "m", "left").select("x", F.coalesce("root", "m").alias("root"))
    real = lambda c: F.expr(f"substring({c}, {_WIDTH + 1})")
    return label.select(real("x").alias("vertex"), real("root").alias("root"))


def image_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the image graph: matching pairs, and each image to its candidate group (a star, never all pairs)."""
    images = image_rows(spark, sf_dir)
    ids = images.select("stable_image_id").distinct()
    score = F.col("near_duplicate_score")
    pairs = table(spark, sf_dir, "near_duplicate_pairs").where((score >= SCORE) & ~F.isnan(score))
    pairs = pairs.select(S.image_id("left_stable_image_id").alias("u"), S.image_id("right_stable_image_id").alias("v")).where("u <> v").distinct()
    for end in ("u", "v"):
        pairs = pairs.join(ids.withColumnRenamed("stable_image_id", end), end, "left_semi")
    stars = images.where("near_group IS NOT NULL").select(F.concat(F.lit("r:"), "stable_image_id").alias("u"), F.concat(F.lit("g:"), "near_group").alias("v")).distinct()
    return pairs.select(F.concat(F.lit("r:"), "u").alias("u"), F.concat(F.lit("r:"), "v").alias("v")).unionByName(stars)


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stable_image_id, group_id, n`` of the images in the graph; n counts the group's images."""
    label = connected_components(image_links(spark, sf_dir)).where(F.col("vertex").startswith("r:"))
    label = checkpointed(label.select(F.expr("substring(vertex, 3)").alias("stable_image_id"), "root"))
    groups = label.groupBy("root").agg(F.min("stable_image_id").alias("group_id"), F.count(F.lit(1)).alias("n"))
    return label.join(groups, "root").select("stable_image_id", "group_id", "n")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image linked to another, with the smallest id of its group."""
    return p3_links(spark, sf_dir).where("n > 1").select("stable_image_id", "group_id")


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group identifier for every image; an image linked to none is its own group."""
    ids = image_rows(spark, sf_dir).select("stable_image_id").distinct()
    return ids.join(p3_found(spark, sf_dir), "stable_image_id", "left").select("stable_image_id", F.coalesce("group_id", "stable_image_id").alias("group_id"))

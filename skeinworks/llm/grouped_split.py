"""Problem 4: train, validation and test splits that keep related records together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spelling as S
from ..session import checkpointed, release, small, table
from .common import cumulative_before, current_splits

SEED = 41
#: A share further from its target than this counts as a violation in p4_violations.
SHARE_ERROR = 0.01


def _number(name: Column, seed: int) -> Column:
    return F.xxhash64(name, F.lit(seed))


def _scattered(x: Column) -> Column:
    """Another number for each 64-bit number, without order: every step can be undone, so no two get the same."""
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def _jumped(up: DataFrame) -> DataFrame:
    """Parents ``c, p`` and the parents' parents ``q``."""
    return up.join(up.select(F.col("c").alias("p"), F.col("p").alias("q")), "p").select("c", "p", "q")


def contracted(names: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(tree edges ``a, b``, labels ``x, root``, seed) of the graph with vertices ``name`` and edges ``u, v``, by numbers.

    A vertex is its name's 64-bit hash: numbers are shuffled instead of names
    and all aggregates are hash aggregates. Were two names to share a hash,
    which a count rules out, the next seed is taken.

    Each component picks its lightest outgoing edge (weights are scattered row
    numbers, so all differ). An edge picked from both sides makes the smaller
    side the root; components are contracted along the picks by pointer
    jumping, and edges inside a component are dropped and parallel ones
    merged. The number of components at least halves per round, until no edge
    is left, at every size. A hot component's pick is a map-side combined
    minimum; the joins are sort-merge joins that AQE splits.
    """
    seed = SEED
    while names.groupBy(_number(F.col("name"), seed).alias("x")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        seed += 1
    pairs = edges.select(_number(F.col("u"), seed).alias("x"), _number(F.col("v"), seed).alias("y")).where("x <> y")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    whole = checkpointed(pairs.select(F.monotonically_increasing_id().alias("e"), "a", "b")).select(_scattered(F.col("e") + 1).alias("w"), "a", "b")
    left, trees, steps = whole.select("w", F.col("a").alias("cu"), F.col("b").alias("cv")), [], []
    held: DataFrame | None = None
    while left.limit(1).count():
        best = left.select(F.explode(F.array("cu", "cv")).alias("c"), "w").groupBy("c").agg(F.min("w").alias("w"))
        picked = checkpointed(best.groupBy("w").agg(F.min("c").alias("c"), F.max("c").alias("d")).join(left, "w"))
        trees.append(picked.select("w"))
        both = F.col("c") != F.col("d")
        to = F.when(both, F.col("c")).when(F.col("c") == F.col("cu"), F.col("cv")).otherwise(F.col("cu"))
        up = picked.select(F.explode(F.when(both, F.array(F.struct("c", F.col("c").alias("p")), F.struct(F.col("d").alias("c"), F.col("c").alias("p")))).otherwise(F.array(F.struct("c", to.alias("p"))))).alias("x")).select("x.c", "x.p")
        old = None
        while True:
            jumped = checkpointed(_jumped(_jumped(up).select("c", F.col("q").alias("p"))))
            if old is not None:
                release(old)
            old, moved, up = jumped, jumped.where("p <> q").limit(1).count(), jumped.select("c", F.col("q").alias("p"))
            if not moved:
                break
        steps.append(up)
        root = lambda x: up.select(F.col("c").alias(x), F.col("p").alias("n" + x))  # noqa: B023, E731
        merged = left.join(root("cu"), "cu").join(root("cv"), "cv").where("ncu <> ncv").groupBy(F.least("ncu", "ncv").alias("cu"), F.greatest("ncu", "ncv").alias("cv")).agg(F.min("w").alias("w"))
        left = checkpointed(merged.select("w", "cu", "cv"))
        if held is not None:
            release(held)
        held = left
    if not steps:
        return whole.select("a", "b"), whole.select(F.col("a").alias("x"), F.col("b").alias("root")), seed
    label = steps[-1]
    for up in reversed(steps[:-1]):
        higher = label.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        label = up.join(higher, "p", "left").select("c", F.coalesce("pp", "p").alias("p"))
    return whole.join(reduce(DataFrame.unionByName, trees), "w", "left_semi").select("a", "b"), label.select(F.col("c").alias("x"), F.col("p").alias("root")), seed


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forest, labels) of the graph with edges ``u, v``: forest ``u, v``; labels ``vertex, root`` (see ``contracted``).

    The rounds' picks are checkpointed: the forest is that table with its names.

    Defined cases: null ends and self edges link nothing, repeated and
    reversed edges count once, an empty graph gives two empty results.
    """
    ends = edges.select(F.col("u").cast("string").alias("u"), F.col("v").cast("string").alias("v")).where("u <> v")
    names = checkpointed(ends.select(F.explode(F.array("u", "v")).alias("name")).distinct())
    trees, label, seed = contracted(names, ends)
    named = lambda x, name: names.select(_number(F.col("name"), seed).alias(x), F.col("name").alias(name))
    forest = trees.join(named("a", "u"), "a").join(named("b", "v"), "b").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return forest, label.join(named("x", "vertex"), "x").join(named("root", "top"), "root").select("vertex", F.col("top").alias("root"))


def blocks_of(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, blocks, forest) of records ``stable_image_id, groups, eligibility, synthetic_split``.

    Without ``groups`` they are those of the columns ``bio`` and ``acq``.
    members: ``stable_image_id, vertex``; blocks: ``vertex, block_id, n, torn``
    for each vertex; the graph has groups as vertices and the distinct edges
    from the first group of a record to its others, so a group with a third
    of all records is one vertex and its rows are aggregated map-side.
    """
    groups = F.col("groups") if "groups" in records.columns else F.array_compact(F.array(F.concat(F.lit("b:"), "bio"), F.concat(F.lit("a:"), "acq")))
    records = checkpointed(records.select("stable_image_id", groups.alias("groups"), "eligibility", "synthetic_split"))  # read several times below
    first = F.get("groups", F.lit(0))
    pairs = records.where(F.size("groups") > 1).select(first.alias("u"), F.explode(F.slice("groups", F.lit(2), F.size("groups"))).alias("v"))
    members = records.withColumn("vertex", F.coalesce(first, F.concat(F.lit("r:"), "stable_image_id")))
    per = members.groupBy("vertex").agg(
        F.min("stable_image_id").alias("first"), F.count(F.lit(1)).alias("n"),
        F.min(F.least("eligibility", "synthetic_split")).alias("low"), F.max(F.greatest("eligibility", "synthetic_split")).alias("high"),
    )
    per = checkpointed(per)
    names = per.select(F.col("vertex").alias("name")).unionByName(pairs.select(F.col("v").alias("name"))).distinct()
    trees, label, seed = contracted(names, pairs)
    per = per.withColumn("x", _number(F.col("vertex"), seed)).join(label, "x", "left").withColumn("root", F.coalesce("root", "x"))
    whole = per.groupBy("root").agg(F.min("first").alias("block_id"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    blocks = checkpointed(per.select("vertex", "root").join(whole, "root").select("vertex", "block_id", "n", F.coalesce(F.col("low") != F.col("high"), F.lit(False)).alias("torn")))
    named = lambda x, name: names.select(_number(F.col("name"), seed).alias(x), F.col("name").alias(name))
    forest = trees.join(named("a", "u"), "a").join(named("b", "v"), "b").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return members.select("stable_image_id", "vertex"), blocks, forest


def deal_blocks(blocks: DataFrame, targets: list[tuple[str, float]], seed: int = SEED) -> DataFrame:
    """Deal blocks (``block_id, n``) to splits in the shares of ``targets``; ``block_id, n, split``.

    Blocks are stratified into size bands (powers of two, at most 63). From
    the band of the largest on, each is dealt systematically along a hash
    order: a split takes the blocks whose middle lies in its part of the band,
    and the parts are what the splits are still short of after the bands
    before. A block of a third of all records is thus dealt like any other,
    and smaller ones make up for it. The running sums are distributed
    (``cumulative_before``); a row per split and band reaches the driver.

    Defined cases: no targets is an error; shares are normalised; no blocks
    give no rows; equal hashes are ordered by block id.
    """
    whole = sum(max(0.0, s) for _, s in targets)
    if not whole > 0:
        raise ValueError("split targets need a positive share")
    share = {name: max(0.0, s) / whole for name, s in sorted(targets)}
    rows = blocks.select("block_id", "n").withColumn("band", F.floor(F.log2("n")).cast("int"))
    key = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), "block_id"), 256), 1, 15), 16, 10).cast("long")
    rows = checkpointed(cumulative_before(rows, ["band"], F.shiftleft(key, 4), "block_id", F.col("n")))
    sizes = {r["band"]: r["size"] for r in rows.groupBy("band").agg(F.sum("n").alias("size")).collect()}
    got, upto, split = dict.fromkeys(share, 0), 0, F.lit(None).cast("string")
    for band in sorted(sizes, reverse=True):
        upto += sizes[band]
        open_ = {name: max(0.0, share[name] * upto - got[name]) for name in share}
        scale, edge, names = sizes[band] / (sum(open_.values()) or 1.0), 0.0, list(share)
        here = F.lit(max(names, key=lambda x: (open_[x], x)))
        middle = F.col("before") + F.col("n") / 2
        edges = []
        for name in names:
            edge += open_[name] * scale
            edges.append((name, edge))
        for name, at in reversed(edges):
            if open_[name] > 0:
                here = F.when(middle < at, F.lit(name)).otherwise(here)
        split = F.when(F.col("band") == band, here).otherwise(split)
        for r in rows.where(F.col("band") == band).groupBy(here.alias("s")).agg(F.sum("n").alias("n")).collect():
            got[r["s"]] += r["n"]
    return rows.select("block_id", "n", split.alias("split"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of blocks that stand in more than one split today."""
    members, blocks, _ = blocks_of(current_splits(spark, sf_dir))
    return members.join(blocks.where("torn"), "vertex").select("stable_image_id", "block_id")


def p4_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spanning forest over biological and acquisition groups."""
    return blocks_of(current_splits(spark, sf_dir))[2]


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new split of every record, whole blocks together."""
    members, blocks, _ = blocks_of(current_splits(spark, sf_dir))
    rows = table(spark, sf_dir, "split_targets").select(S.role("split").alias("split"), "target_share").where("split IS NOT NULL").groupBy("split").agg(F.max("target_share").alias("s"))
    targets = [(r["split"], r["s"]) for r in rows.collect()]  # a fixed table of four rows
    dealt = deal_blocks(blocks.select("block_id", "n").distinct(), targets)
    return members.join(blocks.select("vertex", "block_id"), "vertex").join(dealt.select("block_id", "split"), "block_id").select("stable_image_id", "block_id", "split")


def p4_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block with its records and whether it is torn today."""
    _, blocks, _ = blocks_of(current_splits(spark, sf_dir))
    return blocks.select("block_id", "n", "torn").distinct()


def p4_forest_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices, edges and trees of the persisted forest: a tree has an edge less than vertices."""
    forest = p4_forest(spark, sf_dir)
    ends = forest.select(F.explode(F.array("u", "v")).alias("x")).distinct()
    _, label = spanning_forest(forest)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(ends, "n_vertices").crossJoin(count(forest, "n_edges")).crossJoin(count(label.select("root").distinct(), "n_trees"))


def p4_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that the new splits break: a record dealt not at all or twice, a block in two splits, a share off by a block of the last band or more."""
    records = current_splits(spark, sf_dir).select("stable_image_id")
    dealt = checkpointed(p4_splits(spark, sf_dir))
    per = dealt.groupBy("stable_image_id").agg(F.count(F.lit(1)).alias("n"))
    lost = records.join(per, "stable_image_id", "full").where(F.coalesce("n", F.lit(0)) != 1).select(F.lit("record").alias("rule"), F.col("stable_image_id").alias("entity"))
    torn = dealt.groupBy("block_id").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b").select(F.lit("block").alias("rule"), F.col("block_id").alias("entity"))
    shares = p4_shares(spark, sf_dir).where(F.abs(F.col("share") - F.col("target_share")) > SHARE_ERROR).select(F.lit("share").alias("rule"), F.col("split").alias("entity"))
    return lost.unionByName(torn).unionByName(shares)


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each split."""
    got = p4_splits(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("block_id").alias("n_blocks"))
    total = small(got).groupBy().agg(F.sum("n_records").alias("total"))
    targets = table(spark, sf_dir, "split_targets").select(S.role("split").alias("split"), "target_share")
    return targets.join(got, "split", "left").crossJoin(F.broadcast(total)).select(
        "split", "target_share", F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), (F.coalesce("n_records", F.lit(0)) / F.col("total")).alias("share")
    )

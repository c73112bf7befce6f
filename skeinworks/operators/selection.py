"""Deterministic subsets, representatives and grouped aggregates of measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed, small

def global_rank(rows: DataFrame, order: list[str], out: str = "rank") -> DataFrame:
    """Add the 0-based position in a total order without a single-task window.

    Range partitioning puts the rows in order over many tasks; the number of
    rows before each partition (one number per task) is added to the position
    within it. Ties in ``order`` get different, arbitrary positions, so the
    order should be total.
    """
    placed = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    part, inside = F.shiftrightunsigned("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__p", "__before")
    return placed.join(F.broadcast(before), part == F.col("__p")).withColumn(out, F.col("__before") + inside).drop("__m", "__p", "__before")


def running_sum(rows: DataFrame, order: list[str], weight: str, out: str) -> DataFrame:
    """Add the sum of ``weight`` over all rows up to each one in a total order, without a single-task window."""
    placed = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()))
    sums = placed.groupBy(F.col("__p").alias("__q")).agg(F.sum(weight).alias("__s"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__s").over(W.orderBy("__q").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("__q", "__before")  # a row per task
    inside = F.sum(weight).over(W.partitionBy("__p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return placed.join(F.broadcast(before), F.col("__p") == F.col("__q")).withColumn(out, F.col("__before") + inside).drop("__p", "__q", "__before")


def spaced_subset(rows: DataFrame, key: str, count: int) -> DataFrame:
    """``count`` rows at even places of the order by ``key``, first and last included; all rows if there are no more.

    The wanted positions are computed from the row count; only they are
    joined to the distributed rank, and they are few by definition.
    """
    n = rows.count()
    if count <= 0 or n <= count:
        return rows
    wanted = rows.sparkSession.range(count).select(F.floor(F.col("id") * ((n - 1) / max(1, count - 1))).cast("long").alias("rank")).distinct()
    return global_rank(rows, [key]).join(F.broadcast(wanted), "rank", "left_semi").drop("rank")


def first_rows(rows: DataFrame, key: str, count: int) -> DataFrame:
    """The first ``count`` rows by key; ValueError when there are fewer."""
    top = rows.orderBy(key).limit(count)
    have = top.count()
    if have < count:
        raise ValueError(f"not enough rows: need {count}, found {have}")
    return top


def must_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join in which every left key must be found; KeyError with examples otherwise. One join serves both."""
    joined = checkpointed(left.join(right.withColumn("__found", F.lit(True)), key, "left"))
    lost = joined.where("__found IS NULL").select(key).limit(5).collect()
    if lost:
        raise KeyError(f"keys without a match: {[r[0] for r in lost]}")
    return joined.drop("__found")


def group_rank(rows: DataFrame, group: list[str], order: list[str], out: str = "rank", size: str = "size") -> DataFrame:
    """Add the 0-based position within each group and the group's size, from the rank over all rows.

    A group may hold any share of the rows: it spans as many tasks as the range
    partitioning gives it. Null group values are a group; ties get different,
    arbitrary positions.
    """
    ranked = checkpointed(global_rank(rows, [*group, *order], "__rank"))
    names = [f"__g{i}" for i in range(len(group))]
    starts = ranked.groupBy(*[F.col(c).alias(n) for c, n in zip(group, names)]).agg(F.min("__rank").alias("__start"), F.count(F.lit(1)).alias(size))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(group, names)])
    return ranked.join(small(checkpointed(starts)), same).withColumn(out, F.col("__rank") - F.col("__start")).drop("__rank", "__start", *names)


def representatives(rows: DataFrame, scope: list[str], key: str, middle: str, top: str) -> DataFrame:
    """Per scope up to three rows: smallest key, middle by one measure, greatest by another; repeated ones once.

    The middle is position n // 2 in (measure, key) order; ties of the greatest
    go to the last key; nulls are smallest. ``reason`` is the first that holds.
    One distributed sort ranks all scopes; the other two are combined map-side.
    """
    ranked = checkpointed(group_rank(rows, scope, [middle, key], "__at", "__n"))
    names = [f"__s{i}" for i in range(len(scope))]
    ends = ranked.groupBy(*[F.col(c).alias(n) for c, n in zip(scope, names)]).agg(F.min(F.struct(key, "__at")).alias("__low"), F.max(F.struct(top, key, "__at")).alias("__high"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(scope, names)])
    reason = F.when(F.col("__at") == F.col("__low.__at"), "first").when(F.col("__at") == F.floor(F.col("__n") / 2), "middle").when(F.col("__at") == F.col("__high.__at"), "top")
    return ranked.join(small(checkpointed(ends)), same).withColumn("reason", reason).where("reason IS NOT NULL").drop("__at", "__n", "__low", "__high", *names)


def measure_summary(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Median, IQR, 5th and 95th percentile per group and field in long form; texts that are no number are skipped.

    Exact, interpolated between neighbours. Equal values are counted first
    (map-side), the counts are summed along a distributed order of the values,
    and only the two neighbours of each percentile are kept of it, so no buffer
    holds the values of a group.
    """
    ps = [0.5, 0.25, 0.75, 0.05, 0.95]
    stack = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.expr(f"try_cast(`{f}` AS double)").alias("v")) for f in fields]))
    group = [*keys, "field"]
    counts = rows.select(*keys, stack.alias("x")).select(*keys, "x.field", "x.v").where(F.col("v").isNotNull()).groupBy(*group, "v").agg(F.count(F.lit(1)).alias("__c"))
    summed = checkpointed(running_sum(counts, [*group, "v"], "__c", "__upto"))
    names = [f"__k{i}" for i in range(len(group))]
    whole = summed.groupBy(*[F.col(c).alias(n) for c, n in zip(group, names)]).agg(F.sum("__c").alias("__n"), F.min(F.col("__upto") - F.col("__c")).alias("__start"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(group, names)])
    placed = summed.join(small(checkpointed(whole)), same).withColumn("__last", F.col("__upto") - F.col("__start") - 1)
    covers = lambda at: (at <= F.col("__last")) & (at > F.col("__last") - F.col("__c"))
    value = []
    for p in ps:
        at = (F.col("__n") - 1) * F.lit(p)
        low, part = F.floor(at), at - F.floor(at)
        near = [F.max(F.when(covers(x), F.col("v"))) for x in (low, F.ceil(at))]
        value.append((near[0], near[1], F.max(part)))
    marks = reduce(lambda x, y: x | y, [covers(x) for p in ps for x in (F.floor((F.col("__n") - 1) * F.lit(p)), F.ceil((F.col("__n") - 1) * F.lit(p)))])
    got = placed.where(marks).groupBy(*group).agg(*[x.alias(f"__{i}{j}") for i, three in enumerate(value) for j, x in enumerate(three)])
    q = [F.when(F.col(f"__{i}0") == F.col(f"__{i}1"), F.col(f"__{i}0")).otherwise(F.col(f"__{i}0") * (1 - F.col(f"__{i}2")) + F.col(f"__{i}1") * F.col(f"__{i}2")) for i in range(len(ps))]
    return got.select(*group, q[0].alias("median"), (q[2] - q[1]).alias("iqr"), q[3].alias("p05"), q[4].alias("p95"))


def group_differences(summary: DataFrame, group: str, base: str, others: list[str]) -> DataFrame:
    """Median of each other group minus that of the base group, per field that both have."""
    b = summary.where(F.col(group) == base).select("field", F.col("median").alias("base"))
    return summary.where(F.col(group).isin(others)).join(b, "field").select("field", group, (F.col("median") - F.col("base")).alias("difference"))


def median_table(summary: DataFrame, group: str, groups: list[str]) -> DataFrame:
    """One row per field and a median column per group, null where a group lacks the field."""
    return summary.groupBy("field").pivot(group, groups).agg(F.first("median"))


def complete_set(rows: DataFrame, scope: str, value: str, wanted: DataFrame) -> DataFrame:
    """Wanted values that are missing and values that are not wanted, per scope: ``scope, value, problem``."""
    have, want = rows.select(scope, value).distinct(), wanted.select(scope, value).distinct()
    missing = want.join(have, [scope, value], "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(have.join(want, [scope, value], "left_anti").withColumn("problem", F.lit("unexpected")))

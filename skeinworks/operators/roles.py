"""Group-wise roles, their leakage checks and stratum reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The roles of the first groups when there are one, two, three or more groups.
ROLES_BY_COUNT = {1: ["calibration"], 2: ["calibration", "held_out_test"], 3: ["training", "validation", "held_out_test"], 4: ["training", "validation", "held_out_test", "calibration"]}
REST_ROLE = "training"


def allocate_roles(rows: DataFrame, group: str, scope: str | None = None) -> DataFrame:
    """Add ``role``: the roles of the first groups by name, the rest training; all rows of a group share it.

    The rank of a group matters only among the first four, so no task ranks
    all groups: each keeps its own four smallest per scope before the shuffle
    (the limit on the row number is pushed below it).
    """
    s = F.col(scope) if scope else F.lit(0)
    names = rows.select(s.alias("__s"), F.col(group).alias("__g")).where("__g IS NOT NULL").distinct()
    top = names.withColumn("__r", F.row_number().over(W.partitionBy("__s").orderBy("__g"))).where("__r <= 4")
    first = top.groupBy("__s").agg(F.array_sort(F.collect_list("__g")).alias("firsts")).withColumnRenamed("__s", "__fs")
    role = F.lit(None).cast("string")
    for n, roles in ROLES_BY_COUNT.items():
        at = F.array_position("firsts", F.col(group))
        named = F.when(at > 0, F.element_at(F.array(*[F.lit(r) for r in roles]), at.cast("int"))).otherwise(F.lit(REST_ROLE))
        role = F.when(F.size("firsts") == n, named).otherwise(role)
    joined = rows.withColumn("__s", s).join(F.broadcast(first) if not scope else first, F.col("__s").eqNullSafe(F.col("__fs")), "left")
    return joined.withColumn("role", F.when(F.col(group).isNotNull(), role)).drop("__s", "__fs", "firsts")


#: The published reason of each role, and of any other.
REASONS = {
    "training": "provisional PN-level training allocation",
    "validation": "provisional PN-level validation allocation",
    "held_out_test": "provisional PN-level primary held-out test allocation",
    "calibration": "provisional PN-level calibration allocation",
}
OTHER_REASON = "provisional PN-level allocation"


def role_reason(role: Column) -> Column:
    """Text that says at which level a role was given."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])[role], F.lit(OTHER_REASON))


def leaking_groups(rows: DataFrame, group: str, role: str, where: Column | None = None) -> DataFrame:
    """Groups that stand in more than one role, with their sorted roles."""
    rows = rows if where is None else rows.where(where)
    return rows.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(role)), ";").alias("roles"), F.countDistinct(role).alias("n_roles")).where("n_roles > 1").select(group, "roles")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: ``key, side``; both directions in one pass over the joined aggregate."""
    both = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return both.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r")).where("l + r = 1").select(key, F.when(F.col("l") == 1, "left").otherwise("right").alias("side"))


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys with more than one row, with their count."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def group_members(rows: DataFrame, keys: list[str], lists: dict[str, str]) -> DataFrame:
    """Per group the number of rows and the sorted distinct values of some columns."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[F.array_join(F.array_sort(F.collect_set(c)), ";").alias(a) for a, c in lists.items()])


def flag_counts(rows: DataFrame, flags: str, none: str = "none") -> DataFrame:
    """Frequency of each flag; rows without one count as ``none``."""
    filled = F.when(F.size(F.coalesce(F.col(flags), F.array().cast("array<string>"))) > 0, F.col(flags)).otherwise(F.array(F.lit(none)))
    return rows.select(F.explode(filled).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def strata_report(rows: DataFrame, levels: list[list[str]], group: str, least: int = 3) -> DataFrame:
    """Rows and distinct groups for several groupings in one pass (grouping sets).

    Columns that a level doesn't group by are null; ``level`` is its number
    and ``thin`` marks strata of fewer than ``least`` groups.
    """
    names = list(dict.fromkeys(c for level in levels for c in level))
    grouped = rows.groupingSets([[F.col(c) for c in level] for level in levels], *[F.col(c) for c in names]).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(group).alias("n_groups"), *[F.grouping(c).alias(f"__g{i}") for i, c in enumerate(names)])
    level = F.lit(None).cast("int")
    for i, cols in enumerate(levels):
        hit = F.lit(True)
        for j, c in enumerate(names):
            hit = hit & (F.col(f"__g{j}") == (0 if c in cols else 1))
        level = F.when(hit, F.lit(i)).otherwise(level)
    return grouped.select(level.alias("level"), *names, "n_rows", "n_groups", (F.col("n_groups") < least).alias("thin"))

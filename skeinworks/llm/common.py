"""Clean record tables and distributed prefix sums shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import spelling as S
from ..session import table

#: Fixed value: splits whose records must not occur in training.
EVALUATION_SPLITS = ["validation", "held_out_test"]


def image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sted_images with clean keys; rows without an id are no record."""
    df = table(spark, sf_dir, "sted_images").select(
        S.image_id("stable_image_id").alias("stable_image_id"),
        "source_root_id",
        S.sha256("pixel_sha256").alias("pixel"),
        S.key("near_duplicate_candidate_group").alias("near_group"),
        S.condition("inferred_condition").alias("condition"),
        S.div("inferred_div").alias("div"),
        S.key("biological_group_candidate").alias("bio"),
        "ingested_at",
    )
    return df.where(F.col("stable_image_id").isNotNull())


def current_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per id of sted_splits: its latest row (ties: the greatest roles) and its groups.

    ``groups`` has every group that any row of the id names, biological ones
    (``b:``) first; their number is bounded by the rows of one id.
    """
    df = table(spark, sf_dir, "sted_splits").select(
        S.image_id("stable_image_id").alias("stable_image_id"),
        S.key("biological_group_candidate").alias("bio"),
        S.key("acquisition_group").alias("acq"),
        S.role("eligibility").alias("eligibility"),
        S.role("synthetic_split").alias("synthetic_split"),
        "assigned_at",
    )
    named = lambda kind, c: F.transform(F.array_sort(c), lambda x: F.concat(F.lit(kind), x))
    return (
        df.where(F.col("stable_image_id").isNotNull())
        .groupBy("stable_image_id")
        .agg(
            F.max(F.struct(F.col("assigned_at").isNotNull().alias("k"), "assigned_at", "eligibility", "synthetic_split")).alias("now"),
            F.collect_set("bio").alias("bios"),
            F.collect_set("acq").alias("acqs"),
        )
        .select("stable_image_id", F.concat(named("b:", "bios"), named("a:", "acqs")).alias("groups"), F.col("now.eligibility").alias("eligibility"), F.col("now.synthetic_split").alias("synthetic_split"))
    )


def cumulative_before(df: DataFrame, by: list[str], order: Column, tie: str, weight: Column, out: str = "before", bits: int = 12) -> DataFrame:
    """Add the sum of ``weight`` over the rows before each row, per ``by``, in (order, tie) order.

    ``order`` must be a hash (a long spread over its whole range). Instead of
    one window per group, which would pull a hot group into one task, rows
    fall into ``2**bits`` ranges of the hash: the ranges' sums are aggregated
    map-side, their running sum is a small table, and only rows of one range
    are sorted together. The shuffle by (by, range) serves join and window.

    Null weights count as 0; null ``by`` values form a group of their own.
    """
    h, b, w = "__h", "__b", "__w"
    keyed = df.withColumn(h, order).withColumn(b, F.shiftrightunsigned(h, 64 - bits)).withColumn(w, F.coalesce(weight, F.lit(0)))
    names = [f"__k{i}" for i in range(len(by))]
    ranges = keyed.groupBy(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col(b).alias("__rb")).agg(F.sum(w).alias("__s"))
    upto = W.partitionBy(*names).orderBy("__rb").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("__o", F.coalesce(F.sum("__s").over(upto), F.lit(0)))
    cond = F.col(b) == F.col("__rb")
    for c, n in zip(by, names):
        cond = cond & F.col(c).eqNullSafe(F.col(n))
    joined = keyed.join(ranges, cond)
    inside = W.partitionBy(*by, b).orderBy(h, tie).rowsBetween(W.unboundedPreceding, -1)
    before = F.col("__o") + F.coalesce(F.sum(w).over(inside), F.lit(0))
    return joined.withColumn(out, before).drop(h, b, w, "__rb", "__s", "__o", *names)

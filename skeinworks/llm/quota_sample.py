"""Problem 5: a sample that matches target shares of categories, with floors and a report of shortfalls."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spelling as S
from ..session import checkpointed, small, table
from .common import cumulative_before, image_rows

SEED = 5


def allocate(targets: list[dict], size: int) -> dict:
    """Integer quotas by largest remainder, with floors and caps.

    targets: ``key, share, floor, available``. Quotas are in proportion to the
    shares, but at least min(floor, available) and at most available: where
    the proportion falls short of floors or exceeds caps, those are fixed,
    whichever weigh more first, and what is left of ``size`` is shared again
    among the others. A category without share gets its floor only. Floors
    beyond ``size`` are kept. Remainders are rounded up from the largest on;
    ties go to the smaller key.
    """
    low = {t["key"]: min(t["floor"], t["available"]) for t in targets}
    high = {t["key"]: t["available"] if t["share"] > 0 else low[t["key"]] for t in targets}
    share = {t["key"]: Fraction(t["share"]) for t in targets}
    exact, free = dict(low), {k for k in low if low[k] < high[k]}
    if sum(low.values()) >= size:
        return low
    while free:
        left = size - sum(exact[k] for k in exact if k not in free)
        whole = sum(share[k] for k in free)
        wanted = {k: left * share[k] / whole for k in free}
        under = {k for k in free if wanted[k] < low[k]}
        over = {k for k in free if wanted[k] > high[k]}
        exact.update(wanted)
        if not under and not over:
            break
        if sum(low[k] - wanted[k] for k in under) >= sum(wanted[k] - high[k] for k in over):
            exact.update({k: low[k] for k in under})
            free -= under
        else:
            exact.update({k: high[k] for k in over})
            free -= over
    quota = {k: math.floor(x) for k, x in exact.items()}
    spare = round(sum(exact.values())) - sum(quota.values())
    for k in sorted(exact, key=lambda k: (quota[k] - exact[k], str(k)))[:spare]:
        quota[k] += 1
    return quota


def category_report(records: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target category: counts, quota and whether its targets can be met.

    records: ``id, category, grp`` (one row per record, category a string);
    targets: ``category, target_share, min_images, min_groups, sample_size``.

    Defined cases: a category absent from the records has 0 of all; records of
    no target category are ignored; null groups are no group; null targets
    count as 0; of repeated target rows the greatest values hold; empty
    targets give an empty report.
    """
    counts = records.groupBy("category", "grp").agg(F.count(F.lit(1)).alias("n")).groupBy("category").agg(F.sum("n").alias("available"), F.count("grp").alias("groups"))
    zero = lambda c: F.coalesce(F.max(c), F.lit(0))
    wanted = targets.groupBy("category").agg(zero("target_share").cast("double").alias("target_share"), zero("min_images").cast("long").alias("min_images"), zero("min_groups").cast("long").alias("min_groups"), zero("sample_size").cast("long").alias("sample_size"))
    rows = wanted.join(counts, "category", "left").collect()
    size = max([r["sample_size"] for r in rows], default=0)
    quota = allocate([{"key": r["category"], "share": r["target_share"], "floor": r["min_images"], "available": r["available"] or 0} for r in rows], size)
    excess, out = max(0, sum(quota.values()) - size), []
    for r in rows:
        have, groups, need = r["available"] or 0, r["groups"] or 0, max(float(r["min_images"]), r["target_share"] * r["sample_size"])
        out.append((r["category"], r["target_share"], r["min_images"], r["min_groups"], r["sample_size"], have, groups, quota[r["category"]], need, have < need, groups < r["min_groups"], excess))
    return records.sparkSession.createDataFrame(out, "category string, target_share double, min_images long, min_groups long, sample_size long, available long, groups long, quota long, needed double, short_of_images boolean, short_of_groups boolean, excess long")


def quota_sample(records: DataFrame, report: DataFrame, seed: int = SEED) -> DataFrame:
    """``id, category, grp``: in each category the records with the smallest random keys, up to its quota.

    So that ``min_groups`` is kept, the first record of each of the min_groups
    smallest groups is chosen before the others. The smallest keys are found
    by distributed running counts over hash ranges, never by sorting a whole
    category in one task; the quotas (one row per category) are broadcast if a
    count proves them few.
    """
    quotas = small(report.select("category", "quota", "min_groups"))
    key = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), 1, 15), 16, 10).cast("long")
    keyed = records.join(quotas, "category").withColumn("k", key)  # 60 bits
    heads = keyed.where("grp IS NOT NULL").groupBy("category", "grp").agg(F.min(F.struct("k", "id")).alias("head"), F.first("quota").alias("quota"), F.first("min_groups").alias("min_groups"))
    heads = cumulative_before(heads, ["category"], F.shiftleft("head.k", 4), "grp", F.lit(1))
    heads = heads.where(F.col("before") < F.least("min_groups", "quota")).select("category", F.col("head.id").alias("id"), F.lit(1).alias("head"))
    marked = keyed.join(heads, ["category", "id"], "left")
    # chosen heads come first; the ranges of others start behind them
    order = F.when(F.col("head") == 1, F.shiftleft("k", 3)).otherwise(F.shiftleft("k", 3).bitwiseOR(F.lit(-(2**63))))
    ranked = cumulative_before(marked, ["category"], order, "id", F.lit(1), out="ahead", bits=13)
    return ranked.where("ahead < quota").select("id", "category", "grp")


def _category(c, d):
    return F.concat_ws("|", c, d)


def strata(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(records, targets) of the images and sample_targets; one record per image."""
    rows = image_rows(spark, sf_dir)
    records = rows.groupBy("stable_image_id").agg(F.min("condition").alias("c"), F.min("div").alias("d"), F.min("bio").alias("grp"))
    records = records.where("c IS NOT NULL AND d IS NOT NULL").select(F.col("stable_image_id").alias("id"), _category(F.col("c"), F.col("d")).alias("category"), "grp")
    t = table(spark, sf_dir, "sample_targets")
    targets = t.withColumn("category", _category(S.condition("inferred_condition"), S.div("inferred_div")))
    return records, targets


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quota, counts and shortfalls of every stratum."""
    records, targets = strata(spark, sf_dir)
    names = targets.groupBy("category").agg(F.min("inferred_condition").alias("inferred_condition"), F.min("inferred_div").alias("inferred_div"))
    return category_report(records, targets).join(names, "category").drop("category")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strata that cannot meet their targets."""
    return p5_report(spark, sf_dir).where("short_of_images OR short_of_groups").select("inferred_condition", "inferred_div")


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn images with their stratum."""
    records, targets = strata(spark, sf_dir)
    records = checkpointed(records)
    drawn = quota_sample(records, category_report(records, targets))
    part = lambda i: F.split("category", r"\|")[i]
    return drawn.select(F.col("id").alias("stable_image_id"), part(0).alias("inferred_condition"), part(1).alias("inferred_div"))

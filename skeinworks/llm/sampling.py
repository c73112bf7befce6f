"""Problem 1: a reproducible sample that stays stable as the data grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed
from .common import image_rows

SHARE = 0.1
SEED = "stable-sample-1"
#: p1_state: when the second run sees more rows, and the weight of an image in a near-duplicate group.
GROWN_AT, GROUPED = "2024-06-01 00:00:00", 0.5
#: 52 bits of the identifier's SHA-256 are exact in a double.
_RANGE = 2.0**52


def hash_position(key: Column, seed: str = SEED) -> Column:
    """Position of a key in [0, 1): depends on key and seed only."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(seed + ":"), key), 256), 1, 13), 16, 10).cast("double") / F.lit(_RANGE)


def poisson_sample(rows: DataFrame, key: str, share: float, weight: str | None = None, state: DataFrame | None = None, seed: str = SEED) -> DataFrame:
    """Consistent weighted Poisson sampling over the distinct keys of ``rows``.

    A key is selected when its hash lies below weight x share. ``state`` is the
    earlier result of this function (``key, weight``): weights are running
    maxima, so an inclusion probability never falls and a selected key stays
    selected, whatever is added later. Returns ``key, weight, selected`` for
    every key of rows and state: it is the next state.

    One aggregate per key (map-side combined, so resent rows cost nothing in
    the shuffle) and no order, rank or count of the other keys is used.

    Defined cases: null keys are no record; null, NaN or negative weights count
    as 0; weights are 1 without a weight column; a key of the state that is
    absent from ``rows`` stays; empty tables give an empty result.
    """
    w = F.lit(1.0)
    if weight is not None:
        c = F.col(weight).cast("double")
        w = F.when(c.isNull() | F.isnan(c) | (c < 0), 0.0).otherwise(c)
    now = rows.select(F.col(key).alias(key), w.alias("weight")).where(F.col(key).isNotNull())
    if state is not None:
        now = now.unionByName(state.select(F.col(key).alias(key), F.col("weight").cast("double").alias("weight")))
    kept = now.groupBy(key).agg(F.max("weight").alias("weight"))
    return kept.withColumn("selected", hash_position(F.col(key).cast("string"), seed) < F.col("weight") * F.lit(share))


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen tenth of the distinct images."""
    states = poisson_sample(image_rows(spark, sf_dir), "stable_image_id", SHARE)
    return states.where("selected").select("stable_image_id", "weight")


def p1_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many images there are and how many are chosen."""
    states = poisson_sample(image_rows(spark, sf_dir), "stable_image_id", SHARE)
    return states.agg(F.count(F.lit(1)).alias("n_images"), F.count_if("selected").alias("n_selected"))


def p1_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state table after the data have grown: every image with its running-maximum weight and whether it is chosen.

    The first run sees the rows that arrived before ``GROWN_AT`` and stores
    its state; the second one reads it and sees all rows. An image weighs
    ``GROUPED`` in a near-duplicate group and 1 outside, so resent rows that
    gain or lose their label would change its weight; the maximum holds.
    """
    rows = image_rows(spark, sf_dir).select("stable_image_id", F.when(F.col("near_group").isNotNull(), F.lit(GROUPED)).otherwise(1.0).alias("weight"), "ingested_at")
    early = rows.where(F.col("ingested_at") < F.lit(GROWN_AT).cast("timestamp"))
    state = checkpointed(poisson_sample(early, "stable_image_id", SHARE, "weight"))
    return poisson_sample(rows, "stable_image_id", SHARE, "weight", state.select("stable_image_id", "weight"))

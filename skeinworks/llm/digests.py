"""Problem 7: percentiles of very large columns from mergeable centroid digests, with certified rank error."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spelling as S
from ..session import checkpointed, small, table

#: Compression: a digest has at most about this many centroids, a rank error of about its inverse.
DELTA = 400
PERCENTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
METRICS = ["mean", "high_frequency_residual_std"]
#: Fixed value: pixel statistics of 8-bit images.
LOW, HIGH = 0.0, 255.0
#: Stated bound of the rank error, besides half a value: a centroid at the median covers pi / (2 DELTA) of the ranks; more than twice that for merging.
BOUND = 0.01
#: Digests that are merged in one step.
FAN = 64


def cluster(group: np.ndarray, value: np.ndarray, weight: np.ndarray, delta: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster weighted values of many groups at once: (group, mean, weight) of the centroids, sorted.

    A value belongs to cluster floor(k(q)) with k(q) = delta / pi * asin(2q - 1)
    at the middle q of its weight, so clusters are small at both ends. Equal
    values stay in the order given; a group's least and greatest value are
    centroids of their own.
    """
    order = np.lexsort((value, group))
    group, value, weight = group[order], value[order], weight[order]
    start = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
    at = np.flatnonzero(start)
    sizes = np.diff(np.r_[at, len(group)])
    total = np.add.reduceat(weight, at) if len(at) else np.zeros(0)
    upto = np.cumsum(weight)
    base = np.repeat(upto[at] - weight[at], sizes)
    q = np.clip((upto - base - weight / 2) / np.repeat(total, sizes), 0, 1)
    k = np.floor(delta / np.pi * np.arcsin(2 * q - 1)).astype(np.int64)
    k[start] = -delta  # the least value alone
    if len(at):
        k[np.r_[at[1:], len(group)] - 1] = delta  # the greatest alone
    cut = np.flatnonzero(start | np.r_[True, k[1:] != k[:-1]]) if len(group) else np.zeros(0, int)
    w = np.add.reduceat(weight, cut) if len(cut) else np.zeros(0)
    m = np.add.reduceat(value * weight, cut) / w if len(cut) else np.zeros(0)
    return group[cut], m, w


def _digests(keys: list[str], frame: pd.DataFrame, delta: int) -> pd.DataFrame:
    """One row per key of ``frame`` (keys, v, w)."""
    codes, _ = pd.factorize(pd.MultiIndex.from_frame(frame[keys].astype(object).where(frame[keys].notna(), None)), use_na_sentinel=False)
    first = pd.Series(np.arange(len(codes))).groupby(codes).first().to_numpy()
    g, m, w = cluster(codes, frame["v"].to_numpy(float), frame["w"].to_numpy(float), delta)
    at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    out = frame[keys].iloc[first].reset_index(drop=True)
    out["means"], out["weights"] = np.split(m, at[1:]), np.split(w, at[1:])
    return out


def partial_digests(values: DataFrame, keys: list[str], delta: int = DELTA) -> DataFrame:
    """A digest per key and Arrow batch of ``values`` (keys and a double ``v``): ``keys, means, weights``.

    No shuffle: the map-side half of the aggregation. Null, NaN and infinite
    values are left out; null keys are a group.
    """
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in values.select(*keys).schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for b in batches:  # reduce again before much is held
            held.append(b.assign(w=1.0))
            n += len(b)
            if n >= 200_000:
                yield _digests(keys, pd.concat(held, ignore_index=True), delta)
                held, n = [], 0
        if n:
            yield _digests(keys, pd.concat(held, ignore_index=True), delta)

    finite = values.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))).select(*keys, "v")
    return finite.mapInPandas(run, ", ".join(fields) + ", means array<double>, weights array<double>")


def merge_digests(digests: DataFrame, keys: list[str], delta: int = DELTA, fan: int = FAN) -> DataFrame:
    """Merge all digests of a key by re-clustering, in a tree whose nodes have about ``fan`` digests each.

    The depth follows from the greatest number of digests of a key, so a task
    never holds more than a few times ``fan`` of them, however hot the key.
    Any digests of these columns can be merged: of partitions, of days, or
    earlier merged ones. Returns ``keys, means, weights``.
    """
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in digests.select(*keys).schema]
    schema = ", ".join(fields) + ", means array<double>, weights array<double>"

    def run(f: pd.DataFrame) -> pd.DataFrame:
        m, w = np.concatenate(f["means"].to_list()), np.concatenate(f["weights"].to_list())
        _, m, w = cluster(np.zeros(len(m), int), m, w, delta)
        return pd.DataFrame({**{k: [f[k].iloc[0]] for k in keys}, "means": [m], "weights": [w]})

    digests = checkpointed(digests.select(*keys, "means", "weights"))
    most = digests.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while True:
        branches = max(1, -(-most // fan)) if most > fan else 1
        spread = digests.withColumn("branch", F.pmod(F.xxhash64("means", "weights"), F.lit(branches)))
        digests = spread.groupBy(*keys, "branch").applyInPandas(lambda f: run(f), schema)
        most = branches
        if branches == 1:
            return digests


def quantiles(means: np.ndarray, weights: np.ndarray, ps: list[float]) -> np.ndarray:
    """Values at ``ps``, interpolated between the middles of neighbouring centroids."""
    middle = np.cumsum(weights) - weights / 2
    return np.interp(np.asarray(ps) * weights.sum(), middle, means)


def estimates(digests: DataFrame, keys: list[str], ps: list[float]) -> DataFrame:
    """``keys, n, estimates`` (an array in the order of ``ps``) from one digest per key."""
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in digests.select(*keys).schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[keys].copy()
            out["n"] = [int(round(w.sum())) for w in b["weights"]]
            out["estimates"] = [quantiles(m, w, ps) for m, w in zip(b["means"], b["weights"])]
            yield out

    return digests.mapInPandas(run, ", ".join(fields) + ", n long, estimates array<double>")


def certified(values: DataFrame, found: DataFrame, keys: list[str], ps: list[float]) -> DataFrame:
    """Second pass: count the values below and up to each estimate, and state its true rank error.

    Returns a row per key and percentile: ``keys, p, n, estimate, rank_error``.
    The error is the distance of p from [share below, share up to] the estimate,
    so it is 0 where ties cover the rank. The counts are plain sums with a
    map-side combine; the estimates (one row per key) are broadcast when a
    count proves them few, else joined by a shuffle.
    """
    found = small(checkpointed(found))
    names = [f"__{k}" for k in keys]
    side = found.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], "n", "estimates")
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    finite = values.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))).select(*keys, "v")
    # only counts are aggregated, so that it is a hash aggregate; the estimates are joined again to its few rows
    counted = finite.join(side, cond).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__all"),
        *[F.count_if(F.col("v") < F.col("estimates")[i]).alias(f"__lt{i}") for i in range(len(ps))],
        *[F.count_if(F.col("v") <= F.col("estimates")[i]).alias(f"__le{i}") for i in range(len(ps))],
    ).join(side, cond)
    rows = [F.struct(F.lit(p).alias("p"), F.col("estimates")[i].alias("estimate"), (F.col(f"__lt{i}") / F.col("__all")).alias("below"), (F.col(f"__le{i}") / F.col("__all")).alias("upto")) for i, p in enumerate(ps)]
    out = counted.select(*keys, F.col("__all").alias("n"), F.explode(F.array(*rows)).alias("r"))
    error = F.greatest(F.col("r.below") - F.col("r.p"), F.col("r.p") - F.col("r.upto"), F.lit(0.0))
    return out.select(*keys, "r.p", "n", "r.estimate", error.alias("rank_error"))


def percentiles(values: DataFrame, keys: list[str], ps: list[float] | None = None, delta: int = DELTA) -> DataFrame:
    """Certified percentiles of ``v`` per key: partial digests, merge, second counting pass.

    Defined cases: an empty table gives no rows; a single value is every
    percentile; ties are certified with error 0; null keys are a group.
    """
    ps = ps or PERCENTILES
    found = estimates(merge_digests(partial_digests(values, keys, delta), keys, delta), keys, ps)
    return certified(values, found, keys, ps)


STRATUM = ["metric", "inferred_condition", "inferred_div"]


def blank_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finite values in range of both metrics per stratum and day, one per run (repeated rows count once)."""
    rows = table(spark, sf_dir, "blank_stats").select(
        S.image_id("stable_image_id").alias("id"), "computed_at", S.condition("inferred_condition").alias("inferred_condition"), S.div("inferred_div").alias("inferred_div"), *METRICS
    )
    rows = rows.where("id IS NOT NULL").distinct()
    both = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in METRICS])
    values = rows.select("inferred_condition", "inferred_div", F.to_date("computed_at").alias("day"), F.explode(both).alias("x"))
    values = values.select("x.metric", "inferred_condition", "inferred_div", "day", "x.v")
    return values.where((F.col("v") >= LOW) & (F.col("v") <= HIGH) & ~F.isnan("v"))


def p7_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of both metrics per condition and DIV with certified rank errors."""
    return percentiles(checkpointed(blank_values(spark, sf_dir)), STRATUM)


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of values behind each percentile, and whether its certified rank error keeps the bound, ``BOUND`` and half a value."""
    found = p7_percentiles(spark, sf_dir)
    return found.select(*STRATUM, "p", "n", (F.col("rank_error") <= BOUND + 0.5 / F.col("n")).alias("within_bound"))


def p7_by_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from digests kept per day of computed_at and put together afterwards."""
    values = checkpointed(blank_values(spark, sf_dir))
    days = checkpointed(partial_digests(values, [*STRATUM, "day"]))  # what a daily job would store
    return certified(values, estimates(merge_digests(days, STRATUM), STRATUM, PERCENTILES), STRATUM, PERCENTILES)

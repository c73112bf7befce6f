"""Image profiles, statistics and proxies over DataFrames: kernels in Arrow batches, pixel tables in Catalyst."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels as K

#: Rows of an Arrow batch that holds whole images; 16 images of 1 MP of float64 are 128 MB.
IMAGE_BATCH = 16


def array_of(height, width, channels, dtype, pixels) -> np.ndarray:
    """The image of a row of the decoder."""
    shape = (int(height), int(width)) if int(channels) == 1 else (int(height), int(width), int(channels))
    return np.frombuffer(pixels, np.dtype(dtype)).reshape(shape)


def map_images(images: DataFrame, kernel, schema: str, keys: list[str]) -> DataFrame:
    """Apply ``kernel(array, row) -> list of dicts`` to each readable image; keys are carried over.

    One decode and one Python pass, whatever the number of measures; no shuffle.
    """
    types = {f.name: f.dataType.simpleString() for f in images.schema}
    out = [c.strip().split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                a = array_of(r["height"], r["width"], r["channels"], r["dtype"], r["pixels"])
                rows += [{**{k: r[k] for k in keys}, **x} for x in kernel(a, r)]
            yield pd.DataFrame(rows, columns=[*keys, *out])

    wanted = images.where("pixels IS NOT NULL").select(*dict.fromkeys([*keys, "height", "width", "channels", "dtype", "pixels"]))
    return wanted.mapInPandas(run, ", ".join(f"{k} {types[k]}" for k in keys) + ", " + schema)


def with_identity(measures: DataFrame, rows: DataFrame, key: str, fields: list[str], missing: str = "unknown") -> DataFrame:
    """Measures with the identity fields of their row; where the row, the field or its value is absent, ``missing`` stands."""
    known = rows.select(key, *[F.col(c).cast("string").alias(f"__{c}") for c in fields if c in rows.columns])
    out = measures.drop(*[c for c in fields if c != key]).join(known, key, "left")
    return out.select("*", *[F.coalesce(F.col(f"__{c}") if c in rows.columns else F.lit(None), F.lit(missing)).alias(c) for c in fields]).drop(*[f"__{c}" for c in fields])


PROFILE_SCHEMA = ", ".join(f"{c} double" for c in ["min", "max", "mean", "std", *K.PERCENTILE_NAMES, "saturation_value"]) + ", saturation_count long, zero_count long, pixel_sha256 string, thumbnail_hash string, thumbnail array<float>, flags array<string>"


def profile_images(images: DataFrame, expected: tuple[int, int] | None = None) -> DataFrame:
    """Statistics, hashes, thumbnail vector and quality flags of each readable image."""
    def kernel(a, _):
        thumb = K.thumbnail(a)
        return [K.profile(a) | {"pixel_sha256": K.pixel_hash(a), "thumbnail_hash": K.thumbnail_hash(thumb), "thumbnail": K.unit_vector(thumb), "flags": K.quality_flags(a, expected)}]

    return map_images(images, kernel, PROFILE_SCHEMA, ["source_root_id", "relative_path"])


def expected_shape(images: DataFrame) -> tuple[int, int] | None:
    """Height and width of the first decodable image in path order: one row reaches the driver."""
    first = images.where("height IS NOT NULL").agg(F.min(F.struct(F.split("relative_path", "/").alias("p"), "height", "width")).alias("x")).select("x.height", "x.width").first()
    return (first[0], first[1]) if first and first[0] is not None else None


STATISTICS = ["mean", "std", "zero_fraction", "saturation_fraction", *[f"local_{m}_{p}" for m in ("mean", "variance") for p in ("p25", "p50", "p75")], "row_variation", "column_variation", "low_frequency_gradient_p95_minus_p5", "high_frequency_residual_std", "high_frequency_residual_p99_abs", "directional_power_ratio", "radial_power_first_bin", "radial_power_tail_median", "autocorrelation_first_bin", "autocorrelation_tail_median", *K.PERCENTILE_NAMES]
PROXIES = ["proxy_threshold", "foreground_occupancy_proxy", "ridge_response_p50", "ridge_response_p95", "orientation_mean_proxy", "orientation_resultant_length_proxy", "apparent_width_proxy_p50", "component_length_proxy_p50", "local_snr_proxy", "endpoint_candidate_density", "crossing_candidate_density"]


def image_statistics(images: DataFrame, keys: list[str], **options) -> DataFrame:
    """Appearance statistics of each image, one row."""
    return map_images(images, lambda a, _: [K.statistics(a, **options)], ", ".join(f"{c} double" for c in STATISTICS), keys)


def image_proxies(images: DataFrame, keys: list[str], **options) -> DataFrame:
    """Structure proxies of each image, one row; null where a measure has no pixels."""
    return map_images(images, lambda a, _: [K.proxies(a, **options)], ", ".join(f"{c} double" for c in PROXIES), keys)


def decompositions(images: DataFrame, keys: list[str], sigmas: list[float], **options) -> DataFrame:
    """Background decomposition statistics, one row per image and sigma."""
    return map_images(images, lambda a, _: K.decomposition(a, sigmas, **options), "sigma_px double, residual_variance double, residual_power_tail_median double, low_frequency_gradient_p95_minus_p5 double", keys)


def spectra(images: DataFrame, keys: list[str], size: int = 256, bins: int = 32) -> DataFrame:
    """Radial power and autocorrelation arrays and the directional ratio of each image."""
    kernel = lambda a, _: [{"power": K.radial_power(K.grey(a), size, bins), "autocorrelation": K.radial_autocorrelation(K.grey(a), size, bins), "directional_ratio": K.directional_ratio(K.grey(a), size)}]
    return map_images(images, kernel, "power array<float>, autocorrelation array<float>, directional_ratio double", keys)


def component_table(images: DataFrame, keys: list[str], threshold: float, diagonal: bool) -> DataFrame:
    """Area, height and width of each component of the pixels above a threshold."""
    kernel = lambda a, _: [dict(zip(("area", "height", "width"), map(int, x))) for x in K.component_boxes(K.grey(a) > threshold, diagonal)]
    return map_images(images, lambda a, r: [{"comp_" + k: v for k, v in x.items()} for x in kernel(a, r)], "comp_area int, comp_height int, comp_width int", keys)


# --- pixel tables ---------------------------------------------------------------------------------------------------


def pixel_table(images: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """``key, y, x, v`` of images held as arrays of ``width`` columns."""
    return images.select(F.col(key), F.posexplode(values).alias("pos", "v")).select(key, F.floor(F.col("pos") / width).cast("int").alias("y"), (F.col("pos") % width).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def pixel_profile(px: DataFrame, key: str) -> DataFrame:
    """Exact statistics of each image from its pixel table: one shuffle."""
    ps = F.percentile("v", F.array(*[F.lit(p / 100) for p in K.PERCENTILES]))
    out = px.groupBy(key).agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), ps.alias("ps"), F.count_if(F.col("v") == 0).alias("zero_count"), F.count_if(F.col("v") > 0).alias("positive_count"))
    return out.select(key, "min", "max", "mean", "std", *[F.col("ps")[i].alias(n) for i, n in enumerate(K.PERCENTILE_NAMES)], "zero_count", "positive_count")


def pixel_blocks(px: DataFrame, key: str, block: int) -> DataFrame:
    """Quartiles of block means and variances of each image."""
    parts = px.groupBy(key, F.floor(F.col("y") / block).alias("by"), F.floor(F.col("x") / block).alias("bx")).agg(F.avg("v").alias("mean"), F.var_pop("v").alias("variance"))
    q = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c)
    return parts.groupBy(key).agg(q("mean"), q("variance")).select(key, *[F.col(c)[i].alias(f"local_{c}_{p}") for c in ("mean", "variance") for i, p in enumerate(("p25", "p50", "p75"))])


def pixel_gradients(px: DataFrame, key: str) -> DataFrame:
    """Add central differences ``gx, gy``, zero at the borders.

    Both directions need other pixels of the same image only, so images are
    co-partitioned once: ``repartition`` by key serves both windows.
    """
    px = px.repartition(key)
    diff = lambda w: F.coalesce((F.lead("v").over(w) - F.lag("v").over(w)) / 2, F.lit(0.0))
    return px.withColumn("gx", diff(W.partitionBy(key, "y").orderBy("x"))).withColumn("gy", diff(W.partitionBy(key, "x").orderBy("y")))


def orientation_summary(gradients: DataFrame, key: str, ridge_percentile: float) -> DataFrame:
    """Mean direction and resultant length over the pixels above the ridge percentile of their image."""
    ridge = gradients.withColumn("ridge", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2))
    cut = ridge.withColumn("cut", F.percentile("ridge", F.lit(ridge_percentile)).over(W.partitionBy(key)))
    theta = F.pmod(F.atan2("gy", "gx") + F.pi() / 2, F.pi())
    strong = cut.where(F.col("ridge") > F.col("cut")).withColumn("theta", theta)
    return strong.groupBy(key).agg(F.count(F.lit(1)).alias("n_strong"), F.avg("theta").alias("orientation_mean"), F.sqrt(F.avg(F.cos(2 * F.col("theta"))) ** 2 + F.avg(F.sin(2 * F.col("theta"))) ** 2).alias("resultant"))


def robust_summary(px: DataFrame, key: str, percentile: float, k: float) -> DataFrame:
    """Robust threshold, mask size and signal-to-noise of each image.

    Median, deviation and threshold are window aggregates over one image, so
    all passes share a single shuffle by the image key.
    """
    w = W.partitionBy(key)
    px = px.repartition(key).withColumn("med", F.percentile("v", F.lit(0.5)).over(w))
    px = px.withColumn("mad", F.percentile(F.abs(F.col("v") - F.col("med")), F.lit(0.5)).over(w)).withColumn("p", F.percentile("v", F.lit(percentile)).over(w))
    cut = F.greatest("p", F.col("med") + k * K.MAD_SCALE * F.col("mad"))
    px = px.withColumn("cut", cut).withColumn("front", (F.col("v") >= F.col("cut")) & (F.col("v") > F.col("med")))
    front, back = F.when(F.col("front"), F.col("v")), F.when(~F.col("front"), F.col("v"))
    out = px.groupBy(key).agg(F.first("cut").alias("threshold"), F.count_if("front").alias("n_front"), F.percentile(front, F.lit(0.5)).alias("f"), F.percentile(back, F.lit(0.5)).alias("b"), F.stddev_pop(back).alias("s"))
    return out.select(key, "threshold", "n_front", ((F.col("f") - F.col("b")) / F.greatest("s", F.lit(1e-6))).alias("snr"))


def pixel_variation(px: DataFrame, key: str) -> DataFrame:
    """Row and column variation of each image, from one shuffle by the image."""
    px = px.repartition(key)
    rows = px.groupBy(key, "y").agg(F.avg("v").alias("m")).groupBy(key).agg(F.stddev_pop("m").alias("r"))
    cols = px.groupBy(key, "x").agg(F.avg("v").alias("m")).groupBy(key).agg(F.stddev_pop("m").alias("c"))
    std = px.groupBy(key).agg(F.stddev_pop("v").alias("s"))
    whole = F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))
    return std.join(rows, key).join(cols, key).select(key, (F.col("r") / whole).alias("row_variation"), (F.col("c") / whole).alias("column_variation"))


def pixel_blur(px: DataFrame, key: str, sigma: float, shape: tuple[int, int]) -> DataFrame:
    """Separable zero-padded Gaussian blur of pixel tables: each pass spreads a pixel over the taps and sums."""
    taps = K.gaussian_kernel(sigma, shape).astype(float)
    r = len(taps) // 2
    kernel = F.explode(F.array(*[F.struct(F.lit(i - r).alias("d"), F.lit(float(c)).alias("c")) for i, c in enumerate(taps)]))
    for axis, n in (("x", shape[1]), ("y", shape[0])):
        other = "y" if axis == "x" else "x"
        spread = px.select(key, other, axis, "v", kernel.alias("k")).select(key, other, (F.col(axis) + F.col("k.d")).alias(axis), (F.col("v") * F.col("k.c")).alias("v"))
        px = spread.where((F.col(axis) >= 0) & (F.col(axis) < n)).groupBy(key, "y", "x").agg(F.sum("v").alias("v"))
    return px.select(key, "y", "x", "v")


def uint8_levels(v: Column, lo: float, hi: float) -> Column:
    """8-bit level of a value, halves to even."""
    if hi <= lo:
        raise ValueError("the upper bound must exceed the lower one")
    return F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo))) * 255).cast("int")


def histogram_percentiles(rows: DataFrame, keys: list[str], value: str, ps: list[float]) -> DataFrame:
    """Exact percentiles per group from a histogram of distinct values.

    The map-side combine leaves one row per group and distinct value, so
    billions of 8-bit pixels shuffle as 256 rows per group and task.
    """
    histogram = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    out = histogram.groupBy(*keys).agg(F.sum("n").alias("n_values"), F.percentile(F.col(value), F.array(*[F.lit(p / 100) for p in ps]), F.col("n")).alias("ps"))
    return out.select(*keys, "n_values", F.posexplode("ps").alias("i", "value")).select(*keys, F.element_at(F.array(*[F.lit(float(p)) for p in ps]), F.col("i") + 1).alias("percentile"), "n_values", "value")


def radial_rings(px: DataFrame, key: str, shape: tuple[int, int], bins: int) -> DataFrame:
    """Mean of each right-open ring around the centre, 0 for an empty ring; every ring has a row."""
    h, w = shape
    far = float(max(np.hypot(x - w / 2, y - h / 2) for y in (0, h - 1) for x in (0, w - 1)))
    r = F.sqrt((F.col("x") - w / 2) ** 2 + (F.col("y") - h / 2) ** 2)
    ringed = px.withColumn("ring", F.floor(r * bins / far).cast("int"))
    sums = ringed.where(F.col("ring") < bins).groupBy(key).pivot("ring", list(range(bins))).agg(F.avg("v"))
    return sums.select(key, F.posexplode(F.array(*[F.coalesce(F.col(str(i)), F.lit(0.0)) for i in range(bins)])).alias("ring", "mean"))

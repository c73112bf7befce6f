"""Report figures as PNG bytes. Data are reduced by the executors; only what is drawn reaches the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import images, kernels, selection
from ..sources import sinks

#: Colours of the series, in turn.
COLOURS = [(0, 90, 220), (220, 90, 0), (60, 160, 60), (160, 60, 160)]
#: Most values drawn of a series; a longer one is drawn by as many of its percentiles.
SERIES = 256


def contact_sheet(decoded: DataFrame, rows: DataFrame, tile: int = 192) -> tuple[bytes, list[str]]:
    """(sheet, ids in its order): previews of up to three representatives of ``rows``, side by side.

    rows: ``stable_image_id, source_root_id, relative_path, p50, p99``. No rows
    give an empty white sheet.
    """
    chosen = selection.representatives(rows.withColumn("__all", F.lit(1)), ["__all"], "stable_image_id", "p50", "p99")
    held = decoded.join(F.broadcast(chosen.select("source_root_id", "relative_path", "stable_image_id", "reason")), ["source_root_id", "relative_path"])  # three rows
    made = images.map_images(held, lambda a, _: [{"preview": kernels.preview(a, tile).tobytes()}], "preview binary", ["stable_image_id", "reason"])
    order = {"first": 0, "middle": 1, "top": 2}
    found = sorted(made.collect(), key=lambda r: order[r["reason"]])
    sheet = np.full((tile, max(1, len(found)) * tile), 255, np.uint8)
    for i, r in enumerate(found):
        sheet[:, i * tile : (i + 1) * tile] = np.frombuffer(r["preview"], np.uint8).reshape(tile, tile)
    return sinks.png_bytes(sheet), [r["stable_image_id"] for r in found]


def line_figure(series: dict[str, np.ndarray], width: int = 650, height: int = 220) -> bytes:
    """Lines over the same place, each scaled to its own range; series in the order given."""
    canvas = np.full((height + 20, width + 20, 3), 255, np.uint8)
    for (_, values), colour in zip(series.items(), COLOURS * len(series)):
        v = np.asarray(values, np.float64)
        if len(v) < 2:
            continue
        low, high = v.min(), max(v.max(), v.min() + 1e-12)
        x = np.arange(width)
        y = np.interp(x * (len(v) - 1) / (width - 1), np.arange(len(v)), (v - low) / (high - low))
        at = 10 + height - 1 - np.round(y * (height - 1)).astype(int)
        for column, (a, b) in enumerate(zip(at, np.r_[at[1:], at[-1]])):  # steep parts stay connected
            canvas[min(a, b) : max(a, b) + 1, 10 + column] = colour
    return sinks.png_bytes(canvas)


def transverse_figure(arrays: DataFrame, names: list[str], width: int = 650) -> bytes:
    """Centre rows of the named arrays of the first sample; ``arrays`` as of ``files.read_npz``."""
    first = arrays.agg(F.min("relative_path")).first()[0]
    held = {r["name"]: np.frombuffer(r["data"], np.dtype(r["dtype"])).reshape(r["shape"]) for r in arrays.where(F.col("relative_path").eqNullSafe(first) & F.col("name").isin(names)).collect()}
    return line_figure({n: kernels.transverse_profile(held[n], width) for n in names if n in held}, width)


def series_by_kind(rows: DataFrame, kind: str, value: str, most: int = SERIES) -> dict[str, list[float]]:
    """Sorted values of each kind; of more than ``most`` as many evenly spaced percentiles. Nulls and NaN are left out."""
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(kind).isNotNull())
    at = [F.lit(i / (most - 1)) for i in range(most)]
    got = known.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(F.col(value).cast("double"), F.array(*at), 10_000).alias("q"))
    few = known.join(got.where(F.col("n") <= most).select(kind), kind).groupBy(kind).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("all"))
    return {r[kind]: r["all"] or r["q"] for r in got.join(few, kind, "left").orderBy(kind).collect()}


def kind_figure(rows: DataFrame, kind: str, value: str) -> bytes:
    """Bars of the sorted values of each kind, side by side."""
    return sinks.bars_png(series_by_kind(rows, kind, value), colours=COLOURS)


def median_figure(summary: DataFrame, group: str, fields: list[str], groups: list[str], height: int = 250) -> bytes:
    """Bars of the medians of some fields by group (``selection.measure_summary``); a missing one is 0, each field has its own scale."""
    found = {(r["field"], r[group]): r["median"] for r in summary.where(F.col("field").isin(fields) & F.col(group).isin(groups)).collect()}
    blocks = []
    for f in fields:
        block = np.full((height + 20, 45 * len(groups) + 30, 3), 255, np.uint8)
        values = [max(0.0, found.get((f, g)) or 0.0) for g in groups]
        top = max(values) or 1.0
        for i, v in enumerate(values):
            block[10 + height - int(height * v / top) : 10 + height, 10 + 45 * i : 38 + 45 * i] = COLOURS[i % len(COLOURS)]
        blocks.append(block)
    return sinks.png_bytes(np.concatenate(blocks, axis=1) if blocks else np.full((height, 10, 3), 255, np.uint8))

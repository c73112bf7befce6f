"""Vector geometry as tables: rasterising, crossings, and generated samples over many tasks."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import npz_bytes, put_bytes
from . import strands
from .images import array_of

SEGMENTS = "sample_id, fiber_id, seq, x0, y0, x1, y1, radius, intensity"


def rasterized(segments: DataFrame, height: int, width: int) -> DataFrame:
    """``sample_id, fiber_id, y, x, intensity``: the pixels whose centre lies within a segment's radius, once per strand.

    Each segment explodes the pixels of its own bounding box only, so no pixel
    grid is joined and the work follows the drawn length.
    """
    clip = lambda lo, hi, n: (F.greatest(F.floor(lo - F.col("radius") - 1), F.lit(0)), F.least(F.ceil(hi + F.col("radius") + 1), F.lit(n - 1)))
    y_lo, y_hi = clip(F.least("y0", "y1"), F.greatest("y0", "y1"), height)
    x_lo, x_hi = clip(F.least("x0", "x1"), F.greatest("x0", "x1"), width)
    boxes = segments.select("*", y_lo.cast("int").alias("ya"), y_hi.cast("int").alias("yb"), x_lo.cast("int").alias("xa"), x_hi.cast("int").alias("xb")).where("ya <= yb AND xa <= xb")
    px = boxes.withColumn("y", F.explode(F.sequence("ya", "yb"))).withColumn("x", F.explode(F.sequence("xa", "xb")))
    cx, cy, dx, dy = F.col("x") + 0.5, F.col("y") + 0.5, F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    square = dx * dx + dy * dy
    t = F.when(square > 1e-6, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((cx - F.col("x0")) * dx + (cy - F.col("y0")) * dy) / square))).otherwise(F.lit(0.0))
    near = (cx - F.col("x0") - t * dx) ** 2 + (cy - F.col("y0") - t * dy) ** 2 <= F.col("radius") * F.col("radius")
    return px.where(near).groupBy("sample_id", "fiber_id", "y", "x").agg(F.max("intensity").alias("intensity"))


def accumulated(members: DataFrame) -> DataFrame:
    """Source intensity and overlap count of each pixel from the membership table."""
    return members.groupBy("sample_id", "y", "x").agg(F.sum("intensity").alias("source"), F.count(F.lit(1)).alias("overlap"))


def crossing_hits(segments: DataFrame, nodes: DataFrame, cell: float = 32.0) -> DataFrame:
    """Intersections of segments of different strands that share no node: ``sample_id, a, b, seq_a, seq_b, x, y``.

    Segments meet only where their boxes do: each is put into the grid cells
    that its box touches and joined on the cell, not with all others.
    ``nodes`` has ``sample_id, fiber_id, node``; strands with a common node are
    excluded by an anti join.
    """
    span = lambda p, q: F.explode(F.sequence(F.floor(F.least(p, q) / cell).cast("int"), F.floor(F.greatest(p, q) / cell).cast("int")))
    placed = segments.select("sample_id", "fiber_id", "seq", "x0", "y0", "x1", "y1").withColumn("gx", span("x0", "x1")).withColumn("gy", span("y0", "y1"))
    a = placed.select("sample_id", "gx", "gy", F.col("fiber_id").alias("a"), F.col("seq").alias("seq_a"), *[F.col(c).alias("a" + c) for c in ("x0", "y0", "x1", "y1")])
    b = placed.select("sample_id", "gx", "gy", F.col("fiber_id").alias("b"), F.col("seq").alias("seq_b"), *[F.col(c).alias("b" + c) for c in ("x0", "y0", "x1", "y1")])
    pairs = a.join(b, ["sample_id", "gx", "gy"]).where("a < b")
    n = nodes.select("sample_id", "fiber_id", "node").distinct()
    common = n.select("sample_id", F.col("fiber_id").alias("a"), "node").join(n.select("sample_id", F.col("fiber_id").alias("b"), "node"), ["sample_id", "node"]).where("a < b").select("sample_id", "a", "b").distinct()
    pairs = pairs.join(common, ["sample_id", "a", "b"], "left_anti")
    dax, day, dbx, dby = F.col("ax1") - F.col("ax0"), F.col("ay1") - F.col("ay0"), F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0")
    det, gx, gy = dax * dby - day * dbx, F.col("bx0") - F.col("ax0"), F.col("by0") - F.col("ay0")
    hit = pairs.withColumn("det", det).where(F.abs("det") >= 1e-6).withColumn("t", (gx * dby - gy * dbx) / F.col("det")).withColumn("u", (gx * day - gy * dax) / F.col("det")).where("t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1")
    return hit.groupBy("sample_id", "a", "b", "seq_a", "seq_b").agg(F.min(F.col("ax0") + F.col("t") * dax).alias("x"), F.min(F.col("ay0") + F.col("t") * day).alias("y"))


def spaced_crossings(hits: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Crossings of each sample in order, without those near an earlier one: an ordered fold per sample."""
    kind = hits.schema["sample_id"].dataType.simpleString()

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[float, float]] = []
        for x, y in f.sort_values(["a", "b", "seq_a", "seq_b"], kind="stable")[["x", "y"]].itertuples(index=False):
            if not kept or ((np.asarray(kept) - (x, y)) ** 2).sum(1).min() > tolerance**2:
                kept.append((x, y))
        return pd.DataFrame({"sample_id": [f["sample_id"].iloc[0]] * len(kept), "x": [p[0] for p in kept], "y": [p[1] for p in kept]})

    return hits.groupBy("sample_id").applyInPandas(lambda f: fold(f), f"sample_id {kind}, x double, y double")


GEOMETRY_SCHEMA = "sample_index int, fibers array<struct<fiber_id:int,width:double,intensity:double,truncated_start:boolean,truncated_end:boolean,start_node:int,end_node:int,points:array<struct<x:double,y:double>>>>, nodes array<struct<node:int,kind:string,x:double,y:double>>"


def geometries(indices: DataFrame, config: dict) -> DataFrame:
    """Geometry of each ``sample_index`` as nested arrays; samples are independent and seeded by their index."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i in b["sample_index"]:
                g = strands.draw_geometry(config, int(i))
                fibers = [(s["id"], s["width"], s["intensity"], *s["cut"], *s["nodes"], [(float(x), float(y)) for x, y in s["points"]]) for s in g.strands]
                rows.append((int(i), fibers, [(n, kind, *xy) for n, (xy, kind) in enumerate(g.nodes)]))
            yield pd.DataFrame(rows, columns=["sample_index", "fibers", "nodes"])

    return indices.mapInPandas(run, GEOMETRY_SCHEMA)


def geometry_segments(geometry: DataFrame) -> DataFrame:
    """Segment table of nested geometries: ``SEGMENTS``."""
    f = geometry.select(F.col("sample_index").alias("sample_id"), F.explode("fibers").alias("f"))
    seg = f.select("sample_id", "f", F.posexplode(F.arrays_zip(F.slice("f.points", F.lit(1), F.size("f.points") - 1).alias("p"), F.slice("f.points", F.lit(2), F.size("f.points") - 1).alias("q"))).alias("seq", "s"))
    return seg.select("sample_id", F.col("f.fiber_id").alias("fiber_id"), "seq", F.col("s.p.x").alias("x0"), F.col("s.p.y").alias("y0"), F.col("s.q.x").alias("x1"), F.col("s.q.y").alias("y1"), (F.col("f.width") / 2).alias("radius"), F.col("f.intensity").alias("intensity"))


def geometry_nodes(geometry: DataFrame) -> DataFrame:
    """``sample_id, fiber_id, node`` of nested geometries."""
    f = geometry.select(F.col("sample_index").alias("sample_id"), F.explode("fibers").alias("f"))
    return f.select("sample_id", F.col("f.fiber_id").alias("fiber_id"), F.explode(F.array("f.start_node", "f.end_node")).alias("node"))


SAMPLE_SCHEMA = "sample_id string, sample_index int, npz binary, npz_sha256 string, arrays array<string>, counts map<string,double>"


def _packed(sample_id: str, index: int, arrays: dict, counts: dict) -> tuple:
    import hashlib

    data = npz_bytes(arrays)
    return sample_id, index, data, hashlib.sha256(data).hexdigest(), sorted(arrays), {k: float(v) for k, v in counts.items()}


def samples(indices: DataFrame, config: dict) -> DataFrame:
    """Complete procedural samples, one row each with its NPZ bytes and hash."""
    name = config.get("dataset_name", "synthetic_sted")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([_packed(f"{name}_{i:04d}", int(i), *strands.build_sample(config, int(i))) for i in b["sample_index"]], columns=[c.split()[0] for c in SAMPLE_SCHEMA.split(", ")])

    return indices.mapInPandas(run, SAMPLE_SCHEMA)


def composites(blanks: DataFrame, config: dict) -> DataFrame:
    """Samples composited onto real backgrounds; ``blanks`` are decoded images with ``sample_index``."""
    name = config.get("dataset_name", "sted_blank_composite")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [_packed(f"{name}_{r['sample_index']:04d}", int(r["sample_index"]), *strands.build_composite(config, int(r["sample_index"]), array_of(r["height"], r["width"], r["channels"], r["dtype"], r["pixels"]))) for r in b.to_dict("records")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SAMPLE_SCHEMA.split(", ")])

    return blanks.select("sample_index", "height", "width", "channels", "dtype", "pixels").mapInPandas(run, SAMPLE_SCHEMA)


def sample_violations(rows: DataFrame, config: dict | None = None, landmarks: bool = True) -> DataFrame:
    """``rule, entity, message`` of samples: arrays, memberships, masks, landmarks and, with ``config``, regeneration."""
    def problems(r) -> Iterator[tuple[str, str]]:
        with np.load(io.BytesIO(r["npz"]), allow_pickle=False) as z:
            a = {n: z[n] for n in z.files}
        lost = sorted(set(strands.REQUIRED_ARRAYS) - set(a))
        if lost:
            yield "required_arrays", f"missing {lost}"
            return
        count = np.zeros_like(a["overlap_count"])
        np.add.at(count, (a["membership_y"], a["membership_x"]), 1)
        if (count != a["overlap_count"]).any():
            yield "overlap", "overlap_count differs from the memberships"
        if (a["semantic_mask"] != (a["overlap_count"] > 0)).any():
            yield "semantic_mask", "mask is not the union of the memberships"
        for name, there in () if not landmarks else (("crossing", len(a["geometric_crossing_points_xy"])), ("junction", a["junction_map"].any()), ("endpoint", a["endpoint_map"].any()), ("truncated", a["edge_truncated_start"].any() or a["edge_truncated_end"].any())):
            if not there:
                yield name, f"no {name}"
        if config is not None:
            again, _ = strands.build_sample(config, int(r["sample_index"]))
            for n in strands.REQUIRED_ARRAYS:
                if not np.array_equal(a[n], again[n]):
                    yield "regeneration", f"{n} differs when built again"
                    return

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(rule, r["sample_id"], m) for r in b.to_dict("records") for rule, m in problems(r)], columns=["rule", "entity", "message"])

    return rows.select("sample_id", "sample_index", "npz").mapInPandas(run, "rule string, entity string, message string")


def export_samples(rows: DataFrame, folder: str) -> DataFrame:
    """Write the NPZ files from the executors to a shared folder; returns ``sample_id, npz_path, npz_sha256``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                put_bytes(folder, r["sample_id"] + ".npz", bytes(r["npz"]))
            yield pd.DataFrame({"sample_id": b["sample_id"], "npz_path": b["sample_id"] + ".npz", "npz_sha256": b["npz_sha256"]})

    return rows.select("sample_id", "npz", "npz_sha256").mapInPandas(run, "sample_id string, npz_path string, npz_sha256 string")


def background_reuse(rows: DataFrame, background: str, split: str) -> DataFrame:
    """Backgrounds that occur in more than one split."""
    return rows.groupBy(background).agg(F.array_join(F.array_sort(F.collect_set(split)), ";").alias("splits"), F.countDistinct(split).alias("n")).where("n > 1").select(background, "splits")


def sample_metadata(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Metadata documents as canonical JSON rows."""
    from ..sources.sinks import canonical_json

    return spark.createDataFrame([(e["sample_id"], canonical_json(e)) for e in entries], "sample_id string, document string")

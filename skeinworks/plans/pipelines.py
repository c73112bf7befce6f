"""End-to-end pipelines: image folders to inventory, roles, appearance tables, samples and composites."""

from __future__ import annotations

import datetime
import hashlib
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import documents, duplicates, images, kernels, literature, roles, rules, selection, strands, vectors
from ..session import checkpointed
from ..sources import files, sinks

#: Columns of the image manifest, the extra ones of blanks, and of the split and sample manifests.
IMAGE_COLUMNS = [
    "source_root_id", "relative_path", "source_kind", "source_sha256", "pixel_sha256", "stable_image_id", "shape_y", "shape_x", "frames", "channels", "dtype", "bit_depth",
    "min", "max", "mean", "std", *kernels.PERCENTILE_NAMES, "saturation_value", "saturation_count", "zero_count", "inferred_pn", "inferred_round", "inferred_condition", "inferred_div",
    "series_index", "acquisition_group", "biological_group_candidate", "file_duplicate_group", "pixel_duplicate_group", "thumbnail_duplicate_group", "near_duplicate_candidate_group",
    "near_duplicate_score", "near_duplicate_method", "validation_flags", "intended_split_status",
]
BLANK_COLUMNS = ["blank_status", "validation_source", "validator_role", "validation_date", "notes"]
SPLIT_COLUMNS = [
    "stable_image_id", "source_kind", "biological_group_candidate", "acquisition_group", "inferred_condition", "inferred_div", "inferred_round", "series_index", "eligibility",
    "primary_metric_role", "secondary_image_eval_role", "assignment_reason", "grouping_rule", "human_approved", "synthetic_split", "override_status", "override_reason",
]
SAMPLE_COLUMNS = ["sample_id", "npz_path", "npz_sha256", "json_path", "json_sha256", "schema_version", "generator_version"]
#: Constant cells of the manifests.
BLANK_PROVENANCE = {"blank_status": "expert_validated", "validation_source": "human_expert_review", "validator_role": "STED expert", "validation_date": "not_recorded", "notes": "Expert-validated fiber-free blank; automated flags are QC only."}
NEAR_THRESHOLD, NEAR_METHOD = 0.995, "normalized_thumbnail_ncc_threshold_0.995"
#: Measures that groups are compared by.
COMPARED = ["p50", "p99", "std", "zero_fraction", "saturation_fraction", "local_variance_p50", "row_variation", "column_variation", "high_frequency_residual_std", "radial_power_tail_median", "autocorrelation_tail_median", "directional_power_ratio"]


def inventory(spark: SparkSession, root: str, root_id: str, source_kind: str, near: float = NEAR_THRESHOLD) -> DataFrame:
    """Typed inventory of an image folder: one row per file, unreadable ones with nulls and a flag.

    Files are decoded once; hashes, statistics, flags and thumbnails come from
    that pass. Duplicate numbering and near-duplicate groups follow path order
    within the root.
    """
    decoded = checkpointed(files.decode_images(files.scan_files(spark, root), root_id, source_kind))
    shape = images.expected_shape(decoded)
    profiles = checkpointed(images.profile_images(decoded, shape))
    names = X.name_parts(F.col("relative_path"))
    head = decoded.select("source_root_id", "relative_path", "source_kind", "source_sha256", F.col("height").alias("shape_y"), F.col("width").alias("shape_x"), "frames", "channels", "dtype", "error", names.alias("n"))
    head = head.withColumn("stable_image_id", X.stable_id(F.col("source_root_id"), F.col("relative_path"), F.col("source_sha256")))
    bits = F.regexp_extract("dtype", r"(\d+)$", 1).cast("int")
    rows = head.join(profiles.drop("source_root_id"), "relative_path", "left").withColumn("bit_depth", bits).withColumn("path_order", F.split("relative_path", "/"))
    for value, group in (("source_sha256", "file_duplicate_group"), ("pixel_sha256", "pixel_duplicate_group"), ("thumbnail_hash", "thumbnail_duplicate_group")):
        rows = duplicates.number_duplicates(rows, "source_root_id", "path_order", value, group, group)
    rows = checkpointed(rows.withColumn("shape", F.concat_ws("x", "shape_y", "shape_x")))
    pairs = duplicates.near_pairs(rows.where("thumbnail IS NOT NULL"), near, "relative_path", "thumbnail", "shape", "thumbnail_duplicate_group")
    order = lambda c: F.split(c, "/")
    least, most = F.least(F.struct(order("left").alias("o"), F.col("left").alias("p")), F.struct(order("right").alias("o"), F.col("right").alias("p"))), F.greatest(F.struct(order("left").alias("o"), F.col("left").alias("p")), F.struct(order("right").alias("o"), F.col("right").alias("p")))
    ordered = pairs.select(F.lit(root_id).alias("scope"), least.alias("a"), most.alias("b"), "score").select("scope", F.array_join("a.o", "\x01").alias("i"), F.array_join("b.o", "\x01").alias("j"), F.col("a.p").alias("left"), F.col("b.p").alias("right"), "score")
    near_groups = duplicates.fold_pairs(ordered, "scope", "near_duplicate_candidate").select(F.col("id").alias("relative_path"), F.col("group").alias("near_duplicate_candidate_group"), F.col("score").alias("near_duplicate_score"))
    flags = F.when(F.col("error").isNotNull(), F.array(F.concat(F.lit("unreadable:"), "error"))).otherwise(F.col("flags"))
    out = rows.join(near_groups, "relative_path", "left").withColumn("validation_flags", flags).withColumn("near_duplicate_method", F.lit(NEAR_METHOD)).withColumn("intended_split_status", F.lit("unassigned"))
    out = out.select("*", *[F.col(f"n.{c}").alias(c) for c in ("inferred_pn", "inferred_round", "inferred_condition", "inferred_div", "series_index", "acquisition_group", "biological_group_candidate")])
    extra = {k: F.when(F.col("source_kind") == "blank_background", F.lit(v)) for k, v in BLANK_PROVENANCE.items()}
    return out.withColumns(extra).select(*IMAGE_COLUMNS, *BLANK_COLUMNS)


def manifest_cells(rows: DataFrame) -> DataFrame:
    """Text cells of a manifest: numbers formatted, nulls as the word that says why they are missing."""
    unread = F.exists(F.coalesce(F.col("validation_flags"), F.array().cast("array<string>")), lambda x: x.startswith("unreadable:"))
    doubles = [f.name for f in rows.schema if f.dataType.typeName() == "double"]
    cells = {c: X.number_text(F.col(c), whole=True) for c in doubles}
    cells |= {c: F.coalesce(F.col(c), F.lit("none")) for c in rows.columns if c.endswith("_group") and c.split("_")[0] in ("file", "pixel", "thumbnail", "near")}
    cells["near_duplicate_score"] = F.coalesce(cells["near_duplicate_score"], F.lit("not_applicable"))
    cells["validation_flags"] = F.when(F.size("validation_flags") > 0, F.array_join("validation_flags", ";")).otherwise("none")
    for c in ["shape_y", "shape_x", "frames", "channels", "dtype", "bit_depth", "min", "max", "mean", "std", *kernels.PERCENTILE_NAMES, "saturation_value", "saturation_count", "zero_count"]:
        cells[c] = F.when(unread, F.lit("not_readable")).otherwise(cells.get(c, F.col(c)).cast("string"))
    cells["pixel_sha256"] = F.coalesce("pixel_sha256", F.lit("not_available"))
    return rows.select([cells.get(c, F.col(c)).alias(c) for c in rows.columns])


def run_inventory(spark: SparkSession, fiber_dir: str, blank_dir: str, out: str) -> tuple[DataFrame, DataFrame]:
    """Inventories of a fiber and a blank folder with manifests, acquisition groups and a report."""
    both = []
    for name, root, root_id, kind in (("sted_images", fiber_dir, "sted_fiber_data", "fiber_image"), ("sted_blanks", blank_dir, "sted_blank_data", "blank_background")):
        rows = checkpointed(inventory(spark, root, root_id, kind))
        rows.write.mode("overwrite").parquet(f"{out}/{name}.parquet")
        columns = IMAGE_COLUMNS + (BLANK_COLUMNS if kind == "blank_background" else [])
        sinks.write_csv_file(manifest_cells(rows).orderBy(F.split("relative_path", "/")), f"{out}/{name}.csv", columns)
        both.append(rows)
    groups = roles.group_members(both[0].unionByName(both[1]), ["source_kind", "biological_group_candidate", "acquisition_group"], {"root_ids": "source_root_id", "conditions": "inferred_condition", "divs": "inferred_div", "rounds": "inferred_round"})
    groups = groups.withColumnRenamed("n_rows", "image_count").orderBy("source_kind", "biological_group_candidate", "acquisition_group")
    sinks.write_csv_file(groups, f"{out}/acquisition_groups.csv", ["source_kind", "biological_group_candidate", "acquisition_group", "image_count", "root_ids", "conditions", "divs", "rounds"])
    sinks.write_or_check({f"{out}/data_inventory.md": inventory_report(both)})
    return both[0], both[1]


def inventory_report(tables: list[DataFrame]) -> str:
    """Markdown summary of inventories; only aggregates reach the driver."""
    rows = []
    for t in tables:
        s = t.agg(F.first("source_kind").alias("kind"), F.count(F.lit(1)).alias("n"), F.count("dtype").alias("ok"), F.coalesce(F.sum(F.col("shape_y").cast("long") * F.col("shape_x")), F.lit(0)).alias("px"), F.coalesce(F.sum("saturation_count"), F.lit(0)).alias("sat")).first()
        flags = {r["flag"]: r["n"] for r in roles.flag_counts(t, "validation_flags").orderBy("flag").collect()}
        rows.append((s["kind"], s["n"], s["ok"], s["px"], s["sat"], "; ".join(f"{k} {v}" for k, v in flags.items())))
    return "\n".join(["# Image inventory", "", *sinks.markdown_table(["Kind", "Files", "Readable", "Pixels", "Saturated", "Flags"], rows, right=[1, 2, 3, 4])]) + "\n"


def folder_percentiles(decoded: DataFrame, ps: list[float] | None = None) -> DataFrame:
    """Exact percentiles over all pixels of each root, from one histogram per image."""
    import numpy as np

    def histogram(a, _):
        v, n = np.unique(a, return_counts=True)
        return [{"v": float(x), "n": int(k)} for x, k in zip(v, n)]

    counts = images.map_images(decoded, histogram, "v double, n long", ["source_root_id"]).groupBy("source_root_id", "v").agg(F.sum("n").alias("n"))
    return counts.groupBy("source_root_id").agg(F.percentile("v", F.array(*[F.lit(p / 100) for p in ps or kernels.PERCENTILES]), F.col("n")).alias("percentiles"))


def create_splits(*inventories: DataFrame) -> DataFrame:
    """Split rows of inventories: roles by sample group, one role for all rows of a group."""
    wanted = ["stable_image_id", "source_kind", "biological_group_candidate", "acquisition_group", "inferred_condition", "inferred_div", "inferred_round", "series_index"]
    given = lambda i, c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) if c in i.columns else F.lit("unknown").alias(c)
    rows = reduce(DataFrame.unionByName, [i.select(*wanted[:4], *[given(i, c) for c in wanted[4:]]) for i in inventories])
    rows = roles.allocate_roles(rows, "biological_group_candidate").withColumnRenamed("role", "eligibility")
    constant = {"secondary_image_eval_role": "not_assigned", "grouping_rule": "pn_holdout_primary", "human_approved": "false", "override_status": "none", "override_reason": "none"}
    rows = rows.withColumns({k: F.lit(v) for k, v in constant.items()}).withColumn("primary_metric_role", F.col("eligibility")).withColumn("assignment_reason", roles.role_reason(F.col("eligibility")))
    return rows.withColumn("synthetic_split", F.when(F.col("source_kind") == "blank_background", F.col("eligibility")).otherwise("not_applicable")).select(*SPLIT_COLUMNS)


def write_splits(splits: DataFrame, path: str) -> None:
    """The split manifest as one CSV, ordered by group, kind, acquisition group and id."""
    sinks.write_csv_file(splits.orderBy("biological_group_candidate", "source_kind", "acquisition_group", "stable_image_id"), path, SPLIT_COLUMNS)


def split_report(splits: DataFrame, least: int = 3) -> str:
    """Markdown of allocation, split sizes and strata, from one grouping-sets pass and a group table."""
    levels = [["eligibility"], ["inferred_condition", "inferred_div"], ["eligibility", "inferred_condition", "inferred_div"]]
    strata = roles.strata_report(splits, levels, "biological_group_candidate", least).orderBy("level", "eligibility", "inferred_condition", "inferred_div").collect()
    groups = roles.group_members(splits, ["biological_group_candidate"], {"r": "eligibility", "k": "source_kind", "c": "inferred_condition", "d": "inferred_div"}).orderBy("biological_group_candidate").toLocalIterator()
    lines = ["# Split report", "", "## Groups", "", *sinks.markdown_table(["Group", "Split", "Kinds", "Images", "Conditions", "DIVs"], ((g[0], g["r"], g["k"], g["n_rows"], g["c"], g["d"]) for g in groups), right=[3])]
    for i, (title, head) in enumerate((("Splits", ["Split"]), ("Strata", ["Condition", "DIV"]), ("Split strata", ["Split", "Condition", "DIV"]))):
        body = [(*[r[c] for c in levels[i]], r["n_groups"], r["n_rows"], f"too_few_independent_groups_lt_{least}" if r["thin"] else "none") for r in strata if r["level"] == i]
        lines += ["", f"## {title}", "", *sinks.markdown_table([*head, "Groups", "Images", "Warning"], body, right=[len(head), len(head) + 1])]
    return "\n".join(lines) + "\n"


def validate_inventory(rows: DataFrame, folder: DataFrame | None = None) -> DataFrame:
    """Violations of an inventory; with ``folder`` (``scan_files``) also against the files on disk."""
    checks = [*rules.inventory_rules(), rules.has_columns("columns", "images", IMAGE_COLUMNS)]
    checks += [rules.check("blank_provenance", "images", (F.col("source_kind") == "blank_background") & ~F.col(c).eqNullSafe(v), "stable_image_id", f"invalid {c}") for c, v in BLANK_PROVENANCE.items() if c != "notes" and c in rows.columns]
    tables = {"images": rows}
    if folder is not None:
        tables["files"] = folder.select("relative_path", F.sha2("content", 256).alias("source_sha256"))
        checks += rules.file_rules("images", "files")
    return rules.run_rules(checks, tables)


def validate_splits(splits: DataFrame, *inventories: DataFrame) -> DataFrame:
    """Violations of split rows against their inventories."""
    ids = reduce(DataFrame.unionByName, [i.select("stable_image_id") for i in inventories])
    extra = [
        rules.in_domain("human_approved", "splits", "human_approved", ["false"], "stable_image_id"), rules.in_domain("grouping_rule", "splits", "grouping_rule", ["pn_holdout_primary"], "stable_image_id"),
        rules.check("holdout_reason", "splits", (F.col("source_kind") == "fiber_image") & (F.col("eligibility") == "held_out_test") & ~F.col("assignment_reason").rlike("holdout|held-out"), "stable_image_id", "held_out_test lacks a holdout reason"),
    ]
    return rules.run_rules([*rules.split_rules(), *extra], {"splits": splits, "inventory": ids})


def characterize(decoded: DataFrame, rows: DataFrame, subset: int = 48, sigmas: list[float] | None = None, **options) -> dict[str, DataFrame]:
    """Statistics, proxies and decompositions of an evenly spaced subset of each kind, from decoded images.

    ``rows`` has ``stable_image_id, source_kind, relative_path, source_root_id``.
    """
    kinds = [r[0] for r in rows.select("source_kind").distinct().collect()]
    chosen = reduce(DataFrame.unionByName, [selection.spaced_subset(rows.where(F.col("source_kind") == k), "stable_image_id", subset) for k in kinds])
    keys = ["stable_image_id", "source_kind", "relative_path"]
    held = checkpointed(decoded.drop("source_kind", "source_sha256").join(chosen.select(*keys, "source_root_id"), ["source_root_id", "relative_path"]))
    return {
        "statistics": images.image_statistics(held, keys, **options), "proxies": images.image_proxies(held, keys),
        "decompositions": images.decompositions(held.where("source_kind = 'blank_background'"), keys, sigmas or [8.0, 16.0, 32.0], **{k: v for k, v in options.items() if k in ("size", "bins")}),
    }


def appearance_summary(statistics: DataFrame, group: str = "source_kind", fields: list[str] | None = None) -> DataFrame:
    """Median, IQR and tails of the compared measures per group."""
    return selection.measure_summary(statistics, [group], fields or COMPARED)


def appearance_report(summary: DataFrame, group: str, groups: list[str], base: str) -> str:
    """Markdown of the median table and of the differences to a base group."""
    fields = COMPARED[:8]
    table = {r["field"]: r for r in selection.median_table(summary, group, groups).collect()}
    text = lambda v: "n/a" if v is None else f"{v:.4g}"
    lines = ["# Appearance report", "", *sinks.markdown_table(["Measure", *groups], [(f, *[text(table[f][g]) if f in table else "n/a" for g in groups]) for f in fields], right=range(1, len(groups) + 1)), "", "## Differences", ""]
    for r in selection.group_differences(summary, group, base, [g for g in groups if g != base]).orderBy("field", group).collect():
        lines.append(f"- `{r['field']}`: {r[group]} minus {base} = `{r['difference']:.4g}`")
    return "\n".join(lines) + "\n"


#: States of calibration data, and of artifacts that may still change.
DATA_STATUSES = ["exploratory_unpartitioned", "exploratory_provisional_split", "approved_calibration_subset", "held_out_excluded"]
EXPLORATORY = ["exploratory_unpartitioned", "exploratory_provisional_split"]
#: Files of a complete set of calibration artifacts.
ARTIFACT_FILES = ["real_fiber_stats.csv", "blank_stats.csv", "proxy_stats.csv", "background_decomposition_stats.csv", "appearance_summary.json"]
#: States of procedural samples, and what their metadata say of coordinates and rasters.
SAMPLE_STATUS, NO_BLANK = "procedural_unmatched", "not_applicable"
COORDINATES = {"indexing": "zero_based", "units": "pixels", "xy_order": "x_y", "pixel_center": "pixel (x, y) is centered at (x + 0.5, y + 0.5)"}
RASTER_RULES = {
    "semantic_mask": "union of all clean finite-width instance supports before PSF blur",
    "overlap_count": "number of instance memberships per pixel before PSF blur",
    "crossing_map": "raster disks around disconnected centerline intersections",
    "junction_map": "raster disks around true graph junction nodes",
    "canonical_instance_membership": "sparse pixel-to-instance coordinate table",
}
ALIGNMENT = "structural targets are unchanged during real-blank compositing"
VERSIONS = {"schema_version": "1", "generator_version": "skeinworks-1"}


def artifact_metadata(kind: str, config: dict, inputs: dict[str, str], source_ids: list[str], status: str, today: str | None = None, version: str | None = None) -> dict:
    """Provenance document: input hashes (``missing`` for absent files), configuration, version, date and status."""
    if status not in DATA_STATUSES:
        raise ValueError(f"invalid status: {status}")
    hashes = {n: hashlib.sha256(Path(p).read_bytes()).hexdigest() if Path(p).exists() else "missing" for n, p in inputs.items()}
    return {
        "artifact_kind": kind, "source_manifest_version": hashes, "source_image_ids": source_ids, "calibration_data_status": status, "calibration_status": status, "configuration": config,
        "code_version": version or files.code_version(), "date_generated": today or datetime.date.today().isoformat(), "result_status": "exploratory" if status.startswith("exploratory") else "approved",
    }


def validate_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Violations of a folder of calibration artifacts: absent files and the state in its summary."""
    found = files.scan_files(spark, folder, "*.{csv,json}").select("relative_path", "content")
    wanted = spark.createDataFrame([(x,) for x in ARTIFACT_FILES], "relative_path string")
    lost = wanted.join(found.select("relative_path"), "relative_path", "left_anti")
    status = F.get_json_object(F.decode("content", "UTF-8"), "$.metadata.calibration_status")
    summary = found.where("relative_path = 'appearance_summary.json'").select("relative_path", F.coalesce(status, F.lit("none")).alias("status"))
    v = rules.violations
    return reduce(DataFrame.unionByName, [
        v(lost, "artifact_missing", "relative_path", "calibration artifact is missing"),
        v(summary.where(~F.col("status").isin(DATA_STATUSES)), "artifact_status", "relative_path", F.concat(F.lit("unknown state "), "status")),
        v(summary.where(F.col("status").isin(DATA_STATUSES) & ~F.col("status").isin(EXPLORATORY)), "artifact_final", "relative_path", "artifacts must stay exploratory"),
    ])


def validate_composites(spark: SparkSession, folder: str) -> DataFrame:
    """Violations of a folder of composites: checksums, arrays, state, provenance, and backgrounds used in several splits."""
    manifest = files.read_csv(spark, f"{folder}/dataset_manifest.csv")
    disk = files.scan_files(spark, folder, "*.json").select(F.col("relative_path").alias("json_path"), F.decode("content", "UTF-8").alias("doc"))
    at = lambda path: F.get_json_object("doc", f"$.{path}")
    docs = checkpointed(manifest.join(disk, "json_path").select("sample_id", at("calibration_status").alias("status"), at("source_blank_provenance").alias("blank"), at("source_blank_provenance.blank_stable_image_id").alias("blank_id"), at("synthetic_split").alias("split")))
    v = rules.violations
    return reduce(DataFrame.unionByName, [
        _file_violations(spark, manifest, folder).unionByName(vectors.sample_violations(_packed_files(spark, manifest, folder), landmarks=False)),
        v(docs.where(~F.coalesce(F.col("status").isin(EXPLORATORY), F.lit(False))), "calibration_status", "sample_id", "a composite must be exploratory"),
        v(docs.where(F.coalesce("blank", F.lit(NO_BLANK)) == NO_BLANK), "blank_provenance", "sample_id", "no provenance of the blank"),
        v(vectors.background_reuse(docs.where("blank_id IS NOT NULL"), "blank_id", "split"), "blank_reuse", "blank_id", F.concat(F.lit("used in several splits: "), "splits")),
    ])


def generate_samples(spark: SparkSession, config: dict, out: str) -> DataFrame:
    """Procedural samples as NPZ and JSON files with a manifest; samples are built and written by the executors."""
    status = config.get("calibration_status", SAMPLE_STATUS)
    if status != SAMPLE_STATUS:
        raise ValueError(f"invalid calibration status: {status}")
    built = checkpointed(vectors.samples(files.sample_range(spark, int(config.get("sample_count", 8))), config))
    geometry, look, targets = config.get("geometry", {}), config.get("rendering", {}), config.get("targets", {})
    more = {
        "calibration_status": status, "source_blank_provenance": NO_BLANK, "split": config.get("split", "training"), "geometry_parameters": geometry, "appearance_parameters": look,
        "image_shape": geometry.get("image_shape", [1024, 1024]), "coordinate_conventions": COORDINATES, "rasterization_rules": RASTER_RULES,
        "tolerance_radii": {f"{k}_radius_px": targets.get(f"{k}_radius_px", v) for k, v in strands.TARGET_RADII.items()} | {"psf_ambiguity_threshold": "not_implemented_in_mvp"},
    }
    seeds = {"geometry_seed": int(geometry.get("base_seed", 1234)), "rendering_seed": int(look.get("base_seed", 5678))}
    return _write_samples(spark, built, config, out, more, seeds, {})


def generate_composites(spark: SparkSession, config: dict, blanks: DataFrame, splits: DataFrame, decoded: DataFrame, out: str) -> DataFrame:
    """Samples on the first blanks of the configured split; ``blanks`` is the blank inventory, ``decoded`` its images."""
    mix, geometry = config.get("compositing", {}), config.get("geometry", {})
    count = int(mix.get("sample_count", 8))
    wanted = splits.where((F.col("source_kind") == "blank_background") & (F.col("synthetic_split") == mix.get("synthetic_split", "calibration"))).select("stable_image_id")
    top = selection.first_rows(selection.must_match(wanted, blanks, "stable_image_id"), "stable_image_id", count)
    numbered = checkpointed(top.withColumn("sample_index", (F.row_number().over(W.orderBy("stable_image_id")) - 1).cast("int")))  # at most 16 rows
    held = decoded.select("source_root_id", "relative_path", "height", "width", F.col("channels"), F.col("dtype"), "pixels").join(F.broadcast(numbered.select("source_root_id", "relative_path", "sample_index")), ["source_root_id", "relative_path"])
    built = checkpointed(vectors.composites(held, config))
    status = config.get("calibration_data_status", EXPLORATORY[0])
    own = {}
    for r in numbered.select("sample_index", "source_root_id", "stable_image_id", "relative_path", "source_sha256", "acquisition_group", "shape_y", "shape_x", "blank_status").collect():
        own[r["sample_index"]] = artifact_metadata("real_blank_composite_sample", config, {}, [r["stable_image_id"]], status) | {
            "source_blank_provenance": {
                "source_root_id": r["source_root_id"], "blank_stable_image_id": r["stable_image_id"], "blank_relative_path": r["relative_path"], "blank_sha256": r["source_sha256"], "blank_acquisition_group": r["acquisition_group"],
                "crop_coordinates": [0, 0, r["shape_x"], r["shape_y"]], "blank_status": r["blank_status"] or BLANK_PROVENANCE["blank_status"],
            }
        }
    more = {"synthetic_split": mix.get("synthetic_split", "calibration"), "geometry_parameters": geometry, "renderer_configuration": config.get("real_blank_rendering", {}), "compositor_configuration": mix, "alignment_statement": ALIGNMENT}
    seeds = {"geometry_seed": int(geometry.get("base_seed", 1234)), "rendering_seed": int(mix.get("base_seed", 43001)), "compositing_seed": int(mix.get("base_seed", 43001))}
    return _write_samples(spark, built, config, out, more, seeds, own)


def _write_samples(spark: SparkSession, built: DataFrame, config: dict, out: str, more: dict, seeds: dict[str, int], own: dict[int, dict]) -> DataFrame:
    """NPZ, metadata and manifest of 8 to 16 samples; ``seeds`` are those of sample 0, ``own`` are parts by sample index."""
    written = vectors.export_samples(built, out).collect()
    layout: dict[str, dict] = {}
    for r in files.read_npz(built.select(F.col("sample_id").alias("relative_path"), F.col("npz").alias("content"))).select("relative_path", "name", "dtype", "shape").collect():
        layout.setdefault(r["relative_path"], {})[r["name"]] = (r["dtype"].lstrip("<>|="), r["shape"])
    extra = {r["sample_id"]: r for r in built.select("sample_id", "sample_index", "arrays", "counts").collect()}
    names = {k: config.get(k, v) for k, v in VERSIONS.items()}
    rows = []
    for r in sorted(written, key=lambda r: r["sample_id"]):
        e, shapes = extra[r["sample_id"]], layout[r["sample_id"]]
        counts = dict(e["counts"])
        doc = {
            "sample_id": r["sample_id"], "sample_index": e["sample_index"], "dataset_schema_version": names["schema_version"], "generator_version": names["generator_version"], "generation_config": config,
            "array_names": e["arrays"], "dtypes": {k: v[0] for k, v in shapes.items()}, "shapes": {k: list(v[1]) for k, v in shapes.items()}, "enum_mappings": {"node_type": strands.NODE_KINDS},
            "rendering_report": counts, "clipping_count": int(counts.get("clipped_low_count", 0) + counts.get("clipped_high_count", 0)), "saturation_count": int(counts.get("saturation_count", 0)),
            "integrity_checksum": {"npz_sha256": r["npz_sha256"]}, **{k: v + e["sample_index"] for k, v in seeds.items()}, **more, **own.get(e["sample_index"], {}),
        }
        text = sinks.canonical_json(doc).encode()
        sinks.put_bytes(out, f"{r['sample_id']}.json", text)
        rows.append((r["sample_id"], r["npz_path"], r["npz_sha256"], f"{r['sample_id']}.json", hashlib.sha256(text).hexdigest(), *names.values()))
    manifest = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in SAMPLE_COLUMNS))
    sinks.write_csv_file(manifest, f"{out}/dataset_manifest.csv", SAMPLE_COLUMNS)
    return manifest


def _file_violations(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    disk = files.scan_files(spark, folder, "*.{npz,json}").select("relative_path", F.sha2("content", 256).alias("hash"))
    listed = manifest.select(F.col("npz_path").alias("relative_path"), F.col("npz_sha256").alias("hash")).unionByName(manifest.select(F.col("json_path").alias("relative_path"), F.col("json_sha256").alias("hash")))
    return rules.run_rules([rules.same_on_both("checksum", "manifest", "files", "relative_path", ["hash"])], {"manifest": listed, "files": disk})


def _packed_files(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    disk = files.scan_files(spark, folder, "*.npz").select(F.col("relative_path").alias("npz_path"), F.col("content").alias("npz"))
    index = F.regexp_extract("sample_id", r"_(\d+)$", 1).cast("int")
    return manifest.join(disk, "npz_path").select("sample_id", index.alias("sample_index"), "npz")


def validate_sample_folder(spark: SparkSession, folder: str, config: dict | None = None, metadata: bool = False) -> DataFrame:
    """Violations of a sample folder: manifest, checksums of both files, arrays, and regeneration with ``config``.

    With ``metadata`` also the versions, state and provenance that the JSON files of procedural samples must name.
    """
    manifest = files.read_csv(spark, f"{folder}/dataset_manifest.csv")
    found = _file_violations(spark, manifest, folder).unionByName(vectors.sample_violations(_packed_files(spark, manifest, folder), config))
    if not metadata:
        return found
    docs = files.scan_files(spark, folder, "*.json").select(F.col("relative_path").alias("json_path"), F.decode("content", "UTF-8").alias("doc")).join(manifest.select("json_path", "sample_id"), "json_path")
    names = {k: (config or {}).get(k, v) for k, v in VERSIONS.items()}
    wanted = {"dataset_schema_version": names["schema_version"], "generator_version": names["generator_version"], "calibration_status": SAMPLE_STATUS, "source_blank_provenance": NO_BLANK}
    return reduce(DataFrame.unionByName, [found, *[rules.violations(docs.where(~F.get_json_object("doc", f"$.{k}").eqNullSafe(v)), k, "sample_id", f"must be {v}") for k, v in wanted.items()]])


#: Nested fields of a literature card that make a comparison row.
COMPARISON = {"cite_key": "cite_key", **{c: f"bibliography.{c}" for c in ("corpus_role", "study_type", "method_paradigms")}, **{c: f"comparison_summary.{c}" for c in ("task_focus", "architecture_family", "dimensionality", "main_targets", "losses", "data_strategy", "postprocessing", "evaluation_focus", "direct_sted_evidence", "best_use_case", "main_transfer_risk")}, "extraction_status": "provenance.extraction_status"}
SECTIONS = ["finding", "question", "hypothesis", "limitation"]


def comparison_table(cards: DataFrame, order: DataFrame) -> DataFrame:
    """Comparison rows of cards in the order of ``order`` (``cite_key, position``)."""
    return documents.flattened(cards, COMPARISON).join(F.broadcast(order.select("cite_key", "position")), "cite_key").orderBy("position").drop("position")


def synthesis(claims: DataFrame) -> str:
    """Markdown of all claims by section and id; the blocks are built by the executors."""
    place = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    lines, last = ["# Literature synthesis"], None
    for r in documents.claim_blocks(claims).orderBy(place, "claim_id").toLocalIterator():
        if r["section"] != last:
            lines += ["", f"## {r['section']}"]
            last = r["section"]
        lines += ["", r["block"]]
    return "\n".join(lines) + "\n"


def validate_records(cards: DataFrame, claims: DataFrame, manifest: DataFrame, schema: dict) -> DataFrame:
    """Violations of literature records.

    cards: ``cite_key, text`` (JSON); claims: ``claim_id, text`` and the arrays
    of evidence and papers; manifest: ``cite_key, pages, filename``.
    """
    nodes = checkpointed(documents.tree_nodes(cards, "cite_key", "text"))
    spans = cards.select("cite_key", F.explode(F.from_json(F.get_json_object("text", "$.evidence_spans"), "array<struct<evidence_id:string,source_pdf:string,page_pdf:int>>")).alias("s")).select("cite_key", "s.*")
    span_rows = spans.join(manifest, "cite_key", "left")
    cited = nodes.where("kind = 'string' AND path RLIKE '[.](evidence_ids|field_evidence[.][^.]+)\\\\[[0-9]+\\\\]$'").select("cite_key", "path", F.col("value").alias("evidence_id"))
    checked = cards.select("cite_key", F.explode(F.from_json(F.get_json_object("text", "$.missing_field_checks"), "array<struct<path:string>>")).alias("c")).select("cite_key", F.col("c.path").alias("at"))
    gaps = nodes.where("value = 'not_reported' AND path NOT LIKE '$.bibliography.%'").select("cite_key", F.expr("substring(path, 3)").alias("at"))
    links = claims.select("claim_id", F.explode(F.concat("supporting_evidence_ids", "limiting_evidence_ids")).alias("evidence_id"))
    v = rules.violations
    parts = [
        rules.unique("duplicate_card", "cards", "cite_key")({"cards": cards}), rules.unique("duplicate_claim", "claims", "claim_id")({"claims": claims}), rules.unique("duplicate_evidence", "spans", "evidence_id")({"spans": spans}),
        v(roles.unmatched(cards.select("cite_key"), manifest.select("cite_key"), "cite_key"), "card_keys", "cite_key", F.concat(F.lit("only on the "), "side", F.lit(" side"))),
        v(documents.schema_violations(cards, "cite_key", "text", schema), "card_schema", "cite_key", F.concat_ws(": ", "path", "message")),
        v(documents.schema_violations(claims, "claim_id", "text", schema, "#/$defs/synthesis_claim"), "claim_schema", "claim_id", F.concat_ws(": ", "path", "message")),
        v(nodes.where("kind = 'string' AND value = ''"), "empty_text", "cite_key", F.concat(F.lit("empty string at "), "path")),
        v(span_rows.where(~F.coalesce(F.col("page_pdf").between(1, F.col("pages")), F.lit(False))), "page", "cite_key", F.concat("evidence_id", F.lit(" has an invalid page"))),
        v(span_rows.where(~F.col("source_pdf").eqNullSafe(F.col("filename"))), "pdf", "cite_key", F.concat("evidence_id", F.lit(" refers to the wrong PDF"))),
        v(spans.where(~F.col("evidence_id").startswith(F.concat("cite_key", F.lit("-E")))), "prefix", "cite_key", F.concat("evidence_id", F.lit(" has the wrong prefix"))),
        v(cited.join(spans.select("cite_key", "evidence_id"), ["cite_key", "evidence_id"], "left_anti"), "unknown_evidence", "cite_key", F.concat("path", F.lit(" refers to "), "evidence_id")),
        v(gaps.join(checked, ["cite_key", "at"], "left_anti"), "unchecked_gap", "cite_key", F.concat("at", F.lit(" lacks checked locations"))),
        v(links.join(spans.select("evidence_id"), "evidence_id", "left_anti"), "claim_evidence", "claim_id", F.concat(F.lit("unknown evidence "), "evidence_id")),
        *[v(documents.foreign_evidence(claims, "claim_id", f"{k}_evidence_ids", f"{k}_papers"), f"{k}_papers", "claim_id", F.concat("evidence", F.lit(" belongs to no listed paper"))) for k in ("supporting", "limiting")],
    ]
    return reduce(DataFrame.unionByName, parts)


#: Columns of the comparison table.
COMPARISON_COLUMNS = list(COMPARISON)


def validate_knowledge_base(cards: DataFrame, claims: DataFrame, manifest: DataFrame, schema: dict, version: str, pdfs: DataFrame | None = None, table: DataFrame | None = None, outputs: dict[str, str] | None = None) -> DataFrame:
    """All violations of a literature corpus: records, manifest with its PDFs, provenance, claim set, table and generated files.

    ``table`` is the stored comparison table as text cells; ``outputs`` are the texts that the generated files must have, by path.
    """
    parts = [validate_records(cards, claims, manifest, schema), literature.manifest_violations(manifest, version, pdfs), literature.card_violations(cards, manifest), literature.claim_violations(claims, manifest)]
    if table is not None:
        parts.append(literature.table_drift(documents.projected(cards.join(manifest.select("cite_key"), "cite_key", "left_semi"), "text", COMPARISON), table, "cite_key", COMPARISON_COLUMNS))
    if outputs is not None:
        parts.append(literature.stale_outputs(cards.sparkSession, sinks.write_or_check(outputs, check=True)))
    return reduce(DataFrame.unionByName, parts)

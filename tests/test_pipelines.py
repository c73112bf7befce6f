"""Pipelines end to end on generated folders and records."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinworks.plans import pipelines as P
from skeinworks.sources import files, sinks, tiff


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    base = tmp_path_factory.mktemp("data")
    rng = np.random.default_rng(1)
    for kind, n in (("fibers", 4), ("blanks", 9)):
        d = base / kind
        d.mkdir()
        for i in range(n):
            a = rng.integers(0, 60, (64, 64)).astype(np.uint8) if kind == "fibers" else np.full((64, 64), 4 + i, np.uint8)
            (d / f"PN00{i % 5}_1R_AD_DIV0{i % 3} (Series {i}) [1].tif").write_bytes(tiff.write_pages([a]))
    (base / "fibers" / "broken.tif").write_bytes(b"xx")
    return base


@pytest.fixture(scope="module")
def tables(spark, folders):
    return P.run_inventory(spark, str(folders / "fibers"), str(folders / "blanks"), str(folders / "out"))


def test_inventory_manifests(spark, folders, tables):
    images, blanks = tables
    assert images.count() == 5 and blanks.count() == 9
    bad = images.where("dtype IS NULL").first()
    assert bad.validation_flags == ["unreadable:ValueError"] and bad.stable_image_id.startswith("img_") and bad.acquisition_group == "broken"
    csv = files.read_csv(spark, str(folders / "out" / "sted_images.csv"))
    assert csv.columns == P.IMAGE_COLUMNS
    row = csv.where("relative_path = 'broken.tif'").first()
    assert row["mean"] == "not_readable" and row.pixel_sha256 == "not_available" and row.file_duplicate_group == "none"
    assert csv.where("relative_path <> 'broken.tif'").first()["shape_y"] == "64"
    assert set(files.read_csv(spark, str(folders / "out" / "sted_blanks.csv")).select("blank_status").distinct().first()) == {"expert_validated"}
    assert "| fiber_image | 5 | 4 |" in (folders / "out" / "data_inventory.md").read_text()
    assert P.validate_inventory(images).count() == 0
    assert P.validate_inventory(images, files.scan_files(spark, str(folders / "fibers"))).count() == 0
    (folders / "fibers" / "extra.txt").write_text("x")
    assert [r.message for r in P.validate_inventory(images, files.scan_files(spark, str(folders / "fibers"))).collect()] == ["absent from images"]
    (folders / "fibers" / "extra.txt").unlink()


def test_splits_and_report(tables):
    splits = P.create_splits(*tables)
    assert splits.columns == P.SPLIT_COLUMNS and P.validate_splits(splits, *tables).count() == 0
    text = P.split_report(splits)
    assert "## Strata" in text and "too_few_independent_groups_lt_3" in text
    leaked = splits.withColumn("eligibility", F.when(F.col("source_kind") == "fiber_image", "validation").otherwise(F.col("eligibility")))
    assert "group_crosses_roles" in {r.rule for r in P.validate_splits(leaked, *tables).collect()}


def test_appearance(spark, folders, tables):
    decoded = files.decode_images(files.scan_files(spark, str(folders / "fibers")), "sted_fiber_data", "fiber_image").unionByName(files.decode_images(files.scan_files(spark, str(folders / "blanks")), "sted_blank_data", "blank_background"))
    rows = tables[0].unionByName(tables[1]).where("dtype IS NOT NULL")
    out = P.characterize(decoded, rows, 5, sigmas=[2.0, 4.0], block=16, sigma=4.0, size=32, bins=8)
    assert out["statistics"].count() == 9 and out["proxies"].count() == 9 and out["decompositions"].count() == 10
    summary = P.appearance_summary(out["statistics"])
    text = P.appearance_report(summary, "source_kind", ["fiber_image", "blank_background", "none"], "fiber_image")
    assert "| `p50`" not in text and "| p50 |" in text and "n/a" in text and "minus fiber_image" in text
    pooled = {r.source_root_id: r.percentiles for r in P.folder_percentiles(decoded, [0, 50, 100]).collect()}
    assert pooled["sted_blank_data"] == [4.0, 8.0, 12.0]


def test_samples_and_composites(spark, folders, tables):
    config = {"dataset_name": "made", "sample_count": 8, "geometry": {"image_shape": [96, 96], "base_seed": 10, "points_per_fiber": 24}, "rendering": {"base_seed": 20, "psf_sigma_px": 0.5}}
    out = str(folders / "made")
    assert P.generate_samples(spark, config, out).count() == 8
    assert P.validate_sample_folder(spark, out, config).count() == 0
    doc = json.loads((folders / "made" / "made_0000.json").read_text())
    assert doc["sample_index"] == 0 and doc["source_blank_provenance"] == "not_applicable"
    (folders / "made" / "made_0003.json").write_text("{}")
    assert [(r.rule, r.entity) for r in P.validate_sample_folder(spark, out).collect()] == [("checksum", "made_0003.json")]
    splits = P.create_splits(*tables).withColumn("synthetic_split", F.when(F.col("source_kind") == "blank_background", "calibration").otherwise("not_applicable"))
    decoded = files.decode_images(files.scan_files(spark, str(folders / "blanks")), "sted_blank_data", "blank_background")
    mixed = P.generate_composites(spark, {"geometry": {"points_per_fiber": 24}, "compositing": {"sample_count": 8}}, tables[1], splits, decoded, str(folders / "mixed"))
    assert mixed.count() == 8 and P.validate_sample_folder(spark, str(folders / "mixed")).count() == 0
    with pytest.raises(ValueError):
        P.generate_samples(spark, {"sample_count": 3}, out)


def test_artifact_metadata(tmp_path):
    (tmp_path / "a.csv").write_text("x")
    m = P.artifact_metadata("kind", {}, {"a": str(tmp_path / "a.csv"), "b": str(tmp_path / "none")}, ["i"], "exploratory_unpartitioned", today="2024-01-01", version="v")
    assert m["source_manifest_version"]["b"] == "missing" and m["result_status"] == "exploratory" and len(m["source_manifest_version"]["a"]) == 64
    with pytest.raises(ValueError):
        P.artifact_metadata("kind", {}, {}, [], "wrong")
    assert sinks.canonical_json(m).endswith("}\n")


def test_records(spark):
    card = {"cite_key": "A1", "bibliography": {"title": "t", "year": "not_reported"}, "evidence_spans": [{"evidence_id": "A1-E1", "source_pdf": "a.pdf", "page_pdf": 3}, {"evidence_id": "X-E2", "source_pdf": "b.pdf", "page_pdf": 99}], "findings": [{"text": "", "size": "not_reported", "evidence_ids": ["A1-E1", "A1-E9"]}], "missing_field_checks": []}
    schema = {"type": "object", "required": ["cite_key", "title"], "$defs": {"synthesis_claim": {"type": "object", "required": ["claim_id"]}}}
    cards = spark.createDataFrame([("A1", json.dumps(card))], "cite_key string, text string")
    claims = spark.createDataFrame([("F1", "{}", ["A1-E1", "Z-E1"], [], ["B2"], [])], "claim_id string, text string, supporting_evidence_ids array<string>, limiting_evidence_ids array<string>, supporting_papers array<string>, limiting_papers array<string>")
    manifest = spark.createDataFrame([("A1", 10, "a.pdf"), ("B2", 5, "b2.pdf")], "cite_key string, pages int, filename string")
    got = {r.rule for r in P.validate_records(cards, claims, manifest, schema).collect()}
    assert got == {"card_keys", "card_schema", "claim_schema", "empty_text", "page", "pdf", "prefix", "unknown_evidence", "unchecked_gap", "claim_evidence", "supporting_papers"}


def test_synthesis_and_comparison(spark):
    claims = spark.createDataFrame([("L1", "limitation", "T", "C", "k", ["a"], [], [], [], "low", None, "i"), ("F2", "finding", "T", "C", "k", [], ["a-E1"], [], [], "high", "supported", "i")], "claim_id string, section string, title string, claim string, claim_class string, supporting_papers array<string>, supporting_evidence_ids array<string>, limiting_papers array<string>, limiting_evidence_ids array<string>, confidence string, hypothesis_status string, sted_implication string")
    text = P.synthesis(claims)
    assert text.index("## finding") < text.index("## limitation") and "**Supporting papers:** None" in text and "**Hypothesis status:** `supported`" in text


def test_figures(spark, folders, tables):
    from skeinworks.plans import figures
    from skeinworks.sources import png

    decoded = files.decode_images(files.scan_files(spark, str(folders / "blanks")), "sted_blank_data", "blank_background")
    sheet, ids = figures.contact_sheet(decoded, tables[1], 32)
    assert png.read_png(sheet).shape == (32, 32 * len(ids)) and 1 <= len(ids) <= 3
    rows = spark.createDataFrame([("a", float(i)) for i in range(1000)] + [("b", 3.0), ("b", 1.0), ("b", None), ("b", float("nan")), (None, 1.0)], "kind string, v double")
    series = figures.series_by_kind(rows, "kind", "v", 11)
    assert series["b"] == [1.0, 3.0] and len(series["a"]) == 11 and series["a"][0] == 0 and abs(series["a"][5] - 500) < 2
    assert png.read_png(figures.kind_figure(rows, "kind", "v")).ndim == 3
    arrays = files.read_npz(spark.createDataFrame([(n, sinks.npz_bytes({"x": np.arange(50.0).reshape(5, 10) * k, "y": np.ones((5, 10))})) for k, n in ((1, "s1"), (2, "s2"))], "relative_path string, content binary"))
    line = png.read_png(figures.transverse_figure(arrays, ["x", "y", "absent"], 10))
    assert line.shape[1] == 30 and (line != 255).any()
    summary = spark.createDataFrame([("f", "a", 2.0), ("f", "b", 1.0)], "field string, g string, median double")
    bars = png.read_png(figures.median_figure(summary, "g", ["f", "h"], ["a", "b", "c"]))
    assert (bars[10, 12] == figures.COLOURS[0]).all() and (bars[10, 60] == 255).all() and (bars[200, 60] == figures.COLOURS[1]).all()

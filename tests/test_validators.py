"""Corpus, composite and artifact validators: a sound fixture passes, and each fault gives its own violation."""

import copy
import json

import numpy as np
import pytest

from skeinworks.operators import literature
from skeinworks.plans import pipelines as P
from skeinworks.sources import files, sinks

KEYS = [f"Key{i}" for i in range(8)]


def bibliography(k):
    return {"title": f"Title {k}", "publication_year": 2020, "doi": f"10.1/{k}", "corpus_role": "core", "study_type": "review" if k == "Key7" else "primary_research", "method_paradigms": ["a", "b"], "publication_status": "published"}


def card(k):
    return {
        "cite_key": k, "bibliography": bibliography(k), "comparison_summary": {c: f"{c} of {k}" for c, p in P.COMPARISON.items() if p.startswith("comparison_summary")} | {"losses": ["x", "y"]},
        "provenance": {"source_pdf": f"{k}.pdf", "source_sha256": k * 3, "extracted_on": "not_recorded", "extraction_status": "reviewed", "reviewed_on": "2024-02-03", "reviewer": "someone", "review_scope": list(reversed(literature.REVIEW_SCOPE))},
        "evidence_spans": [{"evidence_id": f"{k}-E1", "source_pdf": f"{k}.pdf", "page_pdf": 3}], "paper_findings": {"other": [{"claim_class": "author_claim", "evidence_ids": [f"{k}-E1"]}]},
        "method": {"kind": {"normalized": "other", "raw_value": "a rare one"}, "depth": "not_reported"}, "missing_field_checks": [{"path": "method.depth"}],
    }


def claim(i, section):
    return {"claim_id": f"C{section[0]}{i}", "section": section, "question_number": i if section == "question" else None, "hypothesis_id": f"H{i}" if section == "hypothesis" else None, "supporting_papers": ["Key0"], "limiting_papers": [], "supporting_evidence_ids": ["Key0-E1"], "limiting_evidence_ids": []}


SOUND = {
    "version": "1.2.0", "papers": [{"cite_key": k, "filename": f"{k}.pdf", "sha256": k * 3, "pages": 9, **bibliography(k)} for k in KEYS], "pdfs": [(f"{k}.pdf", k * 3, 9 if k != "Key1" else None) for k in KEYS],
    "cards": [card(k) for k in KEYS], "claims": [claim(i, "question") for i in range(1, 11)] + [claim(i, "hypothesis") for i in range(1, 8)],
}
SCHEMA = {"type": "object", "required": ["cite_key"], "properties": {"bibliography": {"type": "object", "properties": {"publication_status": {"enum": ["published", "preprint"]}}}}, "$defs": {"synthesis_claim": {"type": "object", "required": ["claim_id"]}}}


def cells(c):
    out = {}
    for name, path in P.COMPARISON.items():
        v = c
        for step in path.split("."):
            v = v[step]
        out[name] = ";".join(v) if isinstance(v, list) else str(v)
    return out


def found(spark, corpus, table=None, outputs=None):
    names = [f.split()[0] for f in literature.MANIFEST.split(", ")]
    manifest = spark.createDataFrame([tuple(p[n] for n in names) for p in corpus["papers"]], literature.MANIFEST)
    cards = spark.createDataFrame([(c["cite_key"], json.dumps(c)) for c in corpus["cards"]], "cite_key string, text string")
    fields = ["claim_id", "section", "question_number", "hypothesis_id", "supporting_papers", "limiting_papers", "supporting_evidence_ids", "limiting_evidence_ids"]
    claims = spark.createDataFrame([(*[c[f] for f in fields], json.dumps(c)) for c in corpus["claims"]], "claim_id string, section string, question_number int, hypothesis_id string, supporting_papers array<string>, limiting_papers array<string>, supporting_evidence_ids array<string>, limiting_evidence_ids array<string>, text string")
    pdfs = spark.createDataFrame(corpus["pdfs"], "filename string, sha256 string, pages int")
    rows = [cells(c) for c in SOUND["cards"]] if table is None else table
    stored = spark.createDataFrame([tuple(r[c] for c in P.COMPARISON_COLUMNS) for r in rows], ", ".join(f"{c} string" for c in P.COMPARISON_COLUMNS))
    return {(r.rule, r.entity) for r in P.validate_knowledge_base(cards, claims, manifest, SCHEMA, corpus["version"], pdfs, stored, outputs).collect()}


def test_a_sound_corpus_passes(spark, tmp_path):
    sinks.write_or_check({str(tmp_path / "kb.md"): "text"})
    assert found(spark, SOUND, outputs={str(tmp_path / "kb.md"): "text"}) == set()
    assert found(spark, SOUND, outputs={str(tmp_path / "kb.md"): "other"}) == {("stale_output", str(tmp_path / "kb.md"))}
    cards = spark.createDataFrame([("Key0", json.dumps(card("Key0"))), ("Draft", json.dumps({"provenance": {"extraction_status": "draft"}})), ("None", "{}")], "cite_key string, text string")
    assert {tuple(r) for r in literature.unreviewed(cards).collect()} == {("Draft", "draft"), ("None", "not_recorded")}


FAULTS = {
    "schema_version": (lambda c: c.update(version="1.0"), ("schema_version", "manifest")),
    "corpus_role": (lambda c: (c["papers"][2].update(corpus_role="extra"), c["cards"][2]["bibliography"].update(corpus_role="extra")), ("corpus_role", "Key2")),
    "pdf_checksum": (lambda c: c["pdfs"].__setitem__(3, ("Key3.pdf", "0", 9)), ("pdf_checksum", "Key3")),
    "pdf_pages": (lambda c: c["pdfs"].__setitem__(3, ("Key3.pdf", "Key3" * 3, 8)), ("pdf_pages", "Key3")),
    "pdf_missing": (lambda c: c["pdfs"].pop(3), ("pdf_files", "Key3.pdf")),
    "pdf_unlisted": (lambda c: c["pdfs"].append(("more.pdf", "x", 1)), ("pdf_files", "more.pdf")),
    "card_missing": (lambda c: c["cards"].pop(5), ("card_keys", "Key5")),
    "schema": (lambda c: (c["cards"][1]["bibliography"].update(publication_status="odd"), c["papers"][1].update(publication_status="odd")), ("card_schema", "Key1")),
    "bibliography": (lambda c: c["cards"][1]["bibliography"].update(title="Other"), ("bibliography", "Key1")),
    "bibliography_more": (lambda c: c["cards"][1]["bibliography"].update(more="x"), ("bibliography", "Key1")),
    "evidence": (lambda c: c["cards"][4]["paper_findings"]["other"][0].update(evidence_ids=["Key4-E999"]), ("unknown_evidence", "Key4")),
    "page": (lambda c: c["cards"][4]["evidence_spans"][0].update(page_pdf=999), ("page", "Key4")),
    "review_result": (lambda c: c["cards"][7]["paper_findings"]["other"][0].update(claim_class="reported_result"), ("review_result", "Key7")),
    "unchecked": (lambda c: c["cards"][6].update(missing_field_checks=[]), ("unchecked_gap", "Key6")),
    "scope": (lambda c: c["cards"][0]["provenance"].update(review_scope=["methods"]), ("review_scope", "Key0")),
    "review_date": (lambda c: c["cards"][0]["provenance"].update(reviewed_on="soon"), ("review_date", "Key0")),
    "reviewer": (lambda c: c["cards"][0]["provenance"].update(reviewer=None), ("reviewer", "Key0")),
    "extraction_date": (lambda c: c["cards"][0]["provenance"].update(extracted_on="2026-06-18"), ("extraction_date", "Key0")),
    "source_hash": (lambda c: c["cards"][0]["provenance"].update(source_sha256="x"), ("source_sha256", "Key0")),
    "vague": (lambda c: c["cards"][0]["method"]["kind"].update(raw_value=None), ("vague_other", "Key0")),
    "claim_evidence": (lambda c: c["claims"][0].update(supporting_evidence_ids=["Missing-E001"], supporting_papers=["Key0"]), ("claim_evidence", "Cq1")),
    "claim_paper": (lambda c: c["claims"][0].update(limiting_papers=["Nobody"]), ("unknown_paper", "Cq1")),
    "hypothesis": (lambda c: c["claims"].pop(), ("claim_set", "hypothesis H7")),
}


@pytest.mark.parametrize("name", FAULTS)
def test_each_fault_is_found(spark, name):
    corpus = copy.deepcopy(SOUND)
    change, want = FAULTS[name]
    change(corpus)
    got = found(spark, corpus, [cells(c) for c in corpus["cards"]])
    assert want in got and got <= {want, ("supporting_papers", "Cq1")}, got


def test_repeated_papers_and_table_drift(spark):
    corpus = copy.deepcopy(SOUND)
    corpus["papers"].append(dict(corpus["papers"][0]))
    assert {("duplicate_paper", "Key0"), ("paper_count", "manifest")} <= found(spark, corpus)
    rows = [cells(c) for c in SOUND["cards"]]
    rows[2]["main_targets"] = "changed"
    assert found(spark, SOUND, rows) == {("table_drift", "Key2")}


def test_artifacts(spark, tmp_path):
    for name in P.ARTIFACT_FILES[:-1]:
        (tmp_path / name).write_text("a\n")
    write = lambda status: (tmp_path / P.ARTIFACT_FILES[-1]).write_text(json.dumps({"metadata": {"calibration_status": status}}))
    rules = lambda: {r.rule for r in P.validate_artifacts(spark, str(tmp_path)).collect()}
    assert rules() == {"artifact_missing"}
    for status, want in (("exploratory_unpartitioned", set()), ("approved_calibration_subset", {"artifact_final"}), ("odd", {"artifact_status"})):
        write(status)
        assert rules() == want


def test_composites_and_metadata(spark, tmp_path):
    ids = [f"img_{i:020x}" for i in range(9)]
    blanks = spark.createDataFrame([("root", i, f"{i}.tif", "s" * 64, f"acq{k}", 48, 64, "expert_validated") for k, i in enumerate(ids)], "source_root_id string, stable_image_id string, relative_path string, source_sha256 string, acquisition_group string, shape_y int, shape_x int, blank_status string")
    splits = spark.createDataFrame([(i, "blank_background", "calibration") for i in ids], "stable_image_id string, source_kind string, synthetic_split string")
    decoded = spark.createDataFrame([("root", f"{i}.tif", 48, 64, 1, "uint8", np.full((48, 64), 4 + k, np.uint8).tobytes()) for k, i in enumerate(ids)], "source_root_id string, relative_path string, height int, width int, channels int, dtype string, pixels binary")
    config = {"geometry": {"points_per_fiber": 16, "base_seed": 5}, "compositing": {"sample_count": 8, "base_seed": 9}}
    out = tmp_path / "mixed"
    manifest = P.generate_composites(spark, config, blanks, splits, decoded, str(out)).orderBy("sample_id").collect()
    assert P.validate_composites(spark, str(out)).count() == 0
    doc = json.loads((out / manifest[3].json_path).read_text())
    assert doc["source_blank_provenance"]["crop_coordinates"] == [0, 0, 64, 48] and doc["source_blank_provenance"]["blank_stable_image_id"] == ids[3] and doc["compositing_seed"] == 12 and doc["geometry_seed"] == 8
    assert doc["shapes"]["blank_float"] == [48, 64] and doc["dtypes"]["render_uint8"] == "u1" and doc["enum_mappings"]["node_type"]["true_junction"] == 2
    rows = files.read_csv(spark, str(out / "dataset_manifest.csv")).collect()
    for k, change in enumerate(({"calibration_status": "final"}, {"source_blank_provenance": "not_applicable"}, {"synthetic_split": "training", "source_blank_provenance": doc["source_blank_provenance"]})):
        (out / rows[k].json_path).write_text(json.dumps(json.loads((out / rows[k].json_path).read_text()) | change))
    got = {(r.rule, r.entity) for r in P.validate_composites(spark, str(out)).collect()}
    assert got == {("checksum", rows[k].json_path) for k in range(3)} | {("calibration_status", rows[0].sample_id), ("blank_provenance", rows[1].sample_id), ("blank_reuse", ids[3])}


def test_sample_metadata(spark, tmp_path):
    config = {"sample_count": 8, "geometry": {"image_shape": [64, 64], "points_per_fiber": 16}, "targets": {"endpoint_radius_px": 2.0}}
    P.generate_samples(spark, config, str(tmp_path))
    assert P.validate_sample_folder(spark, str(tmp_path), config, metadata=True).count() == 0
    name = sorted(p.name for p in tmp_path.glob("*.json"))[2]
    doc = json.loads((tmp_path / name).read_text())
    assert doc["tolerance_radii"]["endpoint_radius_px"] == 2.0 and doc["coordinate_conventions"]["xy_order"] == "x_y" and doc["image_shape"] == [64, 64] and doc["geometry_seed"] == 1236
    (tmp_path / name).write_text(json.dumps(doc | {"generator_version": "0", "calibration_status": "x"}))
    assert {r.rule for r in P.validate_sample_folder(spark, str(tmp_path), config, metadata=True).collect()} == {"checksum", "generator_version", "calibration_status"}
    with pytest.raises(ValueError):
        P.generate_samples(spark, {**config, "calibration_status": "approved"}, str(tmp_path))


def test_split_defaults_and_order(spark, tmp_path):
    rows = spark.createDataFrame([("b", "fiber_image", "PN2", "a2", None), ("a", "blank_background", "PN1", "a1", "AD")], "stable_image_id string, source_kind string, biological_group_candidate string, acquisition_group string, inferred_condition string")
    splits = P.create_splits(rows)
    P.write_splits(splits, str(tmp_path / "splits.csv"))
    lines = (tmp_path / "splits.csv").read_text().splitlines()
    assert lines[0].split(",") == P.SPLIT_COLUMNS and [x.split(",")[0] for x in lines[1:]] == ["a", "b"]
    assert {r.inferred_condition for r in splits.collect()} == {"AD", "unknown"} and {r.inferred_div for r in splits.collect()} == {"unknown"}

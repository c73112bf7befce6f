"""Relational operators: spelling rules, references, duplicates, roles, selection, records; nulls, ties and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinworks.functions import spelling as S
from skeinworks.functions import text as X
from skeinworks.operators import documents, duplicates, images, kernels, references, roles, rules, selection, vectors


def one(spark, f, values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return [r[0] for r in df.select(f("c")).collect()]


def test_spelling(spark):
    assert one(spark, S.key, ["PN 0207", "pn-207", "Pn_207", " PN207\t", "Unknown", "", None, "NOT-RECORDED", "PN100_13R", "PN1001_3R"]) == ["pn_207"] * 4 + [None] * 4 + ["pn_100_13_r", "pn_1001_3_r"]
    hexes = "0034a18318acf0dc032f"
    assert set(one(spark, S.image_id, [f"img_{hexes}", f"IMG_{hexes.upper()} ", f"img-{hexes}", hexes, f" img_{hexes}\t"])) == {f"img_{hexes}"}
    assert one(spark, S.image_id, ["none", "", None, "odd"]) == [None, None, None, "odd"]
    assert one(spark, S.div, ["div_7", "DIV007", "Div-10", "DIV 110", "unknown", None]) == ["DIV07", "DIV07", "DIV10", "DIV110", None, None]
    assert one(spark, S.role, ["train", "TRAINING ", "val", "heldout_test ", "held-out test", "test", "calib", "unassigned", None]) == ["training", "training", "validation", "held_out_test", "held_out_test", "held_out_test", "calibration", None, None]
    assert one(spark, S.path, ["runs/../runs//a/./b.npz ", "runs\\a\\b.npz", "./x", "../x", "", None]) == ["runs/a/b.npz", "runs/a/b.npz", "x", "../x", None, None]
    sha = "ab" * 32
    assert set(one(spark, S.sha256, [sha, f"sha256:{sha}", f"SHA256={sha.upper()}", f"\t{sha} "])) == {sha} and one(spark, S.sha256, ["not_available"]) == [None]


def test_orphans(spark):
    ts = lambda x: F.to_timestamp(F.lit(x))
    refs = spark.createDataFrame([("t", "r1", "p", "here", "here", "2024-02-01"), ("t", "r1", "p", "here", "here", "2024-01-01"), ("t", "r2", "p", "gone", "Gone", "2024-02-01"), ("t", "r3", "p", "lost", "Lost", "2024-03-01"), ("t", "r4", "p", "late", "late", "2024-01-05"), ("t", "r5", "p", None, None, "2024-01-01"), ("t", None, "p", "lost", "Lost", None), ("t", "r6", "q", "here", "here", "2024-01-01")], "ref_table string, record_key string, parent_table string, ref_key string, ref_shown string, at string").withColumn("at", F.to_timestamp("at"))
    parents = spark.createDataFrame([("p", "here", "HERE", "2023-01-01", None), ("p", "here", "HERE", "2023-05-01", "2023-06-01"), ("p", "gone", "GONE", "2023-01-01", "2023-02-01"), ("p", "late", "LATE", "2024-06-01", None), ("p", None, None, None, None)], "parent_table string, key string, shown string, arrived_at string, gone_at string")
    parents = parents.withColumns({c: F.to_timestamp(c) for c in ("arrived_at", "gone_at")}).withColumn("period", ts("2020-01-01"))
    got = {tuple(r) for r in references.orphan_references(refs, parents).collect()}
    assert got == {("t", "r2", "GONE", "deleted", "2024-02"), ("t", "r3", "Lost", "missing", "2024-03"), ("t", "r4", "LATE", "late", "2024-01"), ("t", None, "Lost", "missing", None), ("t", "r6", "here", "missing", "2024-01")}
    assert references.orphan_references(refs.limit(0), parents).count() == 0
    assert references.orphan_references(refs, parents.limit(0)).count() == 6
    assert {r.orphan_kind: r.n_references for r in references.orphan_counts(references.orphan_references(refs, parents)).groupBy("orphan_kind").agg(F.sum("n_references").alias("n_references")).collect()} == {"missing": 3, "deleted": 1, "late": 1}


def test_number_duplicates_follow_first_appearance(spark):
    df = spark.createDataFrame([("r", "a", "x"), ("r", "b", "y"), ("r", "c", "y"), ("r", "d", "x"), ("r", "e", "z"), ("s", "a", "x"), ("s", "b", "x"), ("r", "f", None), ("r", "g", None), ("r", "h", ""), ("r", "i", "")], "root string, path string, h string")
    got = {(r.root, r.path): r.g for r in duplicates.number_duplicates(df, "root", "path", "h", "dup", "g").collect()}
    assert got["r", "a"] == got["r", "d"] == "dup_001" and got["r", "b"] == got["r", "c"] == "dup_002" and got["s", "a"] == "dup_001"
    assert got["r", "e"] is None and got["r", "f"] is None and got["r", "h"] is None and len(got) == 11


@pytest.mark.parametrize("threshold", [0.2, 0.9, 0.995])
def test_near_pairs_equal_all_pairs(spark, threshold):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 12))
    v = np.concatenate([base, base[:30] + rng.normal(scale=0.02, size=(30, 12)), base[:1].repeat(5, 0)])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    data = [(f"k{i:03d}", x.tolist(), "s" if i % 7 else "t", "same" if i >= 90 else None) for i, x in enumerate(v)] + [("zero", [0.0] * 12, "s", None), ("null", None, "s", None), ("short", [1.0], "s", None)]
    df = spark.createDataFrame(data, "id string, vector array<double>, scope string, ex string")
    got = {(r.left, r.right): r.score for r in duplicates.near_pairs(df, threshold, scope="scope", exclude="ex", block=16).collect()}
    want = {(data[i][0], data[j][0]) for i in range(len(v)) for j in range(i + 1, len(v)) if data[i][2] == data[j][2] and v[i] @ v[j] >= threshold and not (i >= 90 and j >= 90)}
    assert set(got) == want
    assert duplicates.near_pairs(df.limit(0), threshold).count() == 0


def test_fold_overwrites_in_order(spark):
    pairs = [("s", 1, 2, "a", "b", 0.996), ("s", 3, 4, "c", "d", 0.997), ("s", 2, 3, "b", "c", 0.998)]
    df = spark.createDataFrame(pairs, "scope string, i int, j int, left string, right string, score double")
    got = {r.id: (r.group, r.score) for r in duplicates.fold_pairs(df, "scope", "near").collect()}
    assert got == {"a": ("near_001", 0.996), "b": ("near_001", 0.998), "c": ("near_001", 0.998), "d": ("near_002", 0.997)} or got == {"a": ("near_001", 0.996), "b": ("near_001", 0.998), "c": ("near_001", 0.997), "d": ("near_001", 0.997)}


def test_roles(spark):
    def role(names):
        df = spark.createDataFrame([(n,) for n in names], "g string")
        return {r.g: r.role for r in roles.allocate_roles(df, "g").collect()}

    assert role(["x"]) == {"x": "calibration"} and role(["b", "a"]) == {"a": "calibration", "b": "held_out_test"}
    assert role("abc") == {"a": "training", "b": "validation", "c": "held_out_test"}
    assert role(["e", "d", "c", "b", "a", None]) == {"a": "training", "b": "validation", "c": "held_out_test", "d": "calibration", "e": "training", None: None}
    df = spark.createDataFrame([("g", "r1"), ("g", "r2"), ("h", "r1"), (None, "r1")], "g string, r string")
    assert [tuple(r) for r in roles.leaking_groups(df, "g", "r").collect()] == [("g", "r1;r2")]
    assert {tuple(r) for r in roles.unmatched(df.select("g"), spark.createDataFrame([("h",), ("i",)], "g string"), "g").collect()} == {("g", "left"), ("i", "right"), (None, "left")}


@pytest.mark.parametrize("n,k", [(10, 4), (7, 7), (5, 9), (1000, 48), (3, 1)])
def test_spaced_subset(spark, n, k):
    df = spark.range(n).select(F.format_string("k%05d", "id").alias("key")).repartition(5)
    ordered = [f"k{i:05d}" for i in range(n)]
    want = ordered if n <= k else [ordered[int(i)] for i in np.linspace(0, n - 1, k, dtype=int)]
    assert sorted(r.key for r in selection.spaced_subset(df, "key", k).collect()) == want


def test_selection_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0)], "k string, v double")
    assert [r.k for r in selection.first_rows(df, "k", 2).orderBy("k").collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        selection.first_rows(df, "k", 4)
    with pytest.raises(KeyError):
        selection.must_match(df, df.where("k <> 'b'").select("k"), "k")
    got = {r.k: r.reason for r in selection.representatives(df.withColumn("s", F.lit(1)), ["s"], "k", "v", "v").collect()}
    assert got == {"a": "first", "b": "middle", "c": "top"}
    texts = spark.createDataFrame([("g", "1"), ("g", "3"), ("g", ""), ("g", "not_available"), ("g", None)], "g string, m string")
    s = selection.measure_summary(texts, ["g"], ["m"]).collect()
    assert len(s) == 1 and (s[0].median, s[0].iqr) == (2.0, 1.0)
    assert selection.measure_summary(texts.limit(0), ["g"], ["m"]).count() == 0


def test_histogram_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 256, 5000)
    df = spark.createDataFrame([("g", int(x)) for x in v] + [("g", None)], "g string, v int")
    got = {r.percentile: r.value for r in images.histogram_percentiles(df, ["g"], "v", kernels.PERCENTILES).collect()}
    assert got == {float(p): float(q) for p, q in zip(kernels.PERCENTILES, np.percentile(v, kernels.PERCENTILES))}


def test_names_and_numbers(spark):
    df = spark.createDataFrame([("x/PN148_3R_AD_DIV07 (Series 8) [1].tif",), ("unstructured.tif",), ("Q1_2 (series 3) [4].TIF",)], "p string")
    a, b, c = [r.n for r in df.select(X.name_parts(F.col("p")).alias("n")).collect()]
    assert (a.inferred_pn, a.inferred_round, a.inferred_condition, a.inferred_div, a.series_index, a.acquisition_group, a.parse_status) == ("PN148", "3R", "AD", "DIV07", "8", "PN148_3R_AD_DIV07", "parsed")
    assert b.inferred_pn == "unknown" and b.acquisition_group == "unstructured" and b.parse_status == "unparsed"
    assert c.inferred_pn == "unknown" and c.inferred_round == "2" and c.inferred_div == "unknown" and c.bracket_index == "4"
    n = spark.createDataFrame([(0.5,), (1048576.0,), (123456789.05,), (None,), (1e-7,)], "v double")
    assert [r[0] for r in n.select(X.number_text(F.col("v"))).collect()] == ["0.5", "1.04858e+06", "1.23457e+08", None, "1e-07"]
    assert [r[0] for r in n.select(X.number_text(F.col("v"), whole=True)).collect()] == ["0.5", "1048576", "123456789", None, "1e-07"]


def test_schema_and_nodes(spark):
    schema = {"$defs": {"n": {"type": "integer", "minimum": 1}}, "type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"$ref": "#/$defs/n"}, "b": {"type": ["string", "null"], "minLength": 2, "pattern": "x"}, "c": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"enum": [1, 2]}}, "d": {"oneOf": [{"const": 1}, {"type": "string"}]}}}
    data = [("ok", '{"a": 1, "b": null, "c": [1, 2], "d": "s"}'), ("bad", '{"a": 0, "b": "q", "c": [3, 3], "d": 2, "e": 1}'), ("none", "{}"), ("bool", '{"a": true}'), ("broken", "{"), ("null", None)]
    got = {}
    for r in documents.schema_violations(spark.createDataFrame(data, "k string, t string"), "k", "t", schema).collect():
        got.setdefault(r.k, set()).add(r.path)
    assert "ok" not in got and got["bad"] == {"$.a", "$.b", "$.c", "$.c[0]", "$.c[1]", "$.d", "$"} and got["none"] == {"$"} and got["bool"] == {"$.a"} and got["broken"] == {"$"} and got["null"] == {"$"}
    assert [p for p, _ in documents.json_nodes({"a": [1, {"b": 2}], "c": None})] == ["$", "$.a", "$.a[0]", "$.a[1]", "$.a[1].b", "$.c"]


def test_rules(spark):
    a = spark.createDataFrame([("k1", 1), ("k2", None), ("k2", 3)], "k string, v int")
    b = spark.createDataFrame([("k1", 1), ("k3", 2)], "k string, v int")
    t = {"a": a, "b": b}
    found = rules.run_rules([rules.unique("u", "a", "k"), rules.references("r", "a", "k", "b", "k", "k"), rules.in_domain("d", "a", "v", [1], "k"), rules.same_on_both("s", "a", "b", "k", ["v"]), rules.has_columns("h", "a", ["k", "zz"])], t)
    got = {(r.rule, r.entity) for r in found.collect()}
    assert got == {("u", "k2"), ("r", "k2"), ("d", "k2"), ("s", "k2"), ("s", "k3"), ("h", "zz")}
    assert rules.run_rules([rules.unique("u", "a", "k")], {"a": a.limit(0)}).count() == 0


def test_relational_raster_and_crossings_equal_kernels(spark):
    from skeinworks.operators import strands
    from skeinworks.sources.files import sample_range

    config = {"image_shape": [96, 96], "base_seed": 10, "fiber_count_range": [8, 8], "points_per_fiber": 16}
    g = vectors.geometries(sample_range(spark, 8).where("sample_index < 2"), config).cache()
    seg = vectors.geometry_segments(g)
    got = {(r.sample_id, r.y, r.x): r.overlap for r in vectors.accumulated(vectors.rasterized(seg, 96, 96)).collect()}
    hits = vectors.spaced_crossings(vectors.crossing_hits(seg, vectors.geometry_nodes(g))).collect()
    for i in range(2):
        geo = strands.draw_geometry(config, i)
        t = strands.raster_targets(geo)
        mine = np.zeros((96, 96), int)
        for (s, y, x), n in got.items():
            if s == i:
                mine[y, x] = n
        assert (mine != t["overlap_count"]).sum() <= 3  # float32 against double on the rim
        a, b = sorted((r.x, r.y) for r in hits if r.sample_id == i), sorted(strands.crossings(geo))
        assert len(a) == len(b) and np.allclose(a, b, atol=0.05)


def test_samples_validate_and_damage_shows(spark):
    from skeinworks.plans.queries import SAMPLE
    from skeinworks.sources.files import sample_range

    s = vectors.samples(sample_range(spark, 8).where("sample_index < 2"), SAMPLE).cache()
    assert vectors.sample_violations(s, SAMPLE).count() == 0
    other = {**SAMPLE, "geometry": {**SAMPLE["geometry"], "base_seed": 11}}
    assert {r.rule for r in vectors.sample_violations(s, other).collect()} == {"regeneration"}

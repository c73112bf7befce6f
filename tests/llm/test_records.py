"""Problems 1 to 5 against brute force on small fixtures, with the defined edge cases."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skeinworks.llm import components, grouped_split, overlap, quota_sample, sampling
from skeinworks.llm.common import cumulative_before


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


# --- 1 --------------------------------------------------------------------------------------------------------------


def chosen(df):
    return {r[0] for r in df.where("selected").collect()}


def test_sample_is_stable_as_data_grow(spark):
    ids = [(f"img_{i:04d}", "x") for i in range(2000)]
    early = frame(spark, ids[:1200], "id string, weight string").select("id")
    later = frame(spark, ids + ids[:50], "id string, weight string").select("id").repartition(7)
    a, b = chosen(sampling.poisson_sample(early, "id", 0.1)), chosen(sampling.poisson_sample(later, "id", 0.1))
    assert a <= b and a == {x for x in b if x < "img_1200"}
    assert 140 < len(b) < 260


def test_sample_weights_never_fall(spark):
    first = sampling.poisson_sample(frame(spark, [(f"k{i}", 3.0) for i in range(500)], "id string, w double"), "id", 0.1, "w")
    again = sampling.poisson_sample(frame(spark, [(f"k{i}", 0.5) for i in range(400)], "id string, w double"), "id", 0.1, "w", state=first)
    assert chosen(first) == chosen(again) and again.count() == 500


def test_sample_defined_cases(spark):
    df = frame(spark, [(None, 1.0), ("a", None), ("b", float("nan")), ("c", -1.0), ("d", 99.0), ("d", 1.0)], "id string, weight double")
    assert rows(sampling.poisson_sample(df, "id", 1.0, "weight")) == [("a", 0.0, False), ("b", 0.0, False), ("c", 0.0, False), ("d", 99.0, True)]
    assert sampling.poisson_sample(df.limit(0), "id", 0.5).count() == 0


# --- 2 --------------------------------------------------------------------------------------------------------------


def brute_pairs(ev, tr, t):
    sets = [defaultdict(set), defaultdict(set)]
    for s, data in enumerate((ev, tr)):
        for i, tok in data:
            if i and tok:
                sets[s][i].add(tok)
    out = set()
    for a, x in sets[0].items():
        for b, y in sets[1].items():
            if a != b and (len(x & y) / len(x | y) >= t - 1e-9 if t else len(x & y) >= 1):
                out.add((a, b))
    return out


@pytest.mark.parametrize("similarity", [None, 0.5, 0.8])
def test_prefix_join_equals_brute_force(spark, similarity):
    rng = random.Random(4)
    data = []
    for i in range(60):
        base = [f"t{rng.randrange(40)}" for _ in range(rng.randrange(1, 12))]
        data += [(f"{'e' if i % 2 else 'r'}{i}", t) for t in base]
        if i % 5 == 0:
            data += [(f"{'r' if i % 2 else 'e'}c{i}", t) for t in base[: max(1, len(base) - 1)]]
    data += [(f"r{i}", "hot") for i in range(0, 60, 2)] + [("e1", "hot"), (None, "hot"), ("e3", None), ("e5", "hot"), ("e5", "hot")]
    ev, tr = [x for x in data if (x[0] or "e").startswith("e")], [x for x in data if (x[0] or "e").startswith("r")]
    got = overlap.prefix_join(frame(spark, ev, "id string, token string"), frame(spark, tr, "id string, token string"), similarity)
    assert {(r.id_a, r.id_b) for r in got.collect()} == brute_pairs(ev, tr, similarity)
    assert got.count() == len(brute_pairs(ev, tr, similarity))


def test_prefix_join_empty(spark):
    e = frame(spark, [], "id string, token string")
    assert overlap.prefix_join(e, e).count() == overlap.prefix_join(e, e, None).count() == 0


def test_word_shingles(spark):
    df = frame(spark, [("One two, three four five SIX",), ("a b",), ("",), (None,), ("   ",)], "t string")
    got = [r[0] for r in df.select(overlap.word_shingles(F.col("t"))).collect()]
    assert got[0] == ["one two three four five", "two three four five six"] and got[1] == ["a b"] and got[2] == [] and not got[3] and got[4] == []


def test_texts_link_copies_and_near_copies(spark, tmp_path):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    texts = {}
    for i in range(0, 300, 50):
        base = [word() for _ in range(60)]
        texts[i] = " ".join(base)
        texts[i + 1] = texts[i + 2] = ", ".join(base).upper()  # the same words: a copy for the shingles
        texts[i + 3] = " ".join([*base[:-1], "other"])  # near
        texts[i + 4] = " ".join(w if k % 4 else "x" for k, w in enumerate(base))  # far
    texts |= {350: "", 351: None, 400: "   ", 450: "one two", 451: "One  two!", 500: texts[0]}
    df = frame(spark, [(k, v, "x") for k, v in texts.items()], "doc_id long, text string, token string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.class_id, r.n_links) for r in overlap.p2_texts(spark, str(tmp_path)).collect()}
    assert got == {**{i: (i, 3) for i in range(0, 300, 50)}, 450: (450, 1), 500: (0, 3)}


# --- 3 --------------------------------------------------------------------------------------------------------------


def brute_groups(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            up[find(a)] = find(b)
    groups = defaultdict(set)
    for x in list(up):
        groups[find(x)].add(x)
    return sorted(sorted(g) for g in groups.values())


def as_groups(df):
    groups = defaultdict(set)
    for r in df.collect():
        groups[r.root].add(r.vertex)
    return sorted(sorted(g) for g in groups.values())


@pytest.mark.parametrize("cell_edges", [7, 10_000])
def test_components_on_chains_stars_and_noise(spark, cell_edges):
    rng = random.Random(1)
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(90)]
    edges += [("hub", f"s{i}") for i in range(80)]
    edges += [(f"n{rng.randrange(70)}", f"n{rng.randrange(70)}") for _ in range(50)]
    edges += [("s1", "s1"), ("s2", "hub"), (None, "x"), ("y", None), ("hub", "s3")]
    df = frame(spark, [(*e, "extra") for e in edges], "u string, v string, root string")
    assert as_groups(components.connected_components(df, cell_edges=cell_edges)) == brute_groups(edges)


def test_components_empty(spark):
    df = frame(spark, [("a", "a"), (None, "b")], "u string, v string")
    assert components.connected_components(df).count() == 0


# --- 4 --------------------------------------------------------------------------------------------------------------


def test_spanning_forest(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(80)}", f"n{rng.randrange(80)}") for _ in range(90)] + [("n1", "n1"), (None, "n2"), ("n3", "n4"), ("n4", "n3")]
    forest, label = grouped_split.spanning_forest(frame(spark, edges, "u string, v string"))
    want = brute_groups(edges)
    assert as_groups(label) == want
    tree = [(r.u, r.v) for r in forest.collect()]
    assert len(tree) == sum(len(g) - 1 for g in want) and brute_groups(tree) == want


def test_blocks_and_torn(spark):
    data = [("a", "b1", "x", "training", None), ("b", "b1", None, "validation", None), ("c", None, "x", None, None), ("d", None, None, "training", "validation"), ("e", None, None, "training", None), ("f", "b9", None, None, None)]
    members, blocks, _ = grouped_split.blocks_of(frame(spark, data, "stable_image_id string, bio string, acq string, eligibility string, synthetic_split string"))
    got = {r.stable_image_id: (r.block_id, r.torn) for r in members.join(blocks, "vertex").collect()}
    assert got == {"a": ("a", True), "b": ("a", True), "c": ("a", True), "d": ("d", True), "e": ("e", False), "f": ("f", False)}


def test_deal_blocks_meets_shares(spark):
    rng = random.Random(3)
    data = [(f"b{i:04d}", 1 + int(rng.paretovariate(1.1)) % 60) for i in range(3000)] + [("giant", 1500)]
    got = grouped_split.deal_blocks(frame(spark, data, "block_id string, n long"), [("train", 0.7), ("val", 0.1), ("test", 0.2)])
    sizes = defaultdict(int)
    found = got.collect()
    for r in found:
        sizes[r.split] += r.n
    total = sum(n for _, n in data)
    assert len(found) == len(data) and sum(sizes.values()) == total
    for name, share in (("train", 0.7), ("val", 0.1), ("test", 0.2)):
        assert abs(sizes[name] / total - share) < 0.02


def test_deal_blocks_makes_up_for_a_giant(spark):
    data = [("giant", 1000)] + [(f"b{i:03d}", 20) for i in range(100)]
    got = grouped_split.deal_blocks(frame(spark, data, "block_id string, n long"), [("test", 0.5), ("train", 0.5)])
    sizes = defaultdict(int)
    for r in got.collect():
        sizes[r.split] += r.n
    assert abs(sizes["test"] - 1500) <= 20 and sum(sizes.values()) == 3000


def test_deal_blocks_edges(spark):
    empty = frame(spark, [], "block_id string, n long")
    assert grouped_split.deal_blocks(empty, [("a", 1.0)]).count() == 0
    with pytest.raises(ValueError):
        grouped_split.deal_blocks(empty, [])


# --- 5 --------------------------------------------------------------------------------------------------------------


def test_floors_beyond_the_size_are_reported(spark):
    records = frame(spark, [(f"r{i}", "AB"[i % 2], None) for i in range(400)], "id string, category string, grp string")
    report = quota_sample.category_report(records, frame(spark, [("A", 0.5, 80, 0, 100), ("B", 0.5, 80, 0, 100)], "category string, target_share double, min_images int, min_groups int, sample_size long"))
    assert {(r.category, r.quota, r.excess) for r in report.collect()} == {("A", 80, 60), ("B", 80, 60)}


def test_allocate_floors_caps_and_remainders():
    t = [{"key": "a", "share": 0.5, "floor": 0, "available": 100}, {"key": "b", "share": 0.3, "floor": 0, "available": 2}, {"key": "c", "share": 0.2, "floor": 5, "available": 100}, {"key": "d", "share": 0.0, "floor": 3, "available": 1}]
    q = quota_sample.allocate(t, 20)
    assert q["b"] == 2 and q["c"] >= 5 and q["d"] == 1 and sum(q.values()) == 20
    assert quota_sample.allocate([], 5) == {}
    row = lambda k, s, f=0, n=1000: {"key": k, "share": s, "floor": f, "available": n}
    assert quota_sample.allocate([row("A", 0.5), row("B", 0.5), row("C", 0.0, 40)], 100) == {"A": 30, "B": 30, "C": 40}
    assert quota_sample.allocate([row("A", 0.4), row("B", 0.4), row("C", 0.2, 40)], 100) == {"A": 30, "B": 30, "C": 40}
    assert quota_sample.allocate([row("A", 0.5, 80), row("B", 0.5, 80)], 100) == {"A": 80, "B": 80}
    assert quota_sample.allocate([row("A", 0.3), row("B", 0.3), row("C", 0.4)], 10) == {"A": 3, "B": 3, "C": 4}
    assert quota_sample.allocate([row("A", 1 / 3), row("B", 1 / 3), row("C", 1 / 3)], 10) == {"A": 4, "B": 3, "C": 3}
    rng = random.Random(7)
    for _ in range(300):  # in bounds, whole, and no unit is better placed elsewhere
        t = [row(i, rng.choice([0, 0.1, 0.3, rng.random()]), rng.choice([0, 0, 5, 40]), rng.choice([0, 3, 30, 999])) for i in range(rng.randrange(1, 6))]
        q, by = quota_sample.allocate(t, size := rng.randrange(0, 150)), {x["key"]: x for x in t}
        low = {k: min(x["floor"], x["available"]) for k, x in by.items()}
        high = {k: x["available"] if x["share"] else low[k] for k, x in by.items()}
        assert all(low[k] <= q[k] <= high[k] for k in q)
        assert sum(q.values()) == max(sum(low.values()), min(size, sum(high.values())))
        for a in q:
            for b in q:
                if a != b and q[a] > low[a] and q[b] < high[b]:
                    assert q[b] + 1 >= (q[a] - 1) * by[b]["share"] / by[a]["share"] - 1e-9
    assert quota_sample.allocate([{"key": "a", "share": 1.0, "floor": 0, "available": 3}], 10) == {"a": 3}


def test_quota_sample_keeps_quotas_and_groups(spark):
    rng = random.Random(5)
    recs = [(f"r{i}", rng.choice("AAAAAB"), f"g{rng.randrange(9)}" if rng.random() < 0.9 else None) for i in range(800)] + [("z1", "C", None), ("z2", "D", "g1")]
    targets = [("A", 0.5, 1, 6, 60), ("B", 0.4, 30, 2, 60), ("C", 0.1, 1, 1, 60), ("X", 0.0, 1, 0, 60)]
    records = frame(spark, recs, "id string, category string, grp string")
    report = quota_sample.category_report(records, frame(spark, targets, "category string, target_share double, min_images int, min_groups int, sample_size long"))
    by = {r.category: r for r in report.collect()}
    assert by["C"].short_of_images and by["C"].short_of_groups and by["X"].short_of_images and not by["A"].short_of_images
    got = quota_sample.quota_sample(records, report).collect()
    count, groups = defaultdict(int), defaultdict(set)
    for r in got:
        count[r.category] += 1
        groups[r.category].add(r.grp)
    assert all(count[c] == by[c].quota for c in by) and len(groups["A"] - {None}) >= 6 and len(groups["B"] - {None}) >= 2
    again = quota_sample.quota_sample(records.repartition(5), report).collect()
    assert {r.id for r in again} == {r.id for r in got}


def test_cumulative_before_matches_brute_force(spark):
    rng = random.Random(6)
    data = [(f"k{i}", rng.choice(["a", "b", None]), rng.choice([0, 1, 5, None])) for i in range(400)]
    df = frame(spark, data, "id string, g string, w int")
    got = cumulative_before(df, ["g"], F.xxhash64("id"), "id", F.col("w"), bits=4).withColumn("h", F.xxhash64("id")).collect()
    for g in ("a", "b", None):
        part = sorted((r for r in got if r.g == g), key=lambda r: ((r.h >> 60) & 15, r.h, r.id))
        s = 0
        for r in part:
            assert r.before == s
            s += r.w or 0
    assert len(got) == len(data)


def test_rows_that_regroup_a_record_join_all_their_groups(spark, tmp_path):
    i = [f"img_{k:020x}" for k in range(1, 6)]
    rows = [(i[0], "PN1_R1", "acq_1", "training"), (i[0], "PN2_R1", "acq_2", "training"), (i[1], "PN2_R1", None, "validation"), (i[2], None, "acq_2", "training"), (i[3], "PN1_R1", None, "training"), (i[4], "PN9_R1", "acq_9", "training")]
    df = frame(spark, rows, "stable_image_id string, biological_group_candidate string, acquisition_group string, eligibility string")
    df.withColumns({"synthetic_split": F.lit(None).cast("string"), "assigned_at": F.timestamp_seconds(F.lit(0))}).write.parquet(str(tmp_path / "sted_splits.parquet"))
    got = {(r.stable_image_id, r.block_id) for r in grouped_split.p4_found(spark, str(tmp_path)).collect()}
    assert got == {(x, i[0]) for x in i[:4]}
    assert grouped_split.p4_forest(spark, str(tmp_path)).count() == 4

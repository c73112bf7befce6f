"""Queries of this subpackage and their SQL check."""

from __future__ import annotations

from ..plans import sqltext as Q
from . import chunk_tokens, components, digests, grouped_split, mixture, overlap, quota_sample, sampling, subjects

QUERIES = {
    "p1_sample": sampling.p1_sample,
    "p1_share": sampling.p1_share,
    "p1_state": sampling.p1_state,
    "p2_found": overlap.p2_found,
    "p2_report": overlap.p2_report,
    "p2_texts": overlap.p2_texts,
    "p3_found": components.p3_found,
    "p3_groups": components.p3_groups,
    "p4_found": grouped_split.p4_found,
    "p4_splits": grouped_split.p4_splits,
    "p4_shares": grouped_split.p4_shares,
    "p4_forest": grouped_split.p4_forest,
    "p4_forest_size": grouped_split.p4_forest_size,
    "p4_blocks": grouped_split.p4_blocks,
    "p4_violations": grouped_split.p4_violations,
    "p5_found": quota_sample.p5_found,
    "p5_report": quota_sample.p5_report,
    "p5_sample": quota_sample.p5_sample,
    "p7_percentiles": digests.p7_percentiles,
    "p7_counts": digests.p7_counts,
    "p7_by_days": digests.p7_by_days,
    "p8_ids": chunk_tokens.p8_ids,
    "p9_found": mixture.p9_found,
    "p9_report": mixture.p9_report,
    "p9_mix": mixture.p9_mix,
    "p9_violations": mixture.p9_violations,
    "p10_found": subjects.p10_found,
    "p10_composition": subjects.p10_composition,
}

_ID = Q.image_id("stable_image_id")
_SHARE = f"('0x' || substr(sha256('{sampling.SEED}:' || id), 1, 13))::BIGINT < {sampling.SHARE} * pow(2, 52)"
_CURRENT = f"""
cur AS (
  SELECT id, arg_max(e, t) AS e, arg_max(s, t) AS s FROM (
    SELECT {_ID} AS id, coalesce({Q.role('eligibility')}, '') AS e, coalesce({Q.role('synthetic_split')}, '') AS s, assigned_at AS t FROM sted_splits
  ) WHERE id IS NOT NULL GROUP BY id
)"""
_P2 = f"""
WITH {_CURRENT}, img AS (
  SELECT {_ID} AS id, {Q.sha256('pixel_sha256')} AS px, {Q.key('near_duplicate_candidate_group')} AS ng, source_root_id AS root FROM sted_images
), tok AS (
  SELECT DISTINCT img.id, tok, e FROM (SELECT id, 'p' || px AS tok FROM img UNION SELECT id, 'g' || ng FROM img) img JOIN cur USING (id) WHERE tok IS NOT NULL
), pairs AS (
  SELECT DISTINCT a.id AS ev, b.id AS tr, a.e AS split FROM tok a JOIN tok b ON a.tok = b.tok WHERE a.e IN ('validation', 'held_out_test') AND b.e = 'training'
)"""
_P3 = f"""
WITH RECURSIVE img AS (SELECT {_ID} AS id, {Q.key('near_duplicate_candidate_group')} AS ng FROM sted_images),
ids AS (SELECT DISTINCT id FROM img WHERE id IS NOT NULL),
e0 AS (
  SELECT {Q.image_id('left_stable_image_id')} AS u, {Q.image_id('right_stable_image_id')} AS v FROM near_duplicate_pairs WHERE near_duplicate_score >= 0.995 AND NOT isnan(near_duplicate_score)
), e AS (
  SELECT u, v FROM e0 WHERE u IN (SELECT id FROM ids) AND v IN (SELECT id FROM ids) AND u <> v
  UNION SELECT id, 'zz' || ng FROM img WHERE ng IS NOT NULL
), sym AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (SELECT u, v FROM sym UNION SELECT r.u, b.v FROM reach r JOIN sym b ON r.v = b.u),
found AS (SELECT u AS stable_image_id, least(u, min(v)) AS group_id, count(*) FILTER (v <> u AND v NOT LIKE 'zz%') AS n FROM reach WHERE u NOT LIKE 'zz%' GROUP BY u)"""
_P4 = f"""
WITH RECURSIVE {_CURRENT}, ig AS (
  SELECT DISTINCT {_ID} AS id, 'b' || {Q.key('biological_group_candidate')} AS g FROM sted_splits UNION SELECT {_ID}, 'a' || {Q.key('acquisition_group')} FROM sted_splits
), own AS (SELECT id, g FROM ig WHERE id IS NOT NULL AND g IS NOT NULL),
sym AS (SELECT DISTINCT x.g AS u, y.g AS v FROM own x JOIN own y USING (id) WHERE x.g <> y.g),
reach AS (SELECT u, v FROM sym UNION SELECT r.u, b.v FROM reach r JOIN sym b ON r.v = b.u),
root AS (SELECT u, least(u, min(v)) AS root FROM reach GROUP BY u),
rec AS (SELECT cur.id, e, s, coalesce(min(g), 'r' || cur.id) AS x FROM cur LEFT JOIN own ON cur.id = own.id GROUP BY cur.id, e, s),
lab AS (SELECT id, e, s, coalesce(root, x) AS root FROM rec LEFT JOIN root ON x = u),
std AS (SELECT root, min(id) AS block_id, count(*) AS n FROM lab GROUP BY root),
torn AS (SELECT root FROM (SELECT root, e AS sp FROM lab UNION SELECT root, s FROM lab) WHERE sp <> '' GROUP BY root HAVING count(DISTINCT sp) > 1)"""
_STRATA = f"""
WITH rec AS (
  SELECT id, min(c) AS c, min(d) AS d, min(b) AS b FROM (
    SELECT {_ID} AS id, {Q.key('inferred_condition')} AS c, {Q.key('inferred_div')} AS d, {Q.key('biological_group_candidate')} AS b FROM sted_images
  ) GROUP BY id
), t AS (SELECT *, {Q.key('inferred_condition')} AS tc, {Q.key('inferred_div')} AS td FROM sample_targets),
rep AS (
  SELECT t.inferred_condition, t.inferred_div, any_value(target_share) AS sh, any_value(min_images) AS mi, any_value(min_groups) AS mg, any_value(sample_size) AS ss, count(rec.id) AS n, count(DISTINCT rec.b) AS g
  FROM t LEFT JOIN rec ON rec.c = tc AND rec.d = td GROUP BY 1, 2
)"""

def _div(k: str) -> str:
    return f"CASE WHEN regexp_matches({k}, '^div_[0-9]+$') THEN 'DIV' || lpad(substr({k}, 5), CAST(greatest(2, length({k}) - 4) AS INTEGER), '0') ELSE upper({k}) END"


# quotas: the scale at which bounded shares add up to the size lies between two of the shares' own limits
_QUOTA = _STRATA + f""", b AS (
  SELECT tc || '|' || td AS category, max(target_share) AS sh, max(min_images) AS f, max(min_groups) AS mg, max(sample_size) AS ss FROM t GROUP BY 1
), have AS (SELECT c || '|' || d AS category, count(*) AS available, count(DISTINCT b) AS groups FROM rec WHERE c IS NOT NULL AND d IS NOT NULL GROUP BY 1),
lim AS (
  SELECT b.*, coalesce(available, 0) AS available, coalesce(groups, 0) AS groups, least(f, coalesce(available, 0)) AS lo, CASE WHEN sh > 0 THEN coalesce(available, 0) ELSE least(f, coalesce(available, 0)) END AS hi, max(ss) OVER () AS size FROM b LEFT JOIN have USING (category)
), edge AS (SELECT DISTINCT unnest([lo / sh, hi / sh]) AS x FROM lim WHERE sh > 0 UNION SELECT 0.0),
sums AS (SELECT x, sum(least(greatest(x * sh, lo), hi)) AS s, sum(CASE WHEN lo <= x * sh AND x * sh < hi THEN sh ELSE 0 END) AS slope FROM edge, lim GROUP BY x),
base AS (SELECT x, s, slope FROM sums WHERE s <= (SELECT max(size) FROM lim) + 1e-9 ORDER BY x DESC LIMIT 1),
exact AS (
  SELECT lim.*, CASE WHEN base.x IS NULL THEN lo ELSE least(greatest((base.x + CASE WHEN slope > 0 THEN (size - s) / slope ELSE 0 END) * sh, lo), hi) END AS e FROM lim LEFT JOIN base ON true
), whole AS (SELECT *, floor(e + 1e-7) AS q, round(sum(e) OVER ()) - sum(floor(e + 1e-7)) OVER () AS spare FROM exact),
quota AS (
  SELECT *, CAST(q + CASE WHEN row_number() OVER (ORDER BY round(q - e, 7), category) <= spare THEN 1 ELSE 0 END AS BIGINT) AS quota FROM whole
)"""
_KEY5 = f"('0x' || substr(sha256('{quota_sample.SEED}:' || id), 1, 15))::BIGINT"
_P7 = f"""
WITH run AS (
  SELECT DISTINCT {_ID} AS id, computed_at, {Q.key('inferred_condition')} AS c, {Q.key('inferred_div')} AS d, mean, high_frequency_residual_std AS h FROM blank_stats
), v AS (
  SELECT 'mean' AS metric, c, d, mean AS v FROM run WHERE id IS NOT NULL UNION ALL SELECT 'high_frequency_residual_std', c, d, h FROM run WHERE id IS NOT NULL
)
SELECT metric, upper(c) AS inferred_condition, {_div('d')} AS inferred_div, p, count(*) AS n, true AS within_bound
FROM v, (SELECT CAST(unnest({digests.PERCENTILES}) AS DOUBLE) AS p) WHERE v >= 0 AND v <= 255 AND NOT isnan(v) GROUP BY ALL"""
_TEXTS = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS t FROM w WHERE len(w) > 0
), d AS (SELECT DISTINCT doc_id, t FROM s),
size AS (SELECT doc_id, count(*) AS n, md5(string_agg(t, '|' ORDER BY t)) AS key FROM d GROUP BY doc_id),
class AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY key) AS class_id FROM size),
alike AS (
  SELECT a.doc_id AS q, b.doc_id AS o, count(*) AS k FROM d a JOIN d b ON a.t = b.t WHERE a.doc_id % 50 = 0 AND b.doc_id % 50 <> 0 GROUP BY 1, 2
), links AS (
  SELECT q, count(*) AS n_links FROM alike JOIN size x ON q = x.doc_id JOIN size y ON o = y.doc_id WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9 GROUP BY q
)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM class LEFT JOIN links ON q = doc_id WHERE doc_id % 50 = 0"""

SQL = {
    "p1_sample": f"SELECT id AS stable_image_id, CAST(1 AS DOUBLE) AS weight FROM (SELECT DISTINCT {_ID} AS id FROM sted_images) WHERE id IS NOT NULL AND {_SHARE}",
    "p1_share": f"SELECT count(*) AS n_images, count(*) FILTER ({_SHARE}) AS n_selected FROM (SELECT DISTINCT {_ID} AS id FROM sted_images) WHERE id IS NOT NULL",
    "p1_state": f"SELECT id AS stable_image_id, max(w) AS weight, ('0x' || substr(sha256('{sampling.SEED}:' || id), 1, 13))::BIGINT < max(w) * {sampling.SHARE} * pow(2, 52) AS selected FROM (SELECT {_ID} AS id, CASE WHEN {Q.key('near_duplicate_candidate_group')} IS NULL THEN 1.0 ELSE {sampling.GROUPED} END::DOUBLE AS w FROM sted_images) WHERE id IS NOT NULL GROUP BY id",
    "p2_texts": _TEXTS,
    "p2_found": _P2 + "SELECT DISTINCT least(ev, tr) AS stable_image_id_a, greatest(ev, tr) AS stable_image_id_b FROM pairs",
    "p2_report": _P2 + ", roots AS (SELECT id, min(root) AS root FROM img GROUP BY id) SELECT split, root AS source_root_id, count(DISTINCT ev) AS n_images, count(*) AS n_pairs FROM pairs JOIN roots ON ev = id GROUP BY 1, 2",
    "p3_found": _P3 + "SELECT stable_image_id, group_id FROM found WHERE n > 0",
    "p3_groups": _P3 + "SELECT id AS stable_image_id, coalesce(group_id, id) AS group_id FROM ids LEFT JOIN found ON id = stable_image_id",
    "p4_found": _P4 + "SELECT id AS stable_image_id, block_id FROM lab JOIN std USING (root) WHERE root IN (SELECT root FROM torn)",
    "p4_blocks": _P4 + "SELECT block_id, n, root IN (SELECT root FROM torn) AS torn FROM std",
    "p4_forest_size": _P4 + "SELECT count(*) AS n_vertices, count(*) - count(DISTINCT root) AS n_edges, count(DISTINCT root) AS n_trees FROM root",
    "p4_violations": "SELECT 'none' AS rule, 'none' AS entity WHERE false",
    "p5_report": _QUOTA + """
SELECT n.inferred_condition, n.inferred_div, sh AS target_share, CAST(f AS BIGINT) AS min_images, CAST(mg AS BIGINT) AS min_groups, ss AS sample_size, available, groups, quota, greatest(f, sh * ss) AS needed, available < greatest(f, sh * ss) AS short_of_images, groups < mg AS short_of_groups, CAST(greatest(0, sum(quota) OVER () - size) AS BIGINT) AS excess
FROM quota JOIN (SELECT tc || '|' || td AS category, min(inferred_condition) AS inferred_condition, min(inferred_div) AS inferred_div FROM t GROUP BY 1) n USING (category)""",
    "p5_sample": _QUOTA + f""", keyed AS (SELECT id, c || '|' || d AS category, b, {_KEY5} AS k FROM rec WHERE c IS NOT NULL AND d IS NOT NULL),
heads AS (
  SELECT id FROM (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY k, id) AS r FROM (SELECT * FROM keyed WHERE b IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category, b ORDER BY k, id) = 1)) JOIN quota USING (category) WHERE r <= least(mg, quota)
)
SELECT id AS stable_image_id, upper(split_part(category, '|', 1)) AS inferred_condition, {_div("split_part(category, '|', 2)")} AS inferred_div
FROM (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY id NOT IN (SELECT id FROM heads), k, id) AS r FROM keyed) JOIN quota USING (category) WHERE r <= quota""",
    "p7_counts": _P7,
    "p9_violations": "SELECT 'none' AS rule, 'none' AS entity WHERE false",
    "p5_found": _STRATA + "SELECT inferred_condition, inferred_div FROM rep WHERE n < greatest(mi, sh * ss) OR g < mg",
}

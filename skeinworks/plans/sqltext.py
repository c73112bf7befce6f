"""DuckDB text of the spelling rules, for the SQL check of queries."""

from __future__ import annotations

from ..functions.spelling import NOT_KNOWN, ROLES

_WORDS = "(" + ", ".join(f"'{w}'" for w in ["", *NOT_KNOWN]) + ")"


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}\p{{C}}]+|[\s\p{{Z}}\p{{C}}]+$', '', 'g')"


def known(x: str) -> str:
    return f"(CASE WHEN {x} NOT IN {_WORDS} THEN {x} END)"


def key(x: str) -> str:
    for pattern, by in ((r"(\p{L})(\p{Nd})", r"\1_\2"), (r"(\p{Nd})(\p{L})", r"\1_\2"), (r"[^\p{L}\p{N}]+", "_"), (r"(^|_)0+(\p{Nd})", r"\1\2"), (r"^_+|_+$", "")):
        x = f"regexp_replace({x if x.startswith('regexp_replace') else f'lower({x})'}, '{pattern}', '{by}', 'g')"
    return known(x)


def image_id(x: str) -> str:
    return f"('img_' || nullif(regexp_extract(lower({x}), '([0-9a-f]{{20}})[^0-9a-z]*$', 1), ''))"


def sha256(x: str) -> str:
    return known(rf"regexp_replace(lower({trimmed(x)}), '^sha[-_ ]?256\s*[:=]?\s*', '')")


def role(x: str) -> str:
    bare = f"replace({key(x)}, '_', '')"
    return "(CASE " + " ".join(f"WHEN {bare} IN ({', '.join(repr(w) for w in words)}) THEN '{name}'" for name, words in ROLES.items()) + " END)"


def path(x: str) -> str:
    x = rf"replace({trimmed(x)}, '\', '/')"
    for pattern, by in ((r"/\./", "/"), (r"^(\./)+", ""), (r"/+", "/"), (r"[^/]+/\.\./", "")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return f"nullif({x}, '')"


def whole_number(x: str) -> str:
    return f"(CASE WHEN abs({x} - round_even({x}, 0)) <= greatest(1e-9, 1e-9 * greatest(abs({x}), abs(round_even({x}, 0)))) THEN CAST(CAST(round_even({x}, 0) AS BIGINT) AS VARCHAR) ELSE format('{{:.6g}}', CAST({x} AS DOUBLE)) END)"


P6_FOUND = f"""
WITH refs AS (
  SELECT ref_table, record_key, parent, k, min(shown) AS shown, min(t) AS t FROM (
    SELECT 'sted_splits' AS ref_table, {image_id('stable_image_id')} AS record_key, 'inventory' AS parent, {image_id('stable_image_id')} AS k, {image_id('stable_image_id')} AS shown, assigned_at AS t FROM sted_splits
    UNION ALL SELECT 'blank_stats', {image_id('stable_image_id')}, 'blanks', {image_id('stable_image_id')}, {image_id('stable_image_id')}, computed_at FROM blank_stats
    UNION ALL SELECT 'near_duplicate_pairs', CAST(pair_id AS VARCHAR), 'images', {image_id('left_stable_image_id')}, {image_id('left_stable_image_id')}, compared_at FROM near_duplicate_pairs
    UNION ALL SELECT 'near_duplicate_pairs', CAST(pair_id AS VARCHAR), 'images', {image_id('right_stable_image_id')}, {image_id('right_stable_image_id')}, compared_at FROM near_duplicate_pairs
    UNION ALL SELECT 'synthesis_claims', {trimmed('claim_id')}, 'evidence', {key('e')}, {trimmed('e')}, recorded_at FROM (SELECT claim_id, recorded_at, unnest(supporting_evidence_ids) AS e FROM synthesis_claims)
    UNION ALL SELECT 'dataset_manifest', {trimmed('sample_id')}, 'files', {path('npz_path')}, {trimmed('npz_path')}, registered_at FROM dataset_manifest
  ) WHERE k IS NOT NULL GROUP BY ALL
), inv AS (
  SELECT {image_id('stable_image_id')} AS k, ingested_at, deleted_at, 'images' AS parent FROM sted_images
  UNION ALL SELECT {image_id('stable_image_id')}, ingested_at, deleted_at, 'blanks' FROM sted_blanks
), parents AS (
  SELECT parent, k, min(shown) AS shown, min(a) AS a, bool_and(d IS NOT NULL) AS gone FROM (
    SELECT parent, k, k AS shown, ingested_at AS a, deleted_at AS d FROM inv
    UNION ALL SELECT 'inventory', k, k, ingested_at, deleted_at FROM inv
    UNION ALL SELECT 'evidence', {key('evidence_id')}, {trimmed('evidence_id')}, recorded_at, retracted_at FROM evidence_items
    UNION ALL SELECT 'files', {path('file_path')}, {path('file_path')}, stored_at, deleted_at FROM stored_files
  ) WHERE k IS NOT NULL GROUP BY ALL
), judged AS (
  SELECT ref_table, record_key, coalesce(p.shown, r.shown) AS ref_value, r.t,
    CASE WHEN p.k IS NULL THEN 'missing' WHEN p.gone THEN 'deleted' WHEN p.a > r.t THEN 'late' END AS orphan_kind
  FROM refs r LEFT JOIN parents p ON r.parent = p.parent AND r.k = p.k
)
SELECT DISTINCT ref_table, record_key, ref_value, orphan_kind, strftime(t, '%Y-%m') AS period FROM judged WHERE orphan_kind IS NOT NULL
"""

P6_COUNTS = f"""
SELECT ref_table, period, orphan_kind, count(*) AS n_references, count(DISTINCT ref_value) AS n_keys FROM ({P6_FOUND}) GROUP BY 1, 2, 3
"""

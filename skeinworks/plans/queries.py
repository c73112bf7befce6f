"""Queries of the core operators over whole tables, and the SQL that checks them.

Vectors of ``embeddings`` serve as 8 x 8 single-channel images.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spelling as S
from ..functions import text as X
from ..operators import documents, duplicates, images, kernels, roles, rules, selection, vectors
from ..session import checkpointed, table
from ..sources.files import sample_range
from . import sqltext as Q

SIDE, KEY = 8, "vec_id"


def _t(spark: SparkSession, sf_dir: str, *names: str):
    out = [table(spark, sf_dir, n) for n in names]
    return out[0] if len(out) == 1 else out


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, so that both engines print the same; -0 becomes 0."""
    return df.select([(F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel table of the embeddings."""
    return images.pixel_table(_t(spark, sf_dir, "embeddings"), KEY, "embedding", SIDE)


def vector_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as decoded 8-bit images between -0.5 and 0.5, for the kernels."""
    def pack(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({KEY: b[KEY], "height": SIDE, "width": SIDE, "channels": 1, "dtype": "uint8", "pixels": [kernels.to_uint8(np.asarray(v, np.float64), -0.5, 0.5)[0].tobytes() for v in b["embedding"]]})

    return _t(spark, sf_dir, "embeddings").select(KEY, "embedding").mapInPandas(pack, f"{KEY} long, height int, width int, channels int, dtype string, pixels binary")


_PX = "px AS (SELECT vec_id, CAST((i - 1) // 8 AS INT) AS y, CAST((i - 1) % 8 AS INT) AS x, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i))"
#: Distance of a corner from the centre of an image.
_FAR = (4.0**2 + 4.0**2) ** 0.5
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _register(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def _r(x: str, alias: str) -> str:
    return f"round({x}, 6) + 0.0 AS {alias}"


# --- images as pixel tables -----------------------------------------------------------------------------------------

_PS = [p / 100 for p in kernels.PERCENTILES]
_register(
    "image_profile",
    lambda s, d: rounded(images.pixel_profile(pixels(s, d), KEY)),
    f"WITH {_PX} SELECT vec_id, {_r('min(v)', 'min')}, {_r('max(v)', 'max')}, {_r('avg(v)', 'mean')}, {_r('stddev_pop(v)', 'std')}, "
    + ", ".join(_r(f"quantile_cont(v, {p})", n) for p, n in zip(_PS, kernels.PERCENTILE_NAMES))
    + ", count(*) FILTER (v = 0) AS zero_count, count(*) FILTER (v > 0) AS positive_count FROM px GROUP BY vec_id",
)
_register(
    "block_stats",
    lambda s, d: rounded(images.pixel_blocks(pixels(s, d), KEY, 4)),
    f"WITH {_PX}, b AS (SELECT vec_id, avg(v) AS mean, var_pop(v) AS variance FROM px GROUP BY vec_id, y // 4, x // 4) SELECT vec_id, "
    + ", ".join(_r(f"quantile_cont({c}, {q})", f"local_{c}_{n}") for c in ("mean", "variance") for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")))
    + " FROM b GROUP BY vec_id",
)
_GRAD = (
    f"{_PX}, g AS (SELECT *, coalesce((lead(v) OVER (PARTITION BY vec_id, y ORDER BY x) - lag(v) OVER (PARTITION BY vec_id, y ORDER BY x)) / 2, 0) AS gx, "
    "coalesce((lead(v) OVER (PARTITION BY vec_id, x ORDER BY y) - lag(v) OVER (PARTITION BY vec_id, x ORDER BY y)) / 2, 0) AS gy FROM px)"
)
_register("gradients", lambda s, d: rounded(images.pixel_gradients(pixels(s, d), KEY)), f"WITH {_GRAD} SELECT vec_id, y, x, {_r('v', 'v')}, {_r('gx', 'gx')}, {_r('gy', 'gy')} FROM g")
_register(
    "orientation_resultant",
    lambda s, d: rounded(images.orientation_summary(images.pixel_gradients(pixels(s, d), KEY), KEY, 0.5)),
    f"WITH {_GRAD}, r AS (SELECT *, sqrt(gx * gx + gy * gy) AS ridge FROM g), c AS (SELECT vec_id, quantile_cont(ridge, 0.5) AS cut FROM r GROUP BY vec_id), "
    "t AS (SELECT vec_id, fmod(fmod(atan2(gy, gx) + pi() / 2, pi()) + pi(), pi()) AS th FROM r JOIN c USING (vec_id) WHERE ridge > cut) "
    f"SELECT vec_id, count(*) AS n_strong, {_r('avg(th)', 'orientation_mean')}, {_r('sqrt(pow(avg(cos(2 * th)), 2) + pow(avg(sin(2 * th)), 2))', 'resultant')} FROM t GROUP BY vec_id",
)
_register(
    "robust_mask",
    lambda s, d: rounded(images.robust_summary(pixels(s, d), KEY, 0.9, 2.0)),
    f"WITH {_PX}, m AS (SELECT vec_id, median(v) AS med, quantile_cont(v, 0.9) AS p FROM px GROUP BY vec_id), a AS (SELECT vec_id, median(abs(v - med)) AS mad FROM px JOIN m USING (vec_id) GROUP BY vec_id), "
    f"k AS (SELECT vec_id, v, greatest(p, med + 2e0 * {kernels.MAD_SCALE} * mad) AS cut, med FROM px JOIN m USING (vec_id) JOIN a USING (vec_id)), f AS (SELECT *, v >= cut AND v > med AS front FROM k) "
    f"SELECT vec_id, {_r('any_value(cut)', 'threshold')}, count(*) FILTER (front) AS n_front, {_r('(median(v) FILTER (front) - median(v) FILTER (NOT front)) / greatest(stddev_pop(v) FILTER (NOT front), 1e-6)', 'snr')} FROM f GROUP BY vec_id",
)
_register(
    "row_col_variation",
    lambda s, d: rounded(images.pixel_variation(pixels(s, d), KEY)),
    f"WITH {_PX}, r AS (SELECT vec_id, stddev_pop(m) AS r FROM (SELECT vec_id, avg(v) AS m FROM px GROUP BY vec_id, y) GROUP BY vec_id), c AS (SELECT vec_id, stddev_pop(m) AS c FROM (SELECT vec_id, avg(v) AS m FROM px GROUP BY vec_id, x) GROUP BY vec_id), "
    f"s AS (SELECT vec_id, CASE WHEN stddev_pop(v) = 0 THEN 1e0 ELSE stddev_pop(v) END AS s FROM px GROUP BY vec_id) SELECT vec_id, {_r('r / s', 'row_variation')}, {_r('c / s', 'column_variation')} FROM r JOIN c USING (vec_id) JOIN s USING (vec_id)",
)
_TAPS = kernels.gaussian_kernel(0.8, (SIDE, SIDE)).astype(float)
_K = "k(d, c) AS (VALUES " + ", ".join(f"({i - len(_TAPS) // 2}, {c!r}::DOUBLE)" for i, c in enumerate(_TAPS.tolist())) + ")"
_BLUR = (
    f"{_PX}, {_K}, h AS (SELECT vec_id, y, x + d AS x, sum(v * c) AS v FROM px, k WHERE x + d BETWEEN 0 AND 7 GROUP BY vec_id, y, x + d), "
    "low AS (SELECT vec_id, y + d AS y, x, sum(v * c) AS v FROM h, k WHERE y + d BETWEEN 0 AND 7 GROUP BY vec_id, y + d, x)"
)
_register("blur", lambda s, d: rounded(images.pixel_blur(pixels(s, d), KEY, 0.8, (SIDE, SIDE))), f"WITH {_BLUR} SELECT vec_id, y, x, {_r('v', 'v')} FROM low")


def decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual variance and spread of the low part of each image."""
    px = pixels(spark, sf_dir)
    low = images.pixel_blur(px, KEY, 0.8, (SIDE, SIDE)).withColumnRenamed("v", "low")
    q = F.percentile("low", F.array(F.lit(0.05), F.lit(0.95)))
    return rounded(px.join(low, [KEY, "y", "x"]).groupBy(KEY).agg(F.var_pop(F.col("v") - F.col("low")).alias("residual_variance"), (q[1] - q[0]).alias("low_spread")))


_register("decompose", decompose, f"WITH {_BLUR} SELECT vec_id, {_r('var_pop(px.v - low.v)', 'residual_variance')}, {_r('quantile_cont(low.v, 0.95) - quantile_cont(low.v, 0.05)', 'low_spread')} FROM px JOIN low USING (vec_id, y, x) GROUP BY vec_id")
_register(
    "uint8_map",
    lambda s, d: pixels(s, d).withColumn("level", images.uint8_levels(F.col("v"), -0.5, 0.5)).groupBy(KEY).agg(F.sum("level").alias("total"), F.count_if(F.col("v") < -0.5).alias("clipped_low"), F.count_if(F.col("v") > 0.5).alias("clipped_high"), F.count_if(F.col("level") == 255).alias("saturated")),
    f"WITH {_PX}, l AS (SELECT *, CAST(round_even(greatest(0e0, least(1e0, (v + 0.5e0) / 1e0)) * 255, 0) AS INT) AS level FROM px) SELECT vec_id, CAST(sum(level) AS BIGINT) AS total, count(*) FILTER (v < -0.5) AS clipped_low, count(*) FILTER (v > 0.5) AS clipped_high, count(*) FILTER (level = 255) AS saturated FROM l GROUP BY vec_id",
)
_register(
    "radial_rings",
    lambda s, d: rounded(images.radial_rings(pixels(s, d), KEY, (SIDE, SIDE), 5)),
    f"WITH {_PX}, r AS (SELECT vec_id, CAST(floor(sqrt((x - 4e0) * (x - 4e0) + (y - 4e0) * (y - 4e0)) * 5 / {_FAR!r}::DOUBLE) AS INT) AS ring, v FROM px), a AS (SELECT vec_id, ring, avg(v) AS m FROM r WHERE ring < 5 GROUP BY ALL) "
    f"SELECT e.vec_id, CAST(n AS INT) AS ring, {_r('coalesce(m, 0)', 'mean')} FROM embeddings e CROSS JOIN range(5) t(n) LEFT JOIN a ON a.vec_id = e.vec_id AND a.ring = n",
)


def components(diagonal: bool):
    """Number and greatest area of the components of pixels above the middle level."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = images.component_table(vector_images(spark, sf_dir), [KEY], 127.5, diagonal)
        return found.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_components"), F.max("comp_area").alias("max_area"), F.max(F.greatest("comp_height", "comp_width")).alias("max_side"))

    near = "greatest(abs(b.y - r.y), abs(b.x - r.x)) = 1" if diagonal else "abs(b.y - r.y) + abs(b.x - r.x) = 1"
    sql = (
        f"WITH RECURSIVE {_PX}, m AS (SELECT vec_id, y, x FROM px WHERE round_even(greatest(0e0, least(1e0, v + 0.5e0)) * 255, 0) > 127.5), "
        f"reach AS (SELECT vec_id, y * 8 + x AS seed, y, x FROM m UNION SELECT r.vec_id, r.seed, b.y, b.x FROM reach r JOIN m b ON b.vec_id = r.vec_id AND {near}), "
        "lab AS (SELECT vec_id, y, x, min(seed) AS c FROM reach GROUP BY ALL), box AS (SELECT vec_id, c, count(*) AS area, greatest(max(y) - min(y), max(x) - min(x)) + 1 AS side FROM lab GROUP BY ALL) "
        "SELECT vec_id, count(*) AS n_components, CAST(max(area) AS INT) AS max_area, CAST(max(side) AS INT) AS max_side FROM box GROUP BY vec_id"
    )
    return run, sql


_register("components4", *components(False))
_register("components8", *components(True))
_register("kernel_profile", lambda s, d: rounded(images.map_images(vector_images(s, d), lambda a, _: [{k: v for k, v in kernels.profile(a).items() if k in ("mean", "std", "p50", "zero_count")}], "mean double, std double, p50 double, zero_count long", [KEY])),
          f"WITH {_PX}, l AS (SELECT vec_id, CAST(round_even(greatest(0e0, least(1e0, v + 0.5e0)) * 255, 0) AS DOUBLE) AS v FROM px) SELECT vec_id, {_r('avg(v)', 'mean')}, {_r('stddev_pop(v)', 'std')}, {_r('median(v)', 'p50')}, count(*) FILTER (v = 0) AS zero_count FROM l GROUP BY vec_id")
_register("kernel_statistics", lambda s, d: images.image_statistics(vector_images(s, d), [KEY], block=4, sigma=1.0, size=8, bins=4))
_register("kernel_proxies", lambda s, d: images.image_proxies(vector_images(s, d), [KEY], k=2.0))
_register("kernel_decompositions", lambda s, d: images.decompositions(vector_images(s, d), [KEY], [0.5, 1.0], size=8, bins=4))


def kernel_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of the power spectrum (as logarithms) and of the autocorrelation, and the directional ratio, of each image."""
    out = images.spectra(vector_images(spark, sf_dir), [KEY], SIDE, 4)
    rings = [F.log10(F.col("power")[i].cast("double") + 1).alias(f"power_{i}") for i in range(4)] + [F.col("autocorrelation")[i].cast("double").alias(f"autocorrelation_{i}") for i in range(4)]
    return rounded(out.select(KEY, *rings, F.log10(F.col("directional_ratio") + 1).alias("direction")), 2)


_register(
    "kernel_spectra", kernel_spectra,
    f"WITH {_PX}, l AS (SELECT vec_id, y, x, round_even(greatest(0e0, least(1e0, v + 0.5e0)) * 255, 0) AS v FROM px), c AS (SELECT vec_id, y, x, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM l), k AS (SELECT a AS u, b AS w, (a + 4) % 8 AS row, (b + 4) % 8 AS col FROM range(8) s(a), range(8) t(b)), "
    "p AS (SELECT vec_id, row, col, pow(sum(v * cos(pi() / 4 * (u * y + w * x))), 2) + pow(sum(v * sin(pi() / 4 * (u * y + w * x))), 2) AS p FROM c, k GROUP BY ALL), "
    "q AS (SELECT a.vec_id, (b.y - a.y + 12) % 8 AS row, (b.x - a.x + 12) % 8 AS col, sum(a.v * b.v) AS ac FROM c a JOIN c b ON a.vec_id = b.vec_id GROUP BY ALL), z AS (SELECT vec_id, ac AS z FROM q WHERE row = 4 AND col = 4), "
    f"r AS (SELECT p.vec_id, p.row, p.col, p, CASE WHEN z <> 0 THEN ac / z ELSE ac END AS ac, floor(sqrt((p.row - 4e0) * (p.row - 4e0) + (p.col - 4e0) * (p.col - 4e0)) * 4 / {_FAR!r}::DOUBLE) AS ring FROM p JOIN q ON p.vec_id = q.vec_id AND p.row = q.row AND p.col = q.col JOIN z ON z.vec_id = p.vec_id) "
    "SELECT vec_id, " + ", ".join(f"round(log10(avg(p) FILTER (ring = {i}) + 1), 2) + 0.0 AS power_{i}, round(avg(ac) FILTER (ring = {i}), 2) + 0.0 AS autocorrelation_{i}" for i in range(4))
    + ", round(log10(avg(p) FILTER (row BETWEEN 2 AND 6) / greatest(avg(p) FILTER (col BETWEEN 2 AND 6), 1e-9) + 1), 2) + 0.0 AS direction FROM r GROUP BY vec_id",
)

# --- duplicates -----------------------------------------------------------------------------------------------------


def dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents numbered by equal text within their language."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("hash"))
    return duplicates.number_duplicates(docs, "lang", "doc_id", "hash", "text_duplicate_group", "dup_group").select("doc_id", "dup_group")


_register(
    "dup_groups", dup_groups,
    "WITH h AS (SELECT doc_id, lang, sha256(text) AS h FROM documents), g AS (SELECT lang, h, count(*) AS n, min(doc_id) AS f FROM h WHERE h IS NOT NULL GROUP BY ALL HAVING count(*) > 1), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f, h) AS i FROM g) SELECT doc_id, CASE WHEN i IS NOT NULL THEN 'text_duplicate_group_' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END END AS dup_group FROM h LEFT JOIN k ON h.lang IS NOT DISTINCT FROM k.lang AND h.h = k.h",
)


def pixel_dup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images numbered by equal pixels within their source root, in path order."""
    rows = _t(spark, sf_dir, "sted_images").select(S.image_id("stable_image_id").alias("id"), "source_root_id", "relative_path", S.sha256("pixel_sha256").alias("px"))
    rows = rows.groupBy("id").agg(F.min("source_root_id").alias("root"), F.min("relative_path").alias("path"), F.min("px").alias("px"))
    return duplicates.number_duplicates(rows.withColumn("at", F.concat_ws("|", "path", "id")), "root", "at", "px", "pixel_duplicate_group", "dup_group").where("dup_group IS NOT NULL").select("id", "dup_group")


_register(
    "pixel_dup_groups", pixel_dup_groups,
    f"WITH h AS (SELECT {Q.image_id('stable_image_id')} AS id, min(source_root_id) AS root, min(relative_path) AS path, min({Q.sha256('pixel_sha256')}) AS h FROM sted_images GROUP BY 1), g AS (SELECT root, h, min(path || '|' || id) AS f FROM h WHERE h IS NOT NULL GROUP BY ALL HAVING count(*) > 1), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY f, h) AS i FROM g) SELECT id, 'pixel_duplicate_group_' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END AS dup_group FROM h JOIN k USING (root, h)",
)
NCC = 0.4


def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of alike vectors."""
    return rounded(duplicates.near_pairs(_t(spark, sf_dir, "embeddings"), NCC, KEY, "embedding"))


_register("near_dup_pairs", near_dup_pairs, f"SELECT a.vec_id AS \"left\", b.vec_id AS \"right\", {_r('list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])', 'score')} FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {NCC}")
_register(
    "near_dup_groups", lambda s, d: duplicates.fold_pairs(near_dup_pairs(s, d).withColumns({"scope": F.lit("all"), "i": F.col("left"), "j": F.col("right")}), "scope", "near_duplicate_candidate"),
    f"WITH RECURSIVE s AS (SELECT a.vec_id AS l, b.vec_id AS r, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS w FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id), p AS (SELECT *, row_number() OVER (ORDER BY l, r) AS k FROM s WHERE w >= {NCC}), "
    "f AS (SELECT 0::BIGINT AS k, 0 AS n, MAP {0::BIGINT: 0} AS g UNION ALL SELECT f.k + 1, CASE WHEN g[l] IS NULL AND g[r] IS NULL THEN n + 1 ELSE n END, map_concat(g, MAP {l: coalesce(g[l], g[r], n + 1), r: coalesce(g[l], g[r], n + 1)}) FROM f JOIN p ON p.k = f.k + 1), "
    "e AS (SELECT unnest(map_entries(g)) AS e FROM f ORDER BY k DESC LIMIT (SELECT count(DISTINCT x) + 1 FROM (SELECT l AS x FROM p UNION ALL SELECT r FROM p))), last AS (SELECT x, arg_max(w, k) AS w FROM (SELECT l AS x, w, k FROM p UNION ALL SELECT r, w, k FROM p) GROUP BY x) "
    f"SELECT 'all' AS scope, e.key AS id, 'near_duplicate_candidate_' || lpad(CAST(e.value AS VARCHAR), 3, '0') AS \"group\", {_r('w', 'score')} FROM (SELECT e FROM e) t JOIN last ON last.x = e.key",
)


def near_dup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs at the published threshold within a scope, known duplicates excluded: vectors, slightly changed and equal copies."""
    v = _t(spark, sf_dir, "embeddings").select(F.col(KEY).alias("i"), F.col("embedding").cast("array<double>").alias("e"))
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("copy"), F.lit(x).alias("by")) for n, x in ((0, 0.0), (1, 0.01), (2, 0.05), (3, 0.0))]))
    moved = v.select("i", "e", kinds.alias("k")).select((F.col("i") * 4 + F.col("k.copy")).alias("id"), (F.col("i") % 3).alias("scope"), F.when(F.col("k.by") == 0, F.col("i")).alias("ex"), F.transform("e", lambda x, j: x + F.when(j % 2 == 0, F.col("k.by")).otherwise(-F.col("k.by"))).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = moved.select("id", "scope", "ex", norm.alias("n"), "v").select("id", "scope", "ex", F.transform("v", lambda x: x / F.col("n")).alias("v"))
    return rounded(duplicates.near_pairs(unit, 0.995, "id", "v", "scope", "ex"))


_register(
    "near_dup_exact", near_dup_exact,
    "WITH m AS (SELECT vec_id * 4 + c AS id, vec_id % 3 AS s, CASE WHEN b = 0 THEN vec_id END AS ex, list_transform(embedding::DOUBLE[], lambda x, j: x + CASE WHEN j % 2 = 1 THEN b ELSE -b END) AS v FROM embeddings, (VALUES (0, 0e0), (1, 0.01e0), (2, 0.05e0), (3, 0e0)) k(c, b)), "
    "u AS (SELECT id, s, ex, v, sqrt(list_dot_product(v, v)) AS n FROM m), w AS (SELECT a.id AS l, b.id AS r, list_dot_product(a.v, b.v) / (a.n * b.n) AS score FROM u a JOIN u b ON a.id < b.id AND a.s = b.s WHERE a.ex IS NULL OR b.ex IS NULL OR a.ex <> b.ex) "
    f"SELECT l AS \"left\", r AS \"right\", {_r('score', 'score')} FROM w WHERE score >= 0.995",
)

# --- roles, strata and rules ----------------------------------------------------------------------------------------

_ROLE = "CASE n WHEN 1 THEN 'calibration' WHEN 2 THEN CASE k WHEN 1 THEN 'calibration' ELSE 'held_out_test' END ELSE CASE k WHEN 1 THEN 'training' WHEN 2 THEN 'validation' WHEN 3 THEN 'held_out_test' WHEN 4 THEN 'calibration' ELSE 'training' END END"
_register(
    "role_allocation",
    lambda s, d: roles.allocate_roles(_t(s, d, "documents").select("doc_id", S.word("source").alias("source")), "source").select("doc_id", "source", "role", roles.role_reason(F.col("role")).alias("reason")),
    f"WITH x AS (SELECT doc_id, {Q.key('source')} AS source FROM documents), g AS (SELECT source, row_number() OVER (ORDER BY source) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM x WHERE source IS NOT NULL)), "
    f"r AS (SELECT doc_id, source, {_ROLE} AS role FROM x LEFT JOIN g USING (source)) SELECT *, 'provisional PN-level ' || CASE role WHEN 'held_out_test' THEN 'primary held-out test' ELSE role END || ' allocation' AS reason FROM r",
)
_register(
    "role_small_n",
    lambda s, d: roles.allocate_roles(_t(s, d, "lineitem"), "l_linestatus", "l_returnflag").groupBy("l_returnflag", "l_linestatus", "role").agg(F.count(F.lit(1)).alias("n_rows")),
    f"WITH g AS (SELECT l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_linestatus) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)) "
    f"SELECT l_returnflag, l_linestatus, {_ROLE} AS role, count(*) AS n_rows FROM lineitem JOIN g USING (l_returnflag, l_linestatus) GROUP BY ALL",
)
_register(
    "role_three_groups",
    lambda s, d: roles.allocate_roles(_t(s, d, "orders"), "o_orderstatus").groupBy("o_orderstatus", "role").agg(F.count(F.lit(1)).alias("n_rows")),
    f"WITH g AS (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT o_orderstatus FROM orders)) SELECT o_orderstatus, {_ROLE} AS role, count(*) AS n_rows FROM orders JOIN g USING (o_orderstatus) GROUP BY ALL",
)
_register(
    "group_leakage",
    lambda s, d: roles.leaking_groups(_t(s, d, "documents").select(S.word("source").alias("source"), (F.col("doc_id") % 3).cast("string").alias("role")), "source", "role"),
    f"SELECT source, string_agg(DISTINCT r, ';' ORDER BY r) AS roles FROM (SELECT {Q.key('source')} AS source, CAST(doc_id % 3 AS VARCHAR) AS r FROM documents) GROUP BY source HAVING count(DISTINCT r) > 1",
)


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and blanks in one table with clean keys (union by name, extra columns null)."""
    i, b = _t(spark, sf_dir, "sted_images", "sted_blanks")
    return i.unionByName(b, allowMissingColumns=True).withColumn("stable_image_id", S.image_id("stable_image_id"))


_INV = f"inv AS (SELECT {Q.image_id('stable_image_id')} AS id, source_kind FROM sted_images UNION ALL SELECT {Q.image_id('stable_image_id')}, source_kind FROM sted_blanks)"
_register(
    "split_anti",
    lambda s, d: roles.unmatched(inventory(s, d).select("stable_image_id"), _t(s, d, "sted_splits").select(S.image_id("stable_image_id").alias("stable_image_id")), "stable_image_id"),
    f"WITH {_INV}, sp AS (SELECT {Q.image_id('stable_image_id')} AS id FROM sted_splits) SELECT DISTINCT id AS stable_image_id, 'left' AS side FROM inv WHERE id NOT IN (SELECT id FROM sp) UNION SELECT id, 'right' FROM sp WHERE id NOT IN (SELECT id FROM inv)",
)
_register(
    "repeated_ids",
    lambda s, d: roles.repeated_keys(inventory(s, d), "stable_image_id"),
    f"WITH {_INV} SELECT id AS stable_image_id, count(*) AS n FROM inv GROUP BY id HAVING count(*) > 1",
)


def clean_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split rows with clean keys and roles."""
    return _t(spark, sf_dir, "sted_splits").select(
        S.image_id("stable_image_id").alias("stable_image_id"), "source_kind", S.key("biological_group_candidate").alias("biological_group_candidate"), S.key("acquisition_group").alias("acquisition_group"),
        S.condition("inferred_condition").alias("inferred_condition"), S.div("inferred_div").alias("inferred_div"), S.role("eligibility").alias("eligibility"), S.role("primary_metric_role").alias("primary_metric_role"),
        S.role("synthetic_split").alias("synthetic_split"), "secondary_image_eval_role",
    )


def split_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the split rules, counted per rule with examples."""
    found = rules.run_rules(rules.split_rules(), {"splits": clean_splits(spark, sf_dir), "inventory": inventory(spark, sf_dir).select("stable_image_id")})
    return rules.first_examples(found).select("rule", "n", F.array_join("examples", ";").alias("examples"))


_SP = f"sp AS (SELECT {Q.image_id('stable_image_id')} AS id, source_kind AS kind, {Q.key('biological_group_candidate')} AS b, {Q.key('acquisition_group')} AS a, {Q.role('eligibility')} AS e, {Q.role('primary_metric_role')} AS p, {Q.role('synthetic_split')} AS s, secondary_image_eval_role AS sec, upper({Q.key('inferred_condition')}) AS c, {Q.key('inferred_div')} AS dk FROM sted_splits)"
_cross = lambda g, w: f"SELECT {g} FROM sp WHERE {w} GROUP BY {g} HAVING count(DISTINCT e) > 1"
_register(
    "split_violations", split_violations,
    f"WITH {_INV}, {_SP}, v(rule, entity) AS (SELECT 'duplicate_split', id FROM sp GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'unknown_split', id FROM sp WHERE id NOT IN (SELECT id FROM inv) UNION ALL SELECT 'missing_split', id FROM inv WHERE id NOT IN (SELECT id FROM sp) "
    f"UNION ALL SELECT 'group_crosses_roles', x FROM ({_cross('b', 'true')}) t(x) UNION ALL SELECT 'fiber_group_crosses_roles', x FROM ({_cross('a', chr(39).join(['kind = ', 'fiber_image', '']))}) t(x) UNION ALL SELECT 'blank_group_crosses_roles', x FROM ({_cross('a', chr(39).join(['kind = ', 'blank_background', '']))}) t(x) "
    "UNION ALL SELECT 'role_differs', id FROM sp WHERE p IS DISTINCT FROM e UNION ALL SELECT 'blank_split_differs', id FROM sp WHERE kind = 'blank_background' AND s IS DISTINCT FROM e UNION ALL SELECT 'secondary_role', id FROM sp WHERE coalesce(sec NOT IN ('not_assigned', 'secondary_training', 'secondary_validation', 'secondary_test'), true)) "
    "SELECT rule, count(*) AS n, array_to_string(list_slice(list_sort(list_distinct(list(entity))), 1, 5), ';') AS examples FROM v GROUP BY rule",
)


def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key, reference and domain rules over orders and line items."""
    t = {n: _t(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "part")}
    return rules.run_rules([
        rules.unique("line_per_order", "lineitem", "l_orderkey"),
        rules.references("unknown_order", "lineitem", "l_orderkey", "orders", "o_orderkey", "l_orderkey"),
        rules.references("idle_customer", "customer", "c_custkey", "orders", "o_custkey", "c_custkey"),
        rules.in_domain("status", "orders", "o_orderstatus", ["F", "O"], "o_orderkey"),
        rules.check("discount", "lineitem", F.col("l_discount") > 0.09, "l_orderkey", "discount above 0.09"),
    ], t)


_register(
    "rule_violations", rule_violations,
    "SELECT 'line_per_order' AS rule, CAST(l_orderkey AS VARCHAR) AS entity, count(*) || ' rows' AS message FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 "
    "UNION ALL SELECT 'unknown_order', CAST(l_orderkey AS VARCHAR), 'unknown ' || l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) "
    "UNION ALL SELECT 'idle_customer', CAST(c_custkey AS VARCHAR), 'unknown ' || c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) "
    "UNION ALL SELECT 'status', CAST(o_orderkey AS VARCHAR), 'invalid o_orderstatus ' || coalesce(o_orderstatus, 'null') FROM orders WHERE coalesce(o_orderstatus NOT IN ('F', 'O'), true) "
    "UNION ALL SELECT 'discount', CAST(l_orderkey AS VARCHAR), 'discount above 0.09' FROM lineitem WHERE l_discount > 0.09",
)


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample manifest against the stored files by path, both directions, hashes compared."""
    m, f = _t(spark, sf_dir, "dataset_manifest", "stored_files")
    manifest = m.select(S.path("npz_path").alias("path"), S.sha256("npz_sha256").alias("hash")).where("path IS NOT NULL").groupBy("path").agg(F.max("hash").alias("hash"))
    files = f.select(S.path("file_path").alias("path"), S.sha256("file_sha256").alias("hash")).groupBy("path").agg(F.max("hash").alias("hash"))
    return rules.run_rules([rules.same_on_both("files", "manifest", "files", "path", ["hash"])], {"manifest": manifest, "files": files})


_register(
    "manifest_files", manifest_files,
    f"WITH m AS (SELECT {Q.path('npz_path')} AS p, max({Q.sha256('npz_sha256')}) AS h FROM dataset_manifest GROUP BY 1 HAVING p IS NOT NULL), f AS (SELECT {Q.path('file_path')} AS p, max({Q.sha256('file_sha256')}) AS h FROM stored_files GROUP BY 1) "
    "SELECT 'files' AS rule, coalesce(m.p, f.p) AS entity, CASE WHEN f.p IS NULL THEN 'absent from files' WHEN m.p IS NULL THEN 'absent from manifest' ELSE 'differs in hash' END AS message FROM m FULL JOIN f ON m.p = f.p WHERE m.p IS NULL OR f.p IS NULL OR m.h IS DISTINCT FROM f.h",
)
_register(
    "strata_report",
    lambda s, d: roles.strata_report(clean_splits(s, d), [["eligibility"], ["inferred_condition", "inferred_div"], ["eligibility", "inferred_condition", "inferred_div"]], "biological_group_candidate"),
    f"WITH {_SP}, x AS (SELECT *, CASE WHEN dk LIKE 'div_%' THEN 'DIV' || lpad(substr(dk, 5), CAST(greatest(2, length(dk) - 4) AS INT), '0') ELSE upper(dk) END AS dv FROM sp), "
    "y AS (SELECT 0 AS level, e, NULL AS c, NULL AS dv, count(*) AS n, count(DISTINCT b) AS g FROM x GROUP BY e UNION ALL SELECT 1, NULL, c, dv, count(*), count(DISTINCT b) FROM x GROUP BY c, dv UNION ALL SELECT 2, e, c, dv, count(*), count(DISTINCT b) FROM x GROUP BY e, c, dv) "
    "SELECT level, e AS eligibility, c AS inferred_condition, dv AS inferred_div, n AS n_rows, g AS n_groups, g < 3 AS thin FROM y",
)
_register(
    "split_summary",
    lambda s, d: clean_splits(s, d).groupBy("eligibility").agg(F.countDistinct("biological_group_candidate").alias("n_groups"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("source_kind") == "fiber_image").alias("n_fibers"), F.count_if(F.col("source_kind") == "blank_background").alias("n_blanks")),
    f"WITH {_SP} SELECT e AS eligibility, count(DISTINCT b) AS n_groups, count(*) AS n_rows, count(*) FILTER (kind = 'fiber_image') AS n_fibers, count(*) FILTER (kind = 'blank_background') AS n_blanks FROM sp GROUP BY e",
)
_register(
    "acquisition_groups",
    lambda s, d: roles.group_members(inventory(s, d).select("source_kind", S.key("biological_group_candidate").alias("bio"), S.key("acquisition_group").alias("acq"), "source_root_id", S.key("inferred_condition").alias("c"), S.key("inferred_round").alias("r")), ["source_kind", "bio", "acq"], {"root_ids": "source_root_id", "conditions": "c", "rounds": "r"}),
    f"SELECT source_kind, bio, acq, count(*) AS n_rows, coalesce(string_agg(DISTINCT root, ';' ORDER BY root), '') AS root_ids, coalesce(string_agg(DISTINCT c, ';' ORDER BY c), '') AS conditions, coalesce(string_agg(DISTINCT r, ';' ORDER BY r), '') AS rounds FROM ("
    + " UNION ALL ".join(f"SELECT source_kind, {Q.key('biological_group_candidate')} AS bio, {Q.key('acquisition_group')} AS acq, source_root_id AS root, {Q.key('inferred_condition')} AS c, {Q.key('inferred_round')} AS r FROM {t}" for t in ("sted_images", "sted_blanks"))
    + ") GROUP BY 1, 2, 3",
)
_register("flag_counts", lambda s, d: roles.flag_counts(_t(s, d, "sted_images"), "validation_flags"), "SELECT flag, count(*) AS n FROM (SELECT unnest(CASE WHEN coalesce(len(validation_flags), 0) > 0 THEN validation_flags ELSE ['none'] END) AS flag FROM sted_images) GROUP BY flag")
_register(
    "inventory_summary",
    lambda s, d: inventory(s, d).groupBy("source_kind").agg(F.count(F.lit(1)).alias("n_files"), F.count("dtype").alias("n_readable"), F.sum(F.col("shape_y").cast("long") * F.col("shape_x")).alias("n_pixels"), X.joined_values(F.concat_ws("x", "shape_y", "shape_x")).alias("shapes"), X.joined_values("dtype").alias("dtypes"), F.sum("saturation_count").alias("saturated")),
    "SELECT source_kind, count(*) AS n_files, count(dtype) AS n_readable, CAST(sum(CAST(shape_y AS BIGINT) * shape_x) AS BIGINT) AS n_pixels, string_agg(DISTINCT concat_ws('x', shape_y, shape_x), ';' ORDER BY concat_ws('x', shape_y, shape_x)) AS shapes, string_agg(DISTINCT dtype, ';' ORDER BY dtype) AS dtypes, CAST(sum(saturation_count) AS BIGINT) AS saturated FROM "
    "(SELECT source_kind, dtype, shape_y, shape_x, saturation_count FROM sted_images UNION ALL SELECT source_kind, dtype, shape_y, shape_x, saturation_count FROM sted_blanks) GROUP BY source_kind",
)
_register(
    "background_reuse",
    lambda s, d: vectors.background_reuse(clean_splits(s, d).where("source_kind = 'blank_background' AND acquisition_group IS NOT NULL"), "acquisition_group", "synthetic_split"),
    f"WITH {_SP} SELECT a AS acquisition_group, string_agg(DISTINCT s, ';' ORDER BY s) AS splits FROM sp WHERE kind = 'blank_background' AND a IS NOT NULL GROUP BY a HAVING count(DISTINCT s) > 1",
)

# --- selection and aggregates ---------------------------------------------------------------------------------------

_register(
    "deterministic_subset",
    lambda s, d: selection.spaced_subset(_t(s, d, "documents").select("doc_id", "n_chars"), "doc_id", 48),
    "WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents) SELECT doc_id, n_chars FROM r WHERE n <= 48 OR k IN (SELECT CAST(floor(i * ((SELECT count(*) FROM documents) - 1) / 47e0) AS BIGINT) FROM range(48) t(i))",
)
_register("first_rows", lambda s, d: selection.first_rows(_t(s, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", 8), "SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 8")
_register(
    "must_match",
    lambda s, d: selection.must_match(_t(s, d, "supplier"), _t(s, d, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey").select("s_suppkey", "n_name"),
    "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
_register(
    "representatives",
    lambda s, d: selection.representatives(_t(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), ["c_nationkey"], "c_custkey", "c_acctbal", "c_acctbal"),
    "WITH r AS (SELECT c_custkey, c_nationkey, c_acctbal, count(*) OVER w AS n, row_number() OVER (w ORDER BY c_custkey) AS k, row_number() OVER (w ORDER BY c_acctbal, c_custkey) - 1 AS m, row_number() OVER (w ORDER BY c_acctbal DESC, c_custkey DESC) AS t FROM customer WINDOW w AS (PARTITION BY c_nationkey)) "
    "SELECT c_custkey, c_nationkey, c_acctbal, CASE WHEN k = 1 THEN 'first' WHEN m = n // 2 THEN 'middle' ELSE 'top' END AS reason FROM r WHERE k = 1 OR m = n // 2 OR t = 1",
)
_FIELDS = ["l_quantity", "l_extendedprice", "l_discount"]
_AGG = "s AS (" + " UNION ALL ".join(f"SELECT l_returnflag, '{f}' AS field, median({f}) AS median, quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) AS iqr, quantile_cont({f}, 0.05) AS p05, quantile_cont({f}, 0.95) AS p95 FROM lineitem GROUP BY l_returnflag" for f in _FIELDS) + ")"
_summary = lambda s, d: selection.measure_summary(_t(s, d, "lineitem"), ["l_returnflag"], _FIELDS)
_register("group_aggregate", lambda s, d: rounded(_summary(s, d)), f"WITH {_AGG} SELECT l_returnflag, field, {_r('median', 'median')}, {_r('iqr', 'iqr')}, {_r('p05', 'p05')}, {_r('p95', 'p95')} FROM s")
_register("group_mismatch", lambda s, d: rounded(selection.group_differences(_summary(s, d), "l_returnflag", "N", ["A", "R"])), f"WITH {_AGG} SELECT a.field, a.l_returnflag, {_r('a.median - b.median', 'difference')} FROM s a JOIN s b ON a.field = b.field AND b.l_returnflag = 'N' WHERE a.l_returnflag IN ('A', 'R')")
_register("median_table", lambda s, d: rounded(selection.median_table(_summary(s, d), "l_returnflag", ["A", "N", "R", "X"])), f"WITH {_AGG} SELECT field, " + ", ".join(_r(f"max(median) FILTER (l_returnflag = '{g}')", f'"{g}"') for g in "ANRX") + " FROM s GROUP BY field")
_register(
    "global_percentiles",
    lambda s, d: rounded(images.histogram_percentiles(_t(s, d, "lineitem"), ["l_linestatus"], "l_quantity", [50, 95, 99, 99.9, 100])),
    "SELECT l_linestatus, p AS percentile, (SELECT count(l_quantity) FROM lineitem x WHERE x.l_linestatus = l.l_linestatus) AS n_values, v AS value FROM (SELECT l_linestatus, unnest([50e0, 95e0, 99e0, 99.9e0, 100e0]) AS p, unnest(quantile_cont(l_quantity, [0.5, 0.95, 0.99, 0.999, 1.0])) AS v FROM lineitem GROUP BY l_linestatus) l",
)
_register(
    "question_numbers",
    lambda s, d: selection.complete_set(_t(s, d, "synthesis_claims").where("question_number IS NOT NULL").select("section", "question_number"), "section", "question_number", s.range(1, 11).select(F.lit("question").alias("section"), F.col("id").cast("int").alias("question_number"))),
    "WITH h AS (SELECT DISTINCT section, question_number FROM synthesis_claims WHERE question_number IS NOT NULL), w AS (SELECT 'question' AS section, CAST(i AS INT) AS question_number FROM range(1, 11) t(i)) SELECT *, 'missing' AS problem FROM (SELECT * FROM w EXCEPT SELECT * FROM h) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM h EXCEPT SELECT * FROM w)",
)

# --- names, texts and nested records --------------------------------------------------------------------------------

_NAME = r"(?i)^(.+?) \(Series (\d+)\) \[(\d+)\]\.tif$"
_B = "split_part(relative_path, '/', -1)"
_P = f"regexp_extract({_B}, '{_NAME}', 1)"
_register(
    "name_parse",
    lambda s, d: _t(s, d, "sted_images").select("relative_path", X.name_parts(F.col("relative_path")).alias("n")).distinct().select("relative_path", "n.*"),
    f"WITH x AS (SELECT DISTINCT relative_path, {_P} AS pre, regexp_extract({_B}, '{_NAME}', 2) AS s, regexp_extract({_B}, '{_NAME}', 3) AS b, regexp_replace({_B}, '(.)\\.[^.]*$', '\\1') AS stem FROM sted_images), "
    "y AS (SELECT *, pre <> '' AS ok, coalesce(nullif(split_part(pre, '_', 2), ''), 'unknown') AS r, coalesce(nullif(split_part(pre, '_', 3), ''), 'unknown') AS c, coalesce(nullif(split_part(pre, '_', 4), ''), 'unknown') AS dv, CASE WHEN regexp_full_match(split_part(pre, '_', 1), '(?i)PN\\d+') THEN split_part(pre, '_', 1) ELSE 'unknown' END AS pn FROM x) "
    "SELECT relative_path, CASE WHEN ok THEN pre ELSE stem END AS prefix, pn AS inferred_pn, r AS inferred_round, c AS inferred_condition, dv AS inferred_div, CASE WHEN ok THEN s ELSE 'unknown' END AS series_index, CASE WHEN ok THEN b ELSE 'unknown' END AS bracket_index, CASE WHEN ok THEN pre ELSE stem END AS acquisition_group, pn AS biological_group_candidate, CASE WHEN ok THEN 'parsed' ELSE 'unparsed' END AS parse_status FROM y",
)
_register(
    "stable_id",
    lambda s, d: _t(s, d, "documents").select("doc_id", X.stable_id(F.col("source"), F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("id")),
    "SELECT doc_id, 'img_' || substr(sha256(source || ':' || doc_id || ':' || sha256(coalesce(text, ''))), 1, 20) AS id FROM documents",
)
_register(
    "pixel_hash",
    lambda s, d: _t(s, d, "documents").select("doc_id", X.pixel_hash(F.lit(1), F.length("text"), F.lit("uint8"), F.encode("text", "UTF-8")).alias("hash")),
    "SELECT doc_id, sha256('(1, ' || length(text) || ')' || 'uint8' || text) AS hash FROM documents",
)
_register(
    "number_text",
    lambda s, d: _t(s, d, "orders").select("o_orderkey", X.number_text(F.col("o_totalprice")).alias("plain"), X.number_text(F.col("o_totalprice") / 1000, 4).alias("short")),
    "SELECT o_orderkey, format('{:.6g}', o_totalprice) AS plain, format('{:.4g}', o_totalprice / 1000) AS short FROM orders",
)
_register("json_get", lambda s, d: _t(s, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(0)).alias("k")), "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0) AS k FROM events")
_register(
    "json_nodes",
    lambda s, d: documents.tree_nodes(_t(s, d, "events"), "event_id", "props"),
    "SELECT event_id, '$' AS path, 'object' AS kind, CAST(NULL AS VARCHAR) AS value FROM events WHERE props IS NOT NULL UNION ALL SELECT event_id, '$.k', 'integer', json_extract_string(props, '$.k') FROM events WHERE props IS NOT NULL",
)
_SCHEMA = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 89}}}
_register(
    "schema_violations",
    lambda s, d: documents.schema_violations(_t(s, d, "events"), "event_id", "props", _SCHEMA),
    "SELECT event_id, '$.k' AS path, CASE WHEN k < 10 THEN 'is below 10' ELSE 'is above 89' END AS message FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) WHERE k < 10 OR k > 89",
)
_register(
    "list_flatten",
    lambda s, d: _t(s, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), X.joined_values("p_type").alias("types")),
    "SELECT p_brand, count(*) AS n, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS types FROM part GROUP BY p_brand",
)
_register(
    "nested_flatten",
    lambda s, d: documents.flattened(_t(s, d, "synthesis_claims").select(F.struct("claim_id", F.struct("supporting_papers", "confidence").alias("summary")).alias("card")), {"claim_id": "card.claim_id", "papers": "card.summary.supporting_papers", "confidence": "card.summary.confidence"}),
    "SELECT claim_id, array_to_string(supporting_papers, ';') AS papers, confidence FROM synthesis_claims",
)
_register(
    "evidence_links",
    lambda s, d: documents.linked_evidence(_t(s, d, "synthesis_claims"), "claim_id", "supporting_evidence_ids"),
    r"SELECT claim_id, e AS evidence, regexp_extract(e, '^(.*)-E\d+$', 1) AS owner FROM (SELECT claim_id, unnest(list_distinct(supporting_evidence_ids)) AS e FROM synthesis_claims)",
)
_register(
    "foreign_evidence",
    lambda s, d: documents.foreign_evidence(_t(s, d, "synthesis_claims"), "claim_id", "supporting_evidence_ids", "supporting_papers"),
    r"SELECT * FROM (SELECT claim_id, e AS evidence, regexp_extract(e, '^(.*)-E\d+$', 1) AS owner, supporting_papers AS p FROM (SELECT claim_id, supporting_papers, unnest(list_distinct(supporting_evidence_ids)) AS e FROM synthesis_claims)) WHERE owner <> '' AND NOT coalesce(list_contains(p, owner), false)".replace("SELECT * FROM", "SELECT claim_id, evidence, owner FROM", 1),
)
_tick = lambda c: f"CASE WHEN coalesce(len({c}), 0) > 0 THEN array_to_string(list_transform({c}, lambda x: '`' || x || '`'), ', ') ELSE 'None' END"
_register(
    "claim_blocks",
    lambda s, d: documents.claim_blocks(_t(s, d, "synthesis_claims")),
    "SELECT claim_id, section, concat_ws(chr(10) || chr(10), '### ' || claim_id || ': ' || title, '**Claim:** ' || claim, '**Evidence class:** `' || claim_class || '`', '**Supporting papers:** ' || " + _tick("supporting_papers") + ", '**Supporting evidence:** ' || " + _tick("supporting_evidence_ids")
    + ", '**Contradicting or limiting papers:** ' || " + _tick("limiting_papers") + ", '**Limiting evidence:** ' || " + _tick("limiting_evidence_ids") + ", '**Confidence:** `' || confidence || '`', '**Hypothesis status:** `' || hypothesis_status || '`', '**Implication for the STED project:** ' || sted_implication) AS block FROM synthesis_claims",
)

# --- vector geometry ------------------------------------------------------------------------------------------------

#: Side of the raster on which each vector's strands are drawn.
RASTER = 32
#: Three strands of one or two segments from the first ten numbers of a vector (strand, segment, four places in it, radius, intensity); 1 and 3 share a node.
SEGMENT_PLACES = [(1, 0, (1, 2, 3, 4), 1.5, 10.0), (1, 1, (3, 4, 5, 6), 1.5, 10.0), (2, 0, (7, 8, 1, 3), 2.0, 5.0), (3, 0, (5, 6, 9, 10), 1.0, 7.0), (3, 1, (9, 10, 9, 10), 1.0, 7.0)]
NODE_ROWS = [(1, 0), (1, 1), (2, 2), (2, 3), (3, 1), (3, 4)]


def vector_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strands of every vector as a segment table; a sample per vector."""
    at = lambda i: F.lit(RASTER / 2) + F.lit(40.0) * F.col("embedding")[i - 1].cast("double")
    rows = [F.struct(F.lit(f).alias("fiber_id"), F.lit(q).alias("seq"), *[at(i).alias(n) for i, n in zip(p, ("x0", "y0", "x1", "y1"))], F.lit(r).alias("radius"), F.lit(v).alias("intensity")) for f, q, p, r, v in SEGMENT_PLACES]
    return _t(spark, sf_dir, "embeddings").select(F.col(KEY).alias("sample_id"), F.explode(F.array(*rows)).alias("s")).select("sample_id", "s.*")


def vector_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of those strands."""
    rows = F.array(*[F.struct(F.lit(f).alias("fiber_id"), F.lit(n).alias("node")) for f, n in NODE_ROWS])
    return _t(spark, sf_dir, "embeddings").select(F.col(KEY).alias("sample_id"), F.explode(rows).alias("n")).select("sample_id", "n.*")


_SEG = "seg AS (" + " UNION ALL ".join(
    f"SELECT vec_id AS id, {f} AS f, {q} AS q, " + ", ".join(f"{RASTER / 2}e0 + 40e0 * CAST(embedding[{i}] AS DOUBLE) AS {n}" for i, n in zip(p, ("x0", "y0", "x1", "y1"))) + f", {r}::DOUBLE AS r, {v}::DOUBLE AS i FROM embeddings" for f, q, p, r, v in SEGMENT_PLACES
) + ")"
_MEM = (
    f"{_SEG}, g AS (SELECT y, x, y + 0.5e0 AS cy, x + 0.5e0 AS cx FROM range({RASTER}) a(y), range({RASTER}) b(x)), t AS (SELECT id, f, i, y, x, cx, cy, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy, r, (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) AS s FROM seg, g), "
    "u AS (SELECT *, CASE WHEN s > 1e-6 THEN greatest(0e0, least(1e0, ((cx - x0) * dx + (cy - y0) * dy) / s)) ELSE 0e0 END AS k FROM t), mem AS (SELECT DISTINCT id, f, i, y, x FROM u WHERE pow(cx - x0 - k * dx, 2) + pow(cy - y0 - k * dy, 2) <= r * r)"
)
_register("rasterize", lambda s, d: vectors.rasterized(vector_segments(s, d), RASTER, RASTER).select("sample_id", "fiber_id", "y", "x", "intensity"), f"WITH {_MEM} SELECT id AS sample_id, f AS fiber_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, i AS intensity FROM mem")
_register("overlap_counts", lambda s, d: vectors.accumulated(vectors.rasterized(vector_segments(s, d), RASTER, RASTER)).select("sample_id", "y", "x", "source", "overlap"), f"WITH {_MEM} SELECT id AS sample_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, sum(i) AS source, count(*) AS overlap FROM mem GROUP BY ALL")
_register(
    "crossings",
    lambda s, d: rounded(vectors.crossing_hits(vector_segments(s, d), vector_nodes(s, d))),
    f"WITH {_SEG}, n(f, k) AS (VALUES " + ", ".join(map(str, NODE_ROWS)) + "), p AS (SELECT a.id, a.f AS a, b.f AS b, a.q AS seq_a, b.q AS seq_b, a.x0 AS ax, a.y0 AS ay, a.x1 - a.x0 AS ux, a.y1 - a.y0 AS uy, b.x1 - b.x0 AS vx, b.y1 - b.y0 AS vy, b.x0 - a.x0 AS gx, b.y0 - a.y0 AS gy FROM seg a JOIN seg b ON a.id = b.id AND a.f < b.f WHERE NOT EXISTS (SELECT 1 FROM n m JOIN n o ON m.k = o.k WHERE m.f = a.f AND o.f = b.f)), "
    "h AS (SELECT *, ux * vy - uy * vx AS det FROM p WHERE abs(ux * vy - uy * vx) >= 1e-6), k AS (SELECT *, (gx * vy - gy * vx) / det AS t, (gx * uy - gy * ux) / det AS w FROM h) "
    f"SELECT id AS sample_id, a, b, seq_a, seq_b, {_r('ax + t * ux', 'x')}, {_r('ay + t * uy', 'y')} FROM k WHERE t BETWEEN 0 AND 1 AND w BETWEEN 0 AND 1",
)
#: Shape, points and strand numbers of the published configuration.
GEOMETRY = {"image_shape": [1024, 1024], "base_seed": 10, "fiber_count_range": [7, 12], "points_per_fiber": 96, "fiber_radius_px": 2.0}
SAMPLE = {"geometry": GEOMETRY, "rendering": {"base_seed": 20, "psf_sigma_px": 0.5, "background_noise_std": 1.0}}


def generated(spark: SparkSession) -> DataFrame:
    """Geometries of eight samples."""
    return vectors.geometries(sample_range(spark, 8), GEOMETRY)


_register("geometry_gen", lambda s, d: generated(s).select("sample_index", F.size("fibers").alias("n_fibers"), F.size("nodes").alias("n_nodes")))


def geometry_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaced crossings of the generated geometries, found by the relational join and the ordered fold."""
    g = checkpointed(generated(spark))
    return vectors.spaced_crossings(vectors.crossing_hits(vectors.geometry_segments(g), vectors.geometry_nodes(g)))


_register("geometry_crossings", geometry_crossings)


def sample_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with their hash and mapping counts."""
    return vectors.samples(sample_range(spark, 8), SAMPLE).select("sample_id", "npz_sha256", F.size("arrays").alias("n_arrays"), F.col("counts")["saturation_count"].alias("saturated"))


_register("sample_set", sample_set)
_register("sample_violations", lambda s, d: vectors.sample_violations(vectors.samples(sample_range(s, 8), SAMPLE), SAMPLE))


def composite_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples composited onto backgrounds of the published size, each with a level of its own."""
    side = GEOMETRY["image_shape"][0]
    blanks = sample_range(spark, 8).select("sample_index", F.lit(side).alias("height"), F.lit(side).alias("width"), F.lit(1).alias("channels"), F.lit("uint8").alias("dtype"), F.unhex(F.repeat(F.lpad(F.hex(F.col("sample_index") + 4), 2, "0"), side * side)).alias("pixels"))
    return vectors.composites(blanks, {"geometry": {**GEOMETRY, "base_seed": 1}, "compositing": {"base_seed": 3}, "real_blank_rendering": {"psf_sigma_px": 0.5}}).select("sample_id", "npz_sha256", F.size("arrays").alias("n_arrays"))


_register("composite_set", composite_set)

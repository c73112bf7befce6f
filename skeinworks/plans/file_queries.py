"""Queries over files: each writes files made from a whole table, reads them back, and is checked by SQL on the table.

The images are made from ``supplier`` by a formula that SQL knows too; every
tenth file is broken. Files lie in a folder of their own under the shared
folder of the session.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spelling as S
from ..functions import text as X
from ..operators import images, kernels, literature, roles
from ..session import checkpointed, shared_dir, table
from ..sources import files, sinks, tiff
from . import pipelines
from . import sqltext as Q

CONDITIONS = ["AD", "CBD", "PSP"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, folder: str, content: Callable[[dict], tuple[str, bytes]]) -> str:
    """Write a file per row from the executors; ``content`` gives its name and bytes."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                sinks.put_bytes(folder, *content(r))
            yield pd.DataFrame({"n": [len(b)]})

    rows.mapInPandas(run, "n long").agg(F.sum("n")).collect()
    return folder


def _image(r: dict) -> tuple[str, bytes]:
    s = int(r["s_suppkey"])
    name = f"PN{s:04d}_{s % 4 + 1}R_{CONDITIONS[s % 3]}_DIV{s % 22:02d} (Series {s % 9}) [1].tif"
    if s % 10 == 0:
        return name, b"xx"
    y, x = np.mgrid[0 : 16 + s % 5 * 4, 0 : 24 + s % 3 * 8]
    page = np.minimum((7 * s + 11 * y + 13 * x + x * y) % 257, 255).astype(np.uint8)
    return name, tiff.write_pages([page] * (1 + s % 2))


_IM = (
    "im AS (SELECT s_suppkey AS s, 16 + s_suppkey % 5 * 4 AS h, 24 + s_suppkey % 3 * 8 AS w, s_suppkey % 10 <> 0 AS ok, format('PN{:04d}_{}R_{}_DIV{:02d} (Series {}) [1].tif', s_suppkey, s_suppkey % 4 + 1, "
    "['AD', 'CBD', 'PSP'][s_suppkey % 3 + 1], s_suppkey % 22, s_suppkey % 9) AS path FROM supplier), "
    "px AS (SELECT s, path, h, w, y, x, least((7 * s + 11 * y + 13 * x + x * y) % 257, 255) AS v FROM im, range(0, 32) a(y), range(0, 40) b(x) WHERE ok AND y < h AND x < w)"
)
_STATS = (
    f"{_IM}, st AS (SELECT path, min(v)::DOUBLE AS lo, max(v)::DOUBLE AS hi, avg(v) AS mean, stddev_pop(v) AS std, count(*) FILTER (v = 255) AS sat, count(*) FILTER (v = 0) AS zero, "
    + ", ".join(f"quantile_cont(v::DOUBLE, {p / 100!r}) AS {n}" for n, p in zip(kernels.PERCENTILE_NAMES, kernels.PERCENTILES))
    + ", sha256(encode('(' || any_value(h) || ', ' || any_value(w) || ')uint8') || unhex(string_agg(printf('%02x', v), '' ORDER BY y, x))) AS sha FROM px GROUP BY path)"
)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _register(name: str, run, sql: str) -> None:
    QUERIES[name], SQL[name] = run, sql


def _r(x: str, alias: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0 AS {alias}"


def image_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of the suppliers' images."""
    return written(table(spark, sf_dir, "supplier").select("s_suppkey"), _folder(spark, "images"), _image)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits; -0 becomes 0."""
    return df.select([(F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema])


def tiff_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole inventory of an image folder: statistics, pixel hash, name parts and flags of each file."""
    rows = pipelines.inventory(spark, image_folder(spark, sf_dir), "made", "fiber_image")
    has = lambda flag: F.exists(F.coalesce("validation_flags", F.array().cast("array<string>")), lambda x: x.startswith(flag))
    return rounded(rows.select(
        "relative_path", "shape_y", "shape_x", "frames", "channels", "dtype", "bit_depth", "min", "max", "mean", "std", *kernels.PERCENTILE_NAMES, "saturation_value", "saturation_count", "zero_count", "pixel_sha256",
        "inferred_pn", "inferred_round", "inferred_condition", "inferred_div", "series_index", has("unexpected_shape").alias("odd_shape"), has("saturation").alias("saturated"), has("unreadable").alias("unreadable"),
    ), 8)


_register(
    "tiff_inventory", tiff_inventory,
    f"WITH {_STATS}, e AS (SELECT h, w FROM im WHERE ok ORDER BY path LIMIT 1) SELECT im.path AS relative_path, CASE WHEN ok THEN CAST(im.h AS INT) END AS shape_y, CASE WHEN ok THEN CAST(im.w AS INT) END AS shape_x, CASE WHEN ok THEN CAST(1 + s % 2 AS INT) END AS frames, "
    "CASE WHEN ok THEN 1 END AS channels, CASE WHEN ok THEN 'uint8' END AS dtype, CASE WHEN ok THEN 8 END AS bit_depth, "
    + ", ".join(_r(a, b, 8) for a, b in [("lo", "min"), ("hi", "max"), ("mean", "mean"), ("std", "std"), *((n, n) for n in kernels.PERCENTILE_NAMES)])
    + ", CASE WHEN ok THEN 255.0::DOUBLE END AS saturation_value, sat AS saturation_count, zero AS zero_count, sha AS pixel_sha256, format('PN{:04d}', s) AS inferred_pn, (s % 4 + 1) || 'R' AS inferred_round, ['AD', 'CBD', 'PSP'][s % 3 + 1] AS inferred_condition, "
    "format('DIV{:02d}', s % 22) AS inferred_div, CAST(s % 9 AS VARCHAR) AS series_index, ok AND (im.h <> e.h OR im.w <> e.w) AS odd_shape, coalesce(sat > 0, false) AS saturated, NOT ok AS unreadable FROM im LEFT JOIN st ON im.path = st.path, e",
)


def tiff_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text cells of the manifest of that folder, read again from the CSV that was written."""
    folder = image_folder(spark, sf_dir)
    cells = pipelines.manifest_cells(pipelines.inventory(spark, folder, "made", "blank_background"))
    columns = ["relative_path", "source_root_id", "source_kind", "shape_y", "frames", "dtype", "mean", "std", "p25", "saturation_count", "pixel_sha256", "validation_date", "intended_split_status"]
    sinks.write_csv(cells, f"{folder}-manifest", columns)
    return files.read_csv(spark, f"{folder}-manifest", columns)


_register(
    "tiff_manifest", tiff_manifest,
    f"WITH {_STATS}, c AS (SELECT im.*, st.* EXCLUDE path FROM im LEFT JOIN st ON im.path = st.path) SELECT path AS relative_path, 'made' AS source_root_id, 'blank_background' AS source_kind, CASE WHEN ok THEN CAST(h AS VARCHAR) ELSE 'not_readable' END AS shape_y, "
    "CASE WHEN ok THEN CAST(1 + s % 2 AS VARCHAR) ELSE 'not_readable' END AS frames, CASE WHEN ok THEN 'uint8' ELSE 'not_readable' END AS dtype, "
    + ", ".join(f"CASE WHEN ok THEN {Q.whole_number(c)} ELSE 'not_readable' END AS {c}" for c in ("mean", "std", "p25"))
    + ", CASE WHEN ok THEN CAST(sat AS VARCHAR) ELSE 'not_readable' END AS saturation_count, coalesce(sha, 'not_available') AS pixel_sha256, 'not_recorded' AS validation_date, 'unassigned' AS intended_split_status FROM c",
)


#: Added before rounding to two digits, so that means that end on a half there don't depend on the last bit of 32.
OFFSET = 0.00123


def _near(x: str, alias: str) -> str:
    return f"round({x} + {OFFSET!r}, 2) + 0.0 AS {alias}"


def tiff_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appearance statistics of the decoded images: moments, block quartiles, row and column variation."""
    decoded = files.decode_images(files.scan_files(spark, image_folder(spark, sf_dir)), "made", "fiber_image")
    out = images.image_statistics(decoded, ["relative_path"], block=4, sigma=1.0, size=16, bins=4)
    out = out.select("relative_path", "mean", "std", "zero_fraction", "saturation_fraction", *[f"local_{m}_{p}" for m in ("mean", "variance") for p in ("p25", "p50", "p75")], "row_variation", "column_variation", "p5", "p50", "p99")
    return rounded(out.select("relative_path", *[(F.col(c) + F.lit(OFFSET)).alias(c) for c in out.columns[1:]]), 2)


_register(
    "tiff_statistics", tiff_statistics,
    f"WITH {_IM}, b AS (SELECT path, y // 4 AS i, x // 4 AS j, avg(v) AS m, var_pop(v) AS q FROM px GROUP BY ALL), l AS (SELECT path, "
    + ", ".join(_near(f"quantile_cont({c}, {p})", f"local_{n}_p{round(p * 100)}") for c, n in (("m", "mean"), ("q", "variance")) for p in (0.25, 0.5, 0.75))
    + " FROM b GROUP BY path), w AS (SELECT path, stddev_pop(v) AS sd FROM px GROUP BY path), ry AS (SELECT path, stddev_pop(m) AS s FROM (SELECT path, y, avg(v) AS m FROM px GROUP BY ALL) GROUP BY path), cx AS (SELECT path, stddev_pop(m) AS s FROM (SELECT path, x, avg(v) AS m FROM px GROUP BY ALL) GROUP BY path), "
    f"g AS (SELECT path AS relative_path, {_near('avg(v)', 'mean')}, {_near('stddev_pop(v)', 'std')}, {_near('avg((v = 0)::INT)', 'zero_fraction')}, {_near('avg((v = 255)::INT)', 'saturation_fraction')}, "
    + ", ".join(_near(f"quantile_cont(v::DOUBLE, {p / 100!r})", f"p{p}") for p in (5, 50, 99))
    + f" FROM px GROUP BY path) SELECT g.*, l.* EXCLUDE path, {_near('ry.s / sd', 'row_variation')}, {_near('cx.s / sd', 'column_variation')} FROM g JOIN l ON l.path = relative_path JOIN w ON w.path = relative_path JOIN ry ON ry.path = relative_path JOIN cx ON cx.path = relative_path",
)


def tiff_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evenly spaced images of the folder, found without opening a file."""
    from ..operators.selection import spaced_subset

    return spaced_subset(files.scan_files(spark, image_folder(spark, sf_dir)).select("relative_path"), "relative_path", 7)


_register("tiff_subset", tiff_subset, f"WITH {_IM}, k AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS i, count(*) OVER () AS n FROM im) SELECT path AS relative_path FROM k WHERE i IN (SELECT CAST(floor(j * (n - 1) / 6) AS BIGINT) FROM range(7) t(j))")


def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing and hashes of a folder with a file for each document, in one folder per language."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    folder = written(docs, _folder(spark, "texts"), lambda r: (f"{r['doc_id']}.txt", r["text"].encode()))
    found = files.scan_files(spark, folder, "*.txt")
    return found.select("relative_path", "length", F.sha2("content", 256).alias("sha256"))


_register("file_scan", file_scan, "SELECT doc_id || '.txt' AS relative_path, CAST(strlen(text) AS BIGINT) AS length, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL")


def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as CSV and read again: quotes, commas, line ends and outer spaces stay."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.regexp_replace("text", r"\r", " "))
    place = _folder(spark, "csv")
    sinks.write_csv(docs, place, ["doc_id", "text", "source", "absent"])
    return files.read_csv(spark, place, ["doc_id", "text", "source", "absent"])


_register("csv_files", csv_files, "SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(replace(text, chr(13), ' '), '') AS text, coalesce(source, '') AS source, '' AS absent FROM documents")


def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims written as JSON lines and read again with a schema."""
    claims = table(spark, sf_dir, "synthesis_claims").select("claim_id", "title", "question_number", "supporting_papers")
    place = _folder(spark, "jsonl")
    claims.select(F.to_json(F.struct("*")).alias("value")).write.text(place)
    got = files.read_jsonl(spark, place, "claim_id string, title string, question_number int, supporting_papers array<string>")
    return got.select("claim_id", "title", "question_number", F.array_join("supporting_papers", ";", "?").alias("papers"))


_register("json_lines", json_lines, "SELECT claim_id, title, question_number, array_to_string(list_transform(supporting_papers, lambda x: coalesce(x, '?')), ';') AS papers FROM synthesis_claims")


def npz_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors packed into compressed NPZ files, a file each, and read again as arrays."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    folder = written(vectors, _folder(spark, "npz"), lambda r: (f"{r['vec_id']}.npz", sinks.npz_bytes({"v": np.asarray(r["v"]), "id": np.asarray([r["vec_id"]])})))
    got = files.read_npz(files.scan_files(spark, folder, "*.npz"), ["v"])

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"relative_path": b["relative_path"], "dtype": b["dtype"], "size": [int(np.prod(s)) for s in b["shape"]], "total": [float(np.frombuffer(d, t).sum()) for d, t in zip(b["data"], b["dtype"])]})

    return rounded(got.mapInPandas(total, "relative_path string, dtype string, size long, total double"))


_register("npz_files", npz_files, f"SELECT vec_id || '.npz' AS relative_path, '<f8' AS dtype, CAST(len(embedding) AS BIGINT) AS size, {_r('list_sum(list_transform(embedding, lambda x: x::DOUBLE))', 'total')} FROM embeddings")


def yaml_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject areas, a fixed table of ten rows, written as YAML and read again."""
    import json
    import tempfile
    from pathlib import Path

    rows = [r.asDict() for r in table(spark, sf_dir, "subject_areas").select("subject", "about").orderBy("subject").collect()]
    with tempfile.TemporaryDirectory() as at:  # read by the driver alone
        path = Path(at, "areas.yaml")
        path.write_text("areas:\n" + "".join(f"  - subject: {json.dumps(r['subject'])}\n    about: {json.dumps(r['about'])}\n" for r in rows), encoding="utf-8")
        return files.yaml_records(spark, path, "areas", "subject string, about string")


_register("yaml_rows", yaml_rows, "SELECT subject, about, CAST(row_number() OVER (ORDER BY subject) - 1 AS INT) AS position FROM subject_areas")


def path_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source paths of all images from their configured roots; an unknown root has none."""
    rows = table(spark, sf_dir, "sted_images").select("source_root_id", "relative_path")
    known = "sted_fiber_data"
    return files.resolve_paths(rows, {known: "/data/fibers"}).groupBy("source_root_id").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("source_path").alias("n_paths"), F.min("source_path").alias("first"))


_register("path_resolution", path_resolution, "SELECT source_root_id, count(*) AS n_rows, count(DISTINCT CASE WHEN source_root_id = 'sted_fiber_data' THEN relative_path END) AS n_paths, min(CASE WHEN source_root_id = 'sted_fiber_data' THEN '/data/fibers/' || relative_path END) AS first FROM sted_images GROUP BY source_root_id")
_register(
    "whole_numbers", lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", X.number_text(F.col("l_quantity"), whole=True).alias("quantity"), X.number_text(F.col("l_extendedprice") / 7, whole=True).alias("part")),
    f"SELECT l_orderkey, l_linenumber, {Q.whole_number('l_quantity')} AS quantity, {Q.whole_number('(l_extendedprice / 7)')} AS part FROM lineitem",
)


def group_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allocation of every sample group: rows, roles, kinds, conditions and DIVs."""
    t = table(spark, sf_dir, "sted_splits").select(S.key("biological_group_candidate").alias("g"), S.role("eligibility").alias("e"), "source_kind", S.condition("inferred_condition").alias("c"), S.key("inferred_div").alias("v"))
    return roles.group_members(t.where("g IS NOT NULL"), ["g"], {"roles": "e", "kinds": "source_kind", "conditions": "c", "divs": "v"})


_register(
    "group_allocation", group_allocation,
    f"WITH x AS (SELECT {Q.key('biological_group_candidate')} AS g, {Q.role('eligibility')} AS e, source_kind AS k, upper({Q.key('inferred_condition')}) AS c, {Q.key('inferred_div')} AS v FROM sted_splits) "
    "SELECT g, count(*) AS n_rows, " + ", ".join(f"coalesce(array_to_string(list_sort(list(DISTINCT {c}) FILTER ({c} IS NOT NULL)), ';'), '') AS {n}" for c, n in (("e", "roles"), ("k", "kinds"), ("c", "conditions"), ("v", "divs"))) + " FROM x WHERE g IS NOT NULL GROUP BY g",
)


def claim_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that name papers without evidence, and questions and hypotheses that are missing or not wanted."""
    claims = table(spark, sf_dir, "synthesis_claims").select("claim_id", "section", "question_number", "hypothesis_id", "supporting_papers", "limiting_papers")
    papers = table(spark, sf_dir, "evidence_items").select("cite_key").where("cite_key IS NOT NULL")
    return literature.claim_violations(claims, papers)


_register(
    "claim_rules", claim_rules,
    "WITH n AS (SELECT claim_id, unnest(list_concat(coalesce(supporting_papers, []), coalesce(limiting_papers, []))) AS k FROM synthesis_claims), w AS (SELECT 'question' AS section, CAST(i AS VARCHAR) AS v FROM range(1, 11) t(i) UNION ALL SELECT 'hypothesis', 'H' || i FROM range(1, 8) t(i)), "
    "h AS (SELECT DISTINCT section, CASE WHEN section = 'question' THEN CAST(question_number AS VARCHAR) ELSE hypothesis_id END AS v FROM synthesis_claims WHERE section IN ('question', 'hypothesis')) "
    "SELECT 'unknown_paper' AS rule, claim_id AS entity, 'unknown paper ' || k AS message FROM n WHERE k IS NULL OR k NOT IN (SELECT cite_key FROM evidence_items WHERE cite_key IS NOT NULL) "
    "UNION ALL SELECT 'claim_set', section || ' ' || v, 'missing' FROM w WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.section = w.section AND h.v = w.v) "
    "UNION ALL SELECT 'claim_set', section || ' ' || coalesce(v, 'null'), 'unexpected' FROM h WHERE NOT EXISTS (SELECT 1 FROM w WHERE h.section = w.section AND h.v = w.v)",
)


def corpus_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rules over a corpus made from the evidence: a paper per cite key, of which some lack the role, the file or its hash."""
    keys = table(spark, sf_dir, "evidence_items").select("cite_key").where("cite_key IS NOT NULL").distinct()
    h = F.length("cite_key") + F.ascii("cite_key")
    types = {f.split()[0]: f.split()[1] for f in literature.MANIFEST.split(", ")}
    own = {"cite_key": F.col("cite_key"), "filename": F.concat("cite_key", F.lit(".pdf")), "sha256": F.sha2("cite_key", 256), "pages": F.lit(9), "corpus_role": F.when(h % 3 == 0, "extra").otherwise("core")}
    manifest = keys.select([own.get(c, F.lit(None)).cast(k).alias(c) for c, k in types.items()])
    pdfs = checkpointed(manifest.where(h % 4 != 0).select("filename", F.when(h % 5 == 0, "0").otherwise(F.col("sha256")).alias("sha256"), F.when(h % 7 == 0, 8).otherwise(9).alias("pages")))
    return literature.manifest_violations(manifest, "1.0.0", pdfs)


_register(
    "corpus_rules", corpus_rules,
    "WITH k AS (SELECT DISTINCT cite_key AS c, length(cite_key) + ascii(cite_key) AS h FROM evidence_items WHERE cite_key IS NOT NULL) SELECT 'schema_version' AS rule, 'manifest' AS entity, 'schema version must be 1.2.0' AS message "
    "UNION ALL SELECT 'paper_count', 'manifest', '8 core papers are needed, not ' || count(*) FROM k HAVING count(*) <> 8 UNION ALL SELECT 'corpus_role', c, 'corpus role must be core' FROM k WHERE h % 3 = 0 UNION ALL SELECT 'pdf_files', c || '.pdf', 'listed PDF is missing' FROM k WHERE h % 4 = 0 "
    "UNION ALL SELECT 'pdf_checksum', c, 'checksum of the PDF differs' FROM k WHERE h % 4 <> 0 AND h % 5 = 0 UNION ALL SELECT 'pdf_pages', c, '9 pages are listed, the PDF has 8' FROM k WHERE h % 4 <> 0 AND h % 7 = 0",
)

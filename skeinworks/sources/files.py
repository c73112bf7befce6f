"""Readers: image folders, CSV, JSON lines, JSON and YAML documents, NPZ samples."""

from __future__ import annotations

import io
import shutil
import subprocess
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .png import MAGIC, read_png
from .tiff import read_pages

IMAGE_SCHEMA = "source_root_id string, relative_path string, source_kind string, source_sha256 string, height int, width int, channels int, frames int, dtype string, pixels binary, error string"


def qualified(spark: SparkSession, path: str | Path) -> str:
    """The full form of a path of any file system that the cluster knows, as file listings give it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def scan_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``relative_path, length, content`` of all regular files under ``root``, at any depth.

    Parts of big folders are read in parallel and only the wanted columns are
    read: without ``content`` no file is opened. ``path_order`` sorts by path
    component, as ``a/b`` comes before ``a.b``.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = qualified(spark, root)
    rel = F.expr(f"substring(path, {len(base) + 2})")
    filled = reader.load(base).select("path", "length", "content")
    # the reader lists empty files but gives no row for them: where there are some, they are what the listing has besides
    listed, rows = filled._jdf.inputFiles(), filled
    if len(listed) > filled.select("path").count():
        names = spark._jvm.org.apache.hadoop.util.StringUtils.join("\n", listed).split("\n")
        name = F.regexp_replace(F.url_decode(F.replace(F.col("value"), F.lit("+"), F.lit("%2B"))), "^([a-z][a-z0-9+.-]*):///", "$1:/")
        empty = spark.createDataFrame(pd.DataFrame({"value": names})).select(name.alias("path")).join(filled.select("path"), "path", "left_anti")
        rows = filled.unionByName(empty.select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))
    return rows.select(rel.alias("relative_path"), "length", "content").withColumn("path_order", F.split("relative_path", "/"))


def decode_images(files: DataFrame, root_id: str, source_kind: str) -> DataFrame:
    """First frame of every file as a row of ``IMAGE_SCHEMA``; a file that can't be read keeps its row.

    TIFF or PNG, told apart by their first bytes. One decode per file in Arrow
    batches; ``error`` names the kind of failure
    and the image columns are then null.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, sha, content in zip(b["relative_path"], b["sha"], b["content"]):
                head = (root_id, path, source_kind, sha)
                try:
                    pages = [read_png(content)] if content.startswith(MAGIC) else read_pages(bytes(content))
                    a = pages[0]
                    rows.append((*head, a.shape[0], a.shape[1], 1 if a.ndim == 2 else a.shape[2], len(pages), a.dtype.name, np.ascontiguousarray(a).tobytes(), None))
                except Exception as e:  # noqa: BLE001 - every failure becomes a row
                    rows.append((*head, None, None, None, None, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in IMAGE_SCHEMA.split(", ")])

    return files.select("relative_path", F.sha2("content", 256).alias("sha"), "content").mapInPandas(run, IMAGE_SCHEMA)


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV manifest with header; all cells are strings, quotes are doubled, cells may hold line ends."""
    reader = spark.read.option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true").option("nullValue", "\0")
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    df = reader.csv(path)
    return df.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def read_inventory(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The image and the blank manifest of an inventory folder."""
    return read_csv(spark, f"{folder}/sted_images.csv"), read_csv(spark, f"{folder}/sted_blanks.csv")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed line fails. Without a schema one ``value`` VARIANT per line."""
    if schema is not None:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.parse_json("value").alias("value"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one or more lines each."""
    return spark.read.option("multiLine", "true").option("mode", "FAILFAST").json(path)


def load_yaml(path: str | Path) -> dict:
    """A YAML mapping; empty files give an empty one, other top levels a ValueError."""
    import yaml

    with Path(path).open(encoding="utf-8") as f:
        data = yaml.safe_load(f)
    if data is None:
        return {}
    if not isinstance(data, dict):
        raise ValueError(f"{path}: the top level must be a mapping")
    return data


def required(config: dict, key: str):
    """A configuration value that must be there."""
    if key not in config:
        raise ValueError(f"missing configuration key: {key}")
    return config[key]


def yaml_records(spark: SparkSession, path: str | Path, key: str, schema: str) -> DataFrame:
    """The list under ``key`` of a YAML document as rows, with their ``position``."""
    rows = load_yaml(path).get(key) or []
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    return spark.createDataFrame([(*[r.get(n) for n in names], i) for i, r in enumerate(rows)], f"{schema}, position int")


def read_npz(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``relative_path, name, dtype, shape, data`` for the arrays of NPZ files, pickles refused; ``names`` loads only some."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["relative_path"], b["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as npz:
                    for n in npz.files:
                        if names is None or n in names:
                            a = npz[n]
                            rows.append((path, n, a.dtype.str, list(a.shape), np.ascontiguousarray(a).tobytes()))
            yield pd.DataFrame(rows, columns=["relative_path", "name", "dtype", "shape", "data"])

    return files.select("relative_path", "content").mapInPandas(run, "relative_path string, name string, dtype string, shape array<int>, data binary")


def resolve_paths(rows: DataFrame, roots: dict[str, str]) -> DataFrame:
    """Add ``source_path``: the folder of ``source_root_id`` and ``relative_path``; null for an unknown root."""
    table = rows.sparkSession.createDataFrame(list(roots.items()), "source_root_id string, __root string")  # as many rows as configured roots
    return rows.join(F.broadcast(table), "source_root_id", "left").withColumn("source_path", F.when(F.col("__root").isNotNull(), F.concat_ws("/", F.rtrim(F.col("__root")), "relative_path"))).drop("__root")


def file_names(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """Names of the files in a folder that match a pattern, without opening them."""
    return scan_files(spark, root, glob).select(F.element_at("path_order", -1).alias("name"))


def pdf_pages(path: str) -> int | None:
    """Page count by ``pdfinfo``; None where the tool or the count is missing."""
    if not shutil.which("pdfinfo"):
        return None
    said = subprocess.run(["pdfinfo", path], capture_output=True, text=True, check=False).stdout
    found = [line.split(":")[1].strip() for line in said.splitlines() if line.startswith("Pages:")]
    return int(found[0]) if found and found[0].isdigit() else None


def code_version(folder: str = ".") -> str:
    """Short commit, with ``+dirty`` for uncommitted changes, or ``not_available``."""
    git = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, check=True).stdout.strip()
    try:
        return git("rev-parse", "--short", "HEAD") + ("+dirty" if git("status", "--porcelain") else "")
    except (OSError, subprocess.CalledProcessError):
        return "not_available"


def sample_range(spark: SparkSession, count: int, least: int = 8, most: int = 16) -> DataFrame:
    """``sample_index`` from 0 up, for a count within the configured bounds."""
    if not least <= count <= most:
        raise ValueError(f"sample count must be {least} to {most}, not {count}")
    return spark.range(count).select(F.col("id").cast("int").alias("sample_index"))

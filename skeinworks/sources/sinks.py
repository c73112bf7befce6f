"""Writers: CSV, canonical JSON, NPZ, PNG, Markdown, and write-or-check."""

from __future__ import annotations

import csv
import io
import json
import re
import struct
import zlib
from collections.abc import Iterable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Project to the declared columns as strings; missing ones and nulls become empty text."""
    have = set(df.columns)
    return df.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A folder of CSV parts written by the executors, each with header."""
    csv_columns(df, columns).write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)


def write_csv_file(df: DataFrame, path: str | Path, columns: list[str]) -> None:
    """One named CSV file, streamed row by row through the driver; for reports and manifests."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with Path(path).open("w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(columns)
        for row in csv_columns(df, columns).toLocalIterator():
            out.writerow(row)


def write_records(rows: list[dict], path: str | Path, empty: str = "raise") -> None:
    """CSV whose header are the first record's keys; no records raise, or write nothing with ``empty='skip'``."""
    if not rows:
        if empty == "skip":
            return
        raise ValueError(f"{path}: no rows to write")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with Path(path).open("w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, fieldnames=list(rows[0]))
        out.writeheader()
        out.writerows(rows)


def canonical_json(data) -> str:
    """Sorted keys, two spaces, one line end at the end."""
    return json.dumps(data, indent=2, sort_keys=True) + "\n"


def write_json(data, path: str | Path) -> None:
    """Canonical JSON into a file, folders made."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(canonical_json(data), encoding="utf-8")


def npz_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """Compressed NPZ with fixed time stamps, so equal arrays give equal bytes; object arrays are refused."""
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(arrays):
            if arrays[name].dtype == object:
                raise ValueError(f"{name}: object arrays are prohibited")
            part = io.BytesIO()
            np.lib.format.write_array(part, np.ascontiguousarray(arrays[name]), allow_pickle=False)
            z.writestr(zipfile.ZipInfo(f"{name}.npy", (1980, 1, 1, 0, 0, 0)), part.getvalue(), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def put_bytes(folder: str, name: str, data: bytes) -> None:
    """Write one file from any process, to a local path or to the file system that the folder's scheme names."""
    from pyarrow import fs

    to, base = fs.FileSystem.from_uri(folder) if re.match(r"^[a-z][a-z0-9+.-]*:", folder) else (fs.LocalFileSystem(), folder)
    to.create_dir(base, recursive=True)
    with to.open_output_stream(f"{base.rstrip('/')}/{name}") as f:
        f.write(data)


def png_bytes(image: np.ndarray) -> bytes:
    """An 8-bit grey or RGB image as PNG."""
    a = np.ascontiguousarray(image, np.uint8)
    rows = a.reshape(a.shape[0], -1)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0 if a.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def bars_png(series: dict[str, list[float]], height: int = 240, colours: Iterable[tuple[int, int, int]] = ((0, 90, 220), (220, 90, 0), (60, 160, 60), (160, 60, 160))) -> bytes:
    """Bars of sorted values, one block per series, scaled to the greatest value of each."""
    blocks = []
    for (_, values), colour in zip(sorted(series.items()), list(colours) * len(series)):
        block = np.full((height + 20, max(1, len(values)) * 3 + 10, 3), 255, np.uint8)
        top = max([*values, 0]) or 1.0
        for i, v in enumerate(sorted(values)):
            block[10 + height - max(0, int(height * v / top)) : 10 + height, 5 + 3 * i : 7 + 3 * i] = colour
        blocks.append(block)
    return png_bytes(np.concatenate(blocks, axis=1) if blocks else np.full((height, 10, 3), 255, np.uint8))


def markdown_table(header: list[str], rows: Iterable[Iterable], right: Iterable[int] = ()) -> list[str]:
    """Lines of a Markdown table; columns in ``right`` are aligned right."""
    right = set(right)
    marks = ["--:" if i in right else ":--" for i in range(len(header))]
    return ["| " + " | ".join(header) + " |", "|" + "|".join(marks) + "|", *("| " + " | ".join(str(x) for x in r) + " |" for r in rows)]


def write_or_check(outputs: dict[str | Path, str], check: bool = False) -> list[str]:
    """Write the texts, or with ``check`` name the files whose text differs or is missing."""
    stale = []
    for path, text in outputs.items():
        p = Path(path)
        if check:
            if not p.exists() or p.read_text(encoding="utf-8") != text:
                stale.append(str(path))
        else:
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(text, encoding="utf-8", newline="\n")
    return stale

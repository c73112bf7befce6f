"""Column functions for file names, identifiers, hashes and number texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pattern of an acquisition file name, and of its first part.
NAME_PATTERN = r"(?i)^(.+?) \(Series (\d+)\) \[(\d+)\]\.tif$"
SAMPLE_PATTERN = r"(?i)^PN\d+$"


def file_name(path: Column) -> Column:
    """Last component of a path."""
    return F.element_at(F.split(path, "/"), -1)


def name_parts(path: Column, pattern: str = NAME_PATTERN, sample: str = SAMPLE_PATTERN) -> Column:
    """A struct of what a file name says: prefix, sample, round, condition, day, series, bracket, groups, status.

    The prefix is split at ``_``; missing parts and an unlikely sample are
    ``unknown``. A name of another form has its stem as acquisition group.
    """
    name = file_name(path)
    prefix = F.regexp_extract(name, pattern, 1)
    ok = name.rlike(pattern)
    unknown = F.lit("unknown")
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    part = lambda i: F.when(ok, F.coalesce(F.get(F.split(prefix, "_"), i), unknown)).otherwise(unknown)
    pn = F.when(ok & F.get(F.split(prefix, "_"), 0).rlike(sample), F.get(F.split(prefix, "_"), 0)).otherwise(unknown)
    return F.struct(
        F.when(ok, prefix).otherwise(stem).alias("prefix"), pn.alias("inferred_pn"), part(1).alias("inferred_round"), part(2).alias("inferred_condition"), part(3).alias("inferred_div"),
        F.when(ok, F.regexp_extract(name, pattern, 2)).otherwise(unknown).alias("series_index"), F.when(ok, F.regexp_extract(name, pattern, 3)).otherwise(unknown).alias("bracket_index"),
        F.when(ok, prefix).otherwise(stem).alias("acquisition_group"), pn.alias("biological_group_candidate"), F.when(ok, "parsed").otherwise("unparsed").alias("parse_status"),
    )


def stable_id(*parts: Column, prefix: str = "img_", digits: int = 20) -> Column:
    """Prefix and the first digits of the SHA-256 of the parts joined by colons."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, digits))


def pixel_hash(height: Column, width: Column, dtype: Column, pixels: Column) -> Column:
    """Pixel hash of a 2-D image without leaving the JVM; equal to ``kernels.pixel_hash``."""
    return F.sha2(F.concat(F.encode(F.format_string("(%d, %d)", height, width), "UTF-8"), F.encode(dtype, "UTF-8"), pixels), 256)


def channels(ndim: Column, last: Column) -> Column:
    """Channel count: the last dimension of a 3-D image, else one."""
    return F.when(ndim == 3, last).otherwise(F.lit(1))


def number_text(c: Column, digits: int = 6, whole: bool = False) -> Column:
    """``%.{digits}g`` text of a double; ``whole`` prints near-integers in full. Null stays null.

    Java's ``%g`` keeps trailing zeros, so an Arrow UDF formats; use it in the
    projection of a sink only.
    """
    @F.pandas_udf("string")
    def run(v: pd.Series) -> pd.Series:
        def one(x):
            if pd.isna(x):
                return None
            n = round(x) if abs(x) < 1e300 else 0
            if whole and abs(x - n) <= max(1e-9, 1e-9 * max(abs(x), abs(n))):
                return str(int(n))
            return f"{x:.{digits}g}"

        return v.map(one)

    return run(c.cast("double"))


def joined_values(c: Column | str, separator: str = ";") -> Column:
    """Aggregate: the sorted distinct values of a column in one text."""
    return F.array_join(F.array_sort(F.collect_set(c)), separator)

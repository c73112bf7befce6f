"""Clean forms of dirty keys as column expressions.

Two values that differ only in case, white space, separators, zero padding, a
known prefix or a shortened word are one value; words for "not known" are
null. All of it stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for "not known", after ``key``.
NOT_KNOWN = [
    "unknown", "not_known", "none", "null", "nan", "na", "n_a", "nil", "not_recorded", "not_applicable", "not_available",
    "not_readable", "not_reported", "not_assigned", "unassigned", "undefined", "missing",
]

#: Split roles and their shortened words, without separators.
ROLES = {
    "training": ["training", "train"],
    "validation": ["validation", "valid", "val"],
    "held_out_test": ["heldouttest", "heldout", "test", "testing"],
    "calibration": ["calibration", "calib", "cal"],
}

#: Where a key has ``_``: before padded digits at the start, at other characters, between letters and digits; zeros after it go.
_JOINT = r"(?:^(?=0+\p{Nd})|[^\p{L}\p{N}]+|(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L}))(?:0+(?=\p{Nd}))?"
_EDGE = r"^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without outer white space of any kind, tabs and line ends included."""
    return F.regexp_replace(_col(c), _EDGE, "")


def known(c: Column) -> Column:
    """Null for empty text and for words that mean "not known"."""
    return F.when((c != "") & ~c.isin(NOT_KNOWN), c)


def key(c: Column | str) -> Column:
    """The comparison key: lower case, runs of letters and digits joined by ``_``, no zero padding.

    ``PN 0207``, ``pn-207`` and ``PN207`` all give ``pn_207``; null for "not known".
    """
    return known(F.btrim(F.regexp_replace(F.lower(_col(c)), _JOINT, "_"), F.lit("_")))


def image_id(c: Column | str) -> Column:
    """``img_`` and 20 lower-case hex digits; any other text only trimmed and in lower case."""
    x = F.lower(trimmed(c))
    hexes = F.regexp_extract(x, r"^(?:img)?[^0-9a-z]*([0-9a-f]{20})$", 1)
    slow = F.when(hexes != "", F.concat(F.lit("img_"), hexes)).otherwise(known(x))
    return F.when(_col(c).rlike("^img_[0-9a-f]{20}$"), _col(c)).otherwise(slow)  # most ids are clean


def sha256(c: Column | str) -> Column:
    """64 lower-case hex digits without a ``sha256:`` or ``SHA256=`` prefix."""
    x = F.lower(trimmed(c))
    return F.when(_col(c).rlike("^[0-9a-f]{64}$"), _col(c)).otherwise(known(F.regexp_replace(x, r"^sha[-_ ]?256\s*[:=]?\s*", "")))


def role(c: Column | str) -> Column:
    """One of the four split roles, null for an unassigned one; other words keep their key."""
    raw = _col(c)
    bare = F.regexp_replace(F.lower(raw), r"[^\p{L}\p{N}]+", "")
    named = F.create_map(*[F.lit(x) for name, words in ROLES.items() for w in words for x in (w, name)])
    # most are spelt clean; one lookup for the others keeps the generated method small enough for the JIT compiler
    return F.when(raw.isin(*ROLES), raw).when(~raw.isin(*NOT_KNOWN), F.coalesce(named[bare], key(raw)))


def condition(c: Column | str) -> Column:
    """Clean form of a condition: ``AD``."""
    raw = _col(c)
    return F.when(raw.rlike("^[A-Z]{2,}$") & ~F.lower(raw).isin(NOT_KNOWN), raw).otherwise(F.upper(key(c)))


def div(c: Column | str) -> Column:
    """Clean form of a day in vitro: ``DIV07``."""
    k = key(c)
    digits = F.regexp_extract(k, r"^div_(\d+)$", 1)
    padded = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    slow = F.when(digits != "", F.concat(F.lit("DIV"), padded)).otherwise(F.upper(k))
    return F.when(_col(c).rlike("^DIV(0[1-9]|[1-9][0-9]+)$"), _col(c)).otherwise(slow)


def word(c: Column | str) -> Column:
    """Clean form of a lower-case word with ``_`` between its parts, as sources and subjects have."""
    return key(c)


def path(c: Column | str) -> Column:
    """A path from the root with ``/`` only, without ``.``, empty parts and resolvable ``..``."""
    parts = F.split(F.regexp_replace(trimmed(c), r"\\", "/"), "/")
    step = lambda acc, x: (
        F.when(x.isin("", "."), acc)
        .when((x == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(x)))
    )
    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(joined != "", joined)


def unit_hash(c: Column | str, seed: int = 0) -> Column:
    """A double in [0, 1) that depends only on the value and the seed."""
    return F.shiftrightunsigned(F.xxhash64(_col(c), F.lit(seed)), 11) * F.lit(2.0**-53)

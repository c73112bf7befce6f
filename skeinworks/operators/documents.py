"""Nested JSON records: tree walk, schema check, flattening and evidence links."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: JSON type names and their Python classes.
_CLASSES = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}


def json_nodes(value, path: str = "$") -> Iterator[tuple[str, object]]:
    """Every node of a JSON value with its path, parents first."""
    stack = [(path, value)]
    while stack:
        at, node = stack.pop()
        yield at, node
        below = [(f"{at}.{k}", v) for k, v in node.items()] if isinstance(node, dict) else [(f"{at}[{i}]", v) for i, v in enumerate(node)] if isinstance(node, list) else []
        stack += reversed(below)


def _of_type(value, kind: str) -> bool:
    return isinstance(value, _CLASSES[kind]) and (kind == "boolean" or not isinstance(value, bool))


def _repeats(value: list) -> bool:
    return len({json.dumps(x, sort_keys=True) for x in value}) < len(value)


class Keyword(NamedTuple):
    """A keyword of a schema: the kind of values it applies to, when a value breaks it, and what is then said."""

    kind: str | None
    broken: Callable[[object, object], bool]
    said: str


#: What each keyword means for a value ``v`` and the keyword's own value ``k``.
KEYWORDS = {
    "const": Keyword(None, lambda v, k: v != k, "is not the constant {k!r}"),
    "enum": Keyword(None, lambda v, k: v not in k, "{v!r} is not among the allowed values"),
    "minItems": Keyword("array", lambda v, k: len(v) < k, "has fewer than {k} items"),
    "uniqueItems": Keyword("array", lambda v, k: bool(k) and _repeats(v), "repeats an item"),
    "minLength": Keyword("string", lambda v, k: len(v) < k, "is shorter than {k}"),
    "pattern": Keyword("string", lambda v, k: not re.search(k, v), "does not follow {k}"),
    "minimum": Keyword("number", lambda v, k: v < k, "is below {k}"),
    "maximum": Keyword("number", lambda v, k: v > k, "is above {k}"),
}


class Schema:
    """The JSON-Schema subset of the record files."""

    def __init__(self, document: dict):
        self.document = document

    has_type = staticmethod(_of_type)

    def target(self, ref: str) -> dict:
        """The part of the document that a reference names."""
        steps = [x.replace("~1", "/").replace("~0", "~") for x in ref.lstrip("#").split("/") if x]
        return reduce(lambda node, step: node[step], steps, self.document)

    def problems(self, value, schema: dict | None = None, path: str = "$") -> Iterator[tuple[str, str]]:
        """(path, message) of all violations; a reference or a choice stands for its whole schema."""
        todo = [(path, value, self.document if schema is None else schema)]
        while todo:
            at, v, s = todo.pop()
            while "$ref" in s:
                s = self.target(s["$ref"])
            if "oneOf" in s:
                fitting = [x for x in s["oneOf"] if next(self.problems(v, x, at), None) is None]
                if len(fitting) != 1:
                    yield at, f"fits {len(fitting)} of the shapes instead of one"
                continue
            kinds = [s["type"]] if isinstance(s.get("type"), str) else s.get("type", [])
            right = not kinds or any(_of_type(v, k) for k in kinds)
            for name, k in s.items():
                rule = KEYWORDS.get(name)
                if rule and (rule.kind is None or right and _of_type(v, rule.kind)) and rule.broken(v, k):
                    yield at, rule.said.format(v=v, k=k)
            if not right:
                yield at, f"is no {' or '.join(kinds)}"
                continue
            if isinstance(v, dict):
                yield from ((at, f"lacks {name!r}") for name in s.get("required", []) if name not in v)
                inner = {name: s.get("properties", {}).get(name, s.get("additionalProperties", True)) for name in v}
                yield from ((at, f"has the unknown field {name!r}") for name, x in inner.items() if x is False)
                todo += [(f"{at}.{name}", v[name], x) for name, x in reversed(inner.items()) if isinstance(x, dict)]
            elif isinstance(v, list) and "items" in s:
                todo += [(f"{at}[{i}]", v[i], s["items"]) for i in reversed(range(len(v)))]


def schema_violations(rows: DataFrame, key: str, text: str, schema: dict, at: str | None = None) -> DataFrame:
    """``key, path, message`` of every schema violation of a JSON text column; bad JSON is a violation of ``$``.

    One Arrow pass; the schema goes along with the function. ``at`` names a
    reference inside the schema document.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        checker = Schema(schema)
        start = checker.target(at) if at else schema
        for b in batches:
            out = []
            for k, t in zip(b[key], b[text]):
                try:
                    value = json.loads(t) if t is not None else None
                except ValueError:
                    out.append((k, "$", "not a JSON text"))
                    continue
                out += [(k, p, m) for p, m in checker.problems(value, start)]
            yield pd.DataFrame(out, columns=[key, "path", "message"])

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, path string, message string")


def tree_nodes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, path, kind, value`` of every node of JSON texts; ``value`` is text for leaves, null for others and nulls."""
    kind = rows.schema[key].dataType.simpleString()

    def leaf(v):
        return v if isinstance(v, str) else json.dumps(v) if isinstance(v, (bool, int, float)) else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, p, next(n for n, c in _CLASSES.items() if Schema.has_type(v, n)), leaf(v)) for k, t in zip(b[key], b[text]) if t is not None for p, v in json_nodes(json.loads(t))]
            yield pd.DataFrame(out, columns=[key, "path", "kind", "value"])

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, path string, kind string, value string")


def flattened(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns from nested fields (``name: path``); arrays are joined by ``;``."""
    def one(path: str):
        parent, _, leaf = path.rpartition(".")
        kind = rows.select(F.col(path).alias("x")).schema["x"].dataType.typeName()
        return F.array_join(F.col(path).cast("array<string>"), ";") if kind == "array" else F.col(path).cast("string")

    return rows.select([one(p).alias(n) for n, p in columns.items()])


def projected(rows: DataFrame, text: str, columns: dict[str, str]) -> DataFrame:
    """Text cells from the fields of a JSON text column (``name: path``); arrays are joined by ``;``, absent fields are empty."""
    def one(path: str):
        raw = F.get_json_object(text, f"$.{path}")
        return F.coalesce(F.when(raw.startswith("["), F.array_join(F.from_json(raw, "array<string>"), ";")).otherwise(raw), F.lit(""))

    return rows.select([one(p).alias(n) for n, p in columns.items()])


def linked_evidence(rows: DataFrame, key: str, links: str) -> DataFrame:
    """``key, evidence, owner`` of every distinct link; the owner stands before ``-E``."""
    return rows.select(key, F.explode(F.array_distinct(links)).alias("evidence")).withColumn("owner", F.regexp_extract("evidence", r"^(.*)-E\d+$", 1))


def foreign_evidence(rows: DataFrame, key: str, links: str, papers: str) -> DataFrame:
    """Links whose owner is not among the row's own papers."""
    own = rows.select(key, papers, F.explode(F.array_distinct(links)).alias("evidence")).withColumn("owner", F.regexp_extract("evidence", r"^(.*)-E\d+$", 1))
    return own.where((F.col("owner") != "") & ~F.coalesce(F.array_contains(F.col(papers), F.col("owner")), F.lit(False))).select(key, "evidence", "owner")


def claim_blocks(claims: DataFrame) -> DataFrame:
    """``claim_id, section, block``: a Markdown block per claim, ``None`` for empty lists."""
    ticks = lambda c: F.when(F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0, F.array_join(F.transform(c, lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")).otherwise("None")
    bold = lambda title, text: F.concat(F.lit(f"**{title}:** "), text)
    code = lambda c: F.concat(F.lit("`"), F.col(c), F.lit("`"))
    lines = [
        F.concat(F.lit("### "), "claim_id", F.lit(": "), "title"), bold("Claim", F.col("claim")), bold("Evidence class", code("claim_class")), bold("Supporting papers", ticks("supporting_papers")),
        bold("Supporting evidence", ticks("supporting_evidence_ids")), bold("Contradicting or limiting papers", ticks("limiting_papers")), bold("Limiting evidence", ticks("limiting_evidence_ids")),
        bold("Confidence", code("confidence")), bold("Hypothesis status", code("hypothesis_status")), bold("Implication for the STED project", F.col("sted_implication")),
    ]
    return claims.select("claim_id", "section", F.concat_ws("\n\n", *lines).alias("block"))

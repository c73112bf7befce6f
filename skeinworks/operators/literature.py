"""Validation of a literature corpus: manifest, PDFs, cards, claims and what is derived from them.

Every check yields rows ``rule, entity, message``; together they pass when
there are none. Cards and claims are JSON texts, so a check reads only the
paths it needs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import documents, roles, rules, selection

#: Version, size and role of the corpus, and what a review must cover.
SCHEMA_VERSION, CORE_PAPERS, CORE_ROLE = "1.2.0", 8, "core"
REVIEW_SCOPE = ["methods", "figures", "tables", "results", "appendices_or_supplements", "limitations"]
REVIEWED = ["reviewed", "verified"]
#: Bibliography fields that a card shares with the manifest; texts that say nothing specific.
BIBLIOGRAPHY = ["title", "publication_year", "doi", "corpus_role", "study_type", "method_paradigms", "publication_status"]
UNSPECIFIC = ["", "other", "not_reported"]
#: Questions and hypotheses that the claims must cover.
QUESTIONS, HYPOTHESES = 10, 7

MANIFEST = "cite_key string, filename string, sha256 string, pages int, title string, publication_year int, doi string, corpus_role string, study_type string, method_paradigms array<string>, publication_status string"

_v = rules.violations


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def manifest_violations(manifest: DataFrame, version: str, pdfs: DataFrame | None = None, papers: int = CORE_PAPERS) -> DataFrame:
    """Violations of a manifest (``MANIFEST``); ``pdfs`` (``filename, sha256`` and maybe ``pages``) are the files that lie beside it.

    A null page count of a PDF is not compared, as its tool may be missing.
    """
    size = manifest.agg(F.count(F.lit(1)).alias("n"))
    parts = [
        _v(size.where(F.lit(version) != SCHEMA_VERSION), "schema_version", F.lit("manifest"), f"schema version must be {SCHEMA_VERSION}"),
        _v(size.where(F.col("n") != papers), "paper_count", F.lit("manifest"), F.format_string(f"{papers} core papers are needed, not %d", "n")),
        rules.unique("duplicate_paper", "papers", "cite_key")({"papers": manifest}),
        _v(manifest.where(~F.col("corpus_role").eqNullSafe(CORE_ROLE)), "corpus_role", "cite_key", f"corpus role must be {CORE_ROLE}"),
    ]
    if pdfs is not None:
        seen = pdfs.select("filename", F.col("sha256").alias("own_sha256"), (F.col("pages") if "pages" in pdfs.columns else F.lit(None)).cast("int").alias("own_pages"))
        both = manifest.join(seen, "filename")
        parts += [
            _v(roles.unmatched(manifest.select("filename").distinct(), pdfs.select("filename").distinct(), "filename"), "pdf_files", "filename", F.when(F.col("side") == "left", "listed PDF is missing").otherwise("PDF isn't listed")),
            _v(both.where(~F.col("sha256").eqNullSafe(F.col("own_sha256"))), "pdf_checksum", "cite_key", "checksum of the PDF differs"),
            _v(both.where(F.col("pages") != F.col("own_pages")), "pdf_pages", "cite_key", F.format_string("%d pages are listed, the PDF has %d", "pages", "own_pages")),
        ]
    return _union(parts)


def _field(path: str) -> Column:
    return F.get_json_object("text", f"$.{path}")


def card_violations(cards: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rules between cards (``cite_key, text``) and manifest (``MANIFEST``) beyond those of ``pipelines.validate_records``."""
    nodes = checkpointed(documents.tree_nodes(cards, "cite_key", "text"))
    above = F.regexp_replace("path", r"[.]normalized$", "")
    other = nodes.where(F.col("path").endswith(".normalized") & (F.col("value") == "other")).select("cite_key", above.alias("at"))
    raw = nodes.where(F.col("path").endswith(".raw_value")).select("cite_key", F.regexp_replace("path", r"[.]raw_value$", "").alias("at"), F.col("value").alias("raw"))
    vague = other.join(raw, ["cite_key", "at"], "left").where(F.col("raw").isNull() | F.col("raw").isin(UNSPECIFIC))

    paired = checkpointed(cards.join(manifest, "cite_key"))
    kinds = {f.split()[0]: f.split()[1] for f in MANIFEST.split(", ")}
    given = F.from_json(_field("bibliography"), ", ".join(f"{c} {kinds[c]}" for c in BIBLIOGRAPHY))
    differs = ~given.eqNullSafe(F.struct(*BIBLIOGRAPHY)) | ~F.array_sort(F.json_object_keys(_field("bibliography"))).eqNullSafe(F.array(*[F.lit(c) for c in sorted(BIBLIOGRAPHY)]))
    done = F.coalesce(_field("provenance.extraction_status").isin(REVIEWED), F.lit(False))
    scope = F.coalesce(F.from_json(_field("provenance.review_scope"), "array<string>"), F.array().cast("array<string>"))
    whole = F.array_sort(F.array_distinct(scope)) == F.array(*[F.lit(c) for c in sorted(REVIEW_SCOPE)])
    lacks = lambda c: F.coalesce(c, F.lit("")) == ""
    review = paired.where("study_type = 'review'").select("cite_key").distinct()
    own = nodes.where("path LIKE '$.paper_findings.%' AND path LIKE '%.claim_class' AND value = 'reported_result'").join(review, "cite_key")
    return _union([
        _v(vague, "vague_other", "cite_key", F.concat(F.lit("no specific raw value at "), "at")),
        _v(paired.where(differs), "bibliography", "cite_key", "bibliography differs from the manifest"),
        _v(paired.where(~_field("provenance.source_pdf").eqNullSafe(F.col("filename"))), "source_pdf", "cite_key", "source PDF differs from the manifest"),
        _v(paired.where(~_field("provenance.source_sha256").eqNullSafe(F.col("sha256"))), "source_sha256", "cite_key", "source hash differs from the manifest"),
        _v(paired.where(~_field("provenance.extracted_on").eqNullSafe("not_recorded")), "extraction_date", "cite_key", "the extraction date must be not_recorded"),
        _v(paired.where(done & ~F.coalesce(_field("provenance.reviewed_on").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))), "review_date", "cite_key", "a reviewed card needs an ISO date"),
        _v(paired.where(done & lacks(_field("provenance.reviewer"))), "reviewer", "cite_key", "a reviewed card needs a reviewer"),
        _v(paired.where(done & ~whole), "review_scope", "cite_key", "a reviewed card needs the whole scope"),
        _v(own, "review_result", "cite_key", F.concat(F.lit("a review reports no result of its own: "), "path")),
    ])


def claim_violations(claims: DataFrame, manifest: DataFrame) -> DataFrame:
    """Unknown papers of claims, and the questions and hypotheses that are missing or not wanted.

    claims: ``claim_id, section, question_number, hypothesis_id`` and the arrays of papers.
    """
    spark = claims.sparkSession
    named = claims.select("claim_id", F.explode(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("supporting_papers", "limiting_papers")])).alias("cite_key"))
    unknown = named.join(manifest.select("cite_key").distinct(), "cite_key", "left_anti")
    have = claims.where("section IN ('question', 'hypothesis')").select("section", F.when(F.col("section") == "question", F.col("question_number").cast("string")).otherwise(F.col("hypothesis_id")).alias("value"))
    want = spark.createDataFrame([("question", str(i + 1)) for i in range(QUESTIONS)] + [("hypothesis", f"H{i + 1}") for i in range(HYPOTHESES)], "section string, value string")
    gaps = selection.complete_set(have, "section", "value", want)
    return _union([
        _v(unknown, "unknown_paper", "claim_id", F.concat(F.lit("unknown paper "), "cite_key")),
        _v(gaps, "claim_set", F.concat_ws(" ", "section", F.coalesce("value", F.lit("null"))), F.col("problem")),
    ])


def table_drift(expected: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows in which a stored table isn't the exact projection of its source, compared by key and cell."""
    return rules.same_on_both("table_drift", "source", "table", key, [c for c in columns if c != key])({"source": expected, "table": stored})


def unreviewed(cards: DataFrame) -> DataFrame:
    """``cite_key, extraction_status`` of the cards that nobody has reviewed, for a warning; a missing status counts."""
    status = F.coalesce(_field("provenance.extraction_status"), F.lit("not_recorded"))
    return cards.select("cite_key", status.alias("extraction_status")).where(~F.col("extraction_status").isin(REVIEWED))


def stale_outputs(spark, stale: list[str]) -> DataFrame:
    """Violations for the generated files that ``sinks.write_or_check`` found outdated or missing."""
    return spark.createDataFrame([("stale_output", name, "generated file is missing or outdated") for name in stale], "rule string, entity string, message string")

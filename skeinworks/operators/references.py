"""References to records that do not exist: missing, deleted or late parents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spelling as S
from ..session import table

REFERENCE_COLUMNS = ["ref_table", "record_key", "parent_table", "ref_key", "ref_shown", "at"]
PARENT_COLUMNS = ["parent_table", "key", "shown", "arrived_at", "gone_at"]


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Every reference whose parent is missing, deleted or arrives after it.

    refs: one row per mention, ``REFERENCE_COLUMNS``; parents: one row per
    parent row, ``PARENT_COLUMNS``. Other columns are ignored. Returns
    ``ref_table, record_key, ref_value, orphan_kind, period``.

    Both sides are first reduced to one row per key (map-side partial
    aggregates, so a key or record repeated in a third of all rows shuffles
    little). They are then co-partitioned and sorted by the parent key and
    merged linearly: the ``merge`` hint gives exactly that sort-merge join,
    and AQE splits partitions of a hot parent on the reference side. The
    parent's validity interval is [first arrival, deletion of its last row).

    Defined cases: a null or "not known" ``ref_key`` is no reference; a null
    ``record_key`` stays null; a reference without time is never late and has
    a null period; a parent without arrival time was always there; repeated
    rows count once; empty parents make every reference missing.
    """
    refs = refs.select(*REFERENCE_COLUMNS).where(F.col("ref_key").isNotNull())
    refs = refs.groupBy("ref_table", "record_key", "parent_table", "ref_key").agg(F.min("at").alias("at"), F.min("ref_shown").alias("ref_shown"))
    spans = (
        parents.select(*PARENT_COLUMNS)
        .where(F.col("key").isNotNull())
        .groupBy(F.col("parent_table").alias("pt"), F.col("key").alias("pk"))
        .agg(F.min("shown").alias("shown"), F.min("arrived_at").alias("arrived_at"), F.every(F.col("gone_at").isNotNull()).alias("gone"))
    )
    merged = refs.hint("merge").join(spans.hint("merge"), (F.col("parent_table") == F.col("pt")) & (F.col("ref_key") == F.col("pk")), "left")
    kind = F.when(F.col("pk").isNull(), "missing").when(F.col("gone"), "deleted").when(F.col("arrived_at") > F.col("at"), "late")
    return merged.withColumn("orphan_kind", kind).where(F.col("orphan_kind").isNotNull()).select(
        "ref_table", "record_key", F.coalesce("shown", "ref_shown").alias("ref_value"), "orphan_kind", F.date_format("at", "yyyy-MM").alias("period")
    ).distinct()


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, month and kind."""
    return orphans.groupBy("ref_table", "period", "orphan_kind").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("ref_value").alias("n_keys"))


def _refs(df: DataFrame, ref_table: str, record, parent: str, ref_key, shown, at: str) -> DataFrame:
    return df.select(
        F.lit(ref_table).alias("ref_table"), record.alias("record_key"), F.lit(parent).alias("parent_table"), ref_key.alias("ref_key"), shown.alias("ref_shown"), F.col(at).alias("at")
    )


def _parents(df: DataFrame, parent: str, key, shown, arrived: str, gone: str) -> DataFrame:
    return df.select(F.lit(parent).alias("parent_table"), key.alias("key"), shown.alias("shown"), F.col(arrived).alias("arrived_at"), F.col(gone).alias("gone_at"))


def inventory_references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """References and parents of all five referring tables in one stream each."""
    t = lambda name: table(spark, sf_dir, name)
    image = S.image_id("stable_image_id")
    evidence = t("synthesis_claims").select("claim_id", "recorded_at", F.explode("supporting_evidence_ids").alias("e"))
    pairs = t("near_duplicate_pairs").select("pair_id", "compared_at", F.explode(F.array("left_stable_image_id", "right_stable_image_id")).alias("i"))
    refs = [
        _refs(t("sted_splits"), "sted_splits", image, "inventory", image, image, "assigned_at"),
        _refs(t("blank_stats"), "blank_stats", image, "sted_blanks", image, image, "computed_at"),
        _refs(pairs, "near_duplicate_pairs", F.col("pair_id").cast("string"), "sted_images", S.image_id("i"), S.image_id("i"), "compared_at"),
        _refs(evidence, "synthesis_claims", S.trimmed("claim_id"), "evidence_items", S.key("e"), S.trimmed("e"), "recorded_at"),
        _refs(t("dataset_manifest"), "dataset_manifest", S.trimmed("sample_id"), "stored_files", S.path("npz_path"), S.trimmed("npz_path"), "registered_at"),
    ]
    images = t("sted_images").select("stable_image_id", "ingested_at", "deleted_at")
    blanks = t("sted_blanks").select("stable_image_id", "ingested_at", "deleted_at")
    parents = [
        _parents(images.unionByName(blanks), "inventory", image, image, "ingested_at", "deleted_at"),
        _parents(blanks, "sted_blanks", image, image, "ingested_at", "deleted_at"),
        _parents(images, "sted_images", image, image, "ingested_at", "deleted_at"),
        _parents(t("evidence_items"), "evidence_items", S.key("evidence_id"), S.trimmed("evidence_id"), "recorded_at", "retracted_at"),
        _parents(t("stored_files"), "stored_files", S.path("file_path"), S.path("file_path"), "stored_at", "deleted_at"),
    ]
    union = lambda xs: xs[0] if len(xs) == 1 else xs[0].unionByName(union(xs[1:]))
    return union(refs), union(parents)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orphan references of the project's tables."""
    return orphan_references(*inventory_references(spark, sf_dir))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, month and kind."""
    return orphan_counts(p6_found(spark, sf_dir))

"""Validation rules: each yields the violations of a table as rows ``rule, entity, message``."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Rule = Callable[[dict[str, DataFrame]], DataFrame]


def violations(df: DataFrame, rule: str, entity: Column | str, message: Column | str) -> DataFrame:
    """Rows of ``df`` as violations."""
    entity = F.col(entity) if isinstance(entity, str) else entity
    message = F.lit(message) if isinstance(message, str) else message
    return df.select(F.lit(rule).alias("rule"), entity.cast("string").alias("entity"), message.alias("message"))


def check(name: str, table: str, bad: Column, entity: str, message: str) -> Rule:
    """Rows for which ``bad`` holds."""
    return lambda t: violations(t[table].where(bad), name, entity, message)


def unique(name: str, table: str, key: str) -> Rule:
    """Keys of more than one row."""
    return lambda t: violations(t[table].groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), name, key, F.format_string("%d rows", "n"))


def references(name: str, table: str, key: str, parent: str, parent_key: str, entity: str) -> Rule:
    """Rows whose key no parent row has; null keys refer to nothing."""
    return lambda t: violations(t[table].where(F.col(key).isNotNull()).join(t[parent].select(F.col(parent_key).alias(key)).distinct(), key, "left_anti"), name, entity, F.format_string("unknown %s", F.col(key).cast("string")))


def in_domain(name: str, table: str, column: str, values: list, entity: str) -> Rule:
    """Values outside a domain, nulls included."""
    return lambda t: violations(t[table].where(~F.coalesce(F.col(column).isin(values), F.lit(False))), name, entity, F.format_string(f"invalid {column} %s", F.coalesce(F.col(column).cast("string"), F.lit("null"))))


def one_role(name: str, table: str, group: str, role: str, where: Column | None = None) -> Rule:
    """Groups that cross roles."""
    from .roles import leaking_groups

    return lambda t: violations(leaking_groups(t[table], group, role, where), name, group, F.format_string("crosses roles: %s", "roles"))


def same_on_both(name: str, left: str, right: str, key: str, columns: list[str]) -> Rule:
    """Keys of one side only, and keys whose columns differ (null equals null)."""
    def run(t: dict[str, DataFrame]) -> DataFrame:
        a = t[left].select(F.col(key), F.struct(*columns).alias("l"))
        b = t[right].select(F.col(key), F.struct(*columns).alias("r"))
        both = a.join(b, key, "full_outer")
        differing = F.concat_ws(";", *[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in columns])
        message = F.when(F.col("r").isNull(), f"absent from {right}").when(F.col("l").isNull(), f"absent from {left}").otherwise(F.concat(F.lit("differs in "), differing))
        return violations(both.where(F.col("l").isNull() | F.col("r").isNull() | (differing != "")), name, key, message)

    return run


def has_columns(name: str, table: str, columns: list[str]) -> Rule:
    """Declared columns that a table lacks."""
    return lambda t: t[table].sparkSession.createDataFrame([(name, c, "missing column") for c in columns if c not in t[table].columns], "rule string, entity string, message string")


def run_rules(rules: list[Rule], tables: dict[str, DataFrame]) -> DataFrame:
    """All violations of all rules; an empty result is a pass."""
    return reduce(DataFrame.unionByName, [r(tables) for r in rules])


def first_examples(found: DataFrame, per_rule: int = 5) -> DataFrame:
    """Count and first examples of each rule, for a message.

    Each task keeps its own first entities of a rule before the shuffle (the
    limit on the row number is pushed below it), so no buffer holds all of them.
    """
    ranked = found.select("rule", "entity").where("entity IS NOT NULL").distinct().withColumn("r", F.row_number().over(W.partitionBy("rule").orderBy("entity"))).where(F.col("r") <= per_rule)
    examples = ranked.groupBy("rule").agg(F.array_sort(F.collect_list("entity")).alias("examples"))
    counts = found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(examples, "rule", "left").select("rule", "n", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def inventory_rules(images: str = "images") -> list[Rule]:
    """Rules of an inventory table."""
    return [
        unique("duplicate_id", images, "stable_image_id"),
        check("missing_hash", images, F.coalesce(F.col("source_sha256"), F.lit("")) == "", "relative_path", "no source_sha256"),
        unique("duplicate_path", images, "relative_path"),
    ]


def split_rules(splits: str = "splits", inventory: str = "inventory") -> list[Rule]:
    """Rules of a split table against its inventory."""
    kind = lambda k: F.col("source_kind") == k
    return [
        unique("duplicate_split", splits, "stable_image_id"),
        references("unknown_split", splits, "stable_image_id", inventory, "stable_image_id", "stable_image_id"),
        references("missing_split", inventory, "stable_image_id", splits, "stable_image_id", "stable_image_id"),
        one_role("group_crosses_roles", splits, "biological_group_candidate", "eligibility"),
        one_role("fiber_group_crosses_roles", splits, "acquisition_group", "eligibility", kind("fiber_image")),
        one_role("blank_group_crosses_roles", splits, "acquisition_group", "eligibility", kind("blank_background")),
        check("role_differs", splits, ~F.col("primary_metric_role").eqNullSafe(F.col("eligibility")), "stable_image_id", "primary_metric_role differs from eligibility"),
        check("blank_split_differs", splits, kind("blank_background") & ~F.col("synthetic_split").eqNullSafe(F.col("eligibility")), "stable_image_id", "synthetic_split differs from eligibility"),
        in_domain("secondary_role", splits, "secondary_image_eval_role", ["not_assigned", "secondary_training", "secondary_validation", "secondary_test"], "stable_image_id"),
    ]


def file_rules(manifest: str = "manifest", files: str = "files") -> list[Rule]:
    """Manifest rows against the files on disk, both directions, hashes compared."""
    return [same_on_both("files", manifest, files, "relative_path", ["source_sha256"])]
